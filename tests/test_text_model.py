"""The whole model, the search, splits and configurations on small tables."""

import collections
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom import cli
from lexiloom.operators import analysis as an
from lexiloom.operators import config as cf
from lexiloom.operators import search as se
from lexiloom.operators import selection as fs
from lexiloom.operators import splits as sp
from lexiloom.operators import text_model as tm
from lexiloom.operators import vocabulary as vo
from lexiloom.sources import readers

BAD, GOOD = "awful nasty horrid ugly".split(), "lovely sunny gentle calm".split()


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        words = list(rng.choice(["the", "and", "i", "table", "river"], 6)) + list(rng.choice(BAD if i % 2 else GOOD, 4))
        rows += [(i, words[:5]), (i, words[5:])]
    corpus = spark.createDataFrame([*rows, (99, ["unknown"]), (98, [])], "source long, tokens array<string>").cache()
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "source long, y int").cache()
    return corpus, labels


def accuracy(predictions, labels):
    return predictions.join(labels, "source").agg(F.avg(((F.col("y_pred") > 0.5) == (F.col("y") == 1)).cast("double"))).first()[0]


def lexicon(spark):
    return spark.createDataFrame([("aw", True, "neg"), ("nasty", False, "neg"), ("hor", True, "neg"), ("ugly", False, "neg"), ("love", True, "pos"), ("sunny", False, "pos"), ("gentle", False, "pos"), ("calm", False, "pos")], "entry string, is_prefix boolean, dim string")


@pytest.mark.parametrize(
    "options",
    [
        {"features": {"bag_of_words": {}}, "class_weight": "balanced"},
        {"features": {"tfidf": {}}, "selector": fs.Selector("pmi", top_k=8, smoothing=1.0), "standardize": True},
        {"features": {"liwc": {"norm": "l2"}, "tfidf": {}}, "selector": fs.Selector("kldivergence", top_k=9, filter_stopwords=True, keep_pronouns=True), "model": "naive_bayes"},
        {"features": {"lda": {"k": 3, "max_iter": 5}, "liwc": {"norm": "matched"}}, "model": "random_forest", "model_kwargs": {"n_estimators": 5}},
        {"features": {"bag_of_words": {}}, "model": "adaboost", "model_kwargs": {"n_estimators": 3}},
        {"features": {"liwc": {"norm": None}}, "model": "svm"},
    ],
)
def test_fit_save_load(spark, data, tmp_path, options):
    corpus, labels = data
    fitted = tm.TextModel(**options).fit(corpus, labels, lexicon=lexicon(spark))
    got = fitted.predict(corpus)
    assert accuracy(got, labels) > 0.9
    rows = {r["source"]: r["y_pred"] for r in got.collect()}
    assert set(rows) == {*range(60), 98, 99}
    fitted.save(f"file://{tmp_path}/m")
    again = tm.load(spark, f"file://{tmp_path}/m", lexicon=lexicon(spark))
    assert again.options == fitted.options
    assert {r["source"]: r["y_pred"] for r in again.predict(corpus).collect()} == pytest.approx(rows)
    names = [r["feature_set"] for r in fitted.feature_names().orderBy("idx").collect()]
    assert names == sorted(names) and len(names) == fitted.size
    if options.get("model", "logistic") == "logistic":
        c = {r["name"]: r["coef"] for r in fitted.coefficients().collect()}
        assert all(c[w] > 0 for w in BAD if w in c) and all(c[w] < 0 for w in GOOD if w in c)
        top = fitted.interpret(2).where("place > 0").collect()
        assert {r["name"] for r in top} <= set(BAD) and len(top) == 2
    if "lda" in fitted.options.features:
        assert fitted.topic_words(4).groupBy("topic").count().where("count = 4").count() == 3


def test_options_are_checked():
    for bad in ({"features": {"nothing": {}}}, {"features": {"liwc": {"norm": "l3"}}}, {"features": {"tfidf": {"x": 1}}}, {"model": "oracle"}, {"features": {}}):
        with pytest.raises(ValueError):
            tm.TextModel(**bad)


def test_selector_reindexes(spark, data):
    corpus, labels = data
    v = vo.Vocabulary()
    counts = v.counts(corpus)
    terms = v.fit_counts(counts)
    dtm = counts.join(labels.select("source"), "source", "left_semi")
    kept = fs.Selector("pmi", top_k=4, smoothing=1.0, protected=("table", "the"), filter_stopwords=True, keep_pronouns=True).fit(dtm, labels, terms).orderBy("idx").collect()
    got = [r["term"] for r in kept]
    assert got == sorted(got) and [r["idx"] for r in kept] == list(range(len(got)))
    assert "table" in got and "i" in got and "the" not in got and len(set(got) & {*BAD, *GOOD}) == 4
    moved = fs.reduce_columns(vo.vectorize(counts, terms), terms, spark.createDataFrame(kept))
    assert moved.agg(F.max("idx")).first()[0] == len(got) - 1
    with pytest.raises(ValueError):
        fs.stopword_groups(terms, ["absent"])
    groups = spark.createDataFrame([("not_The",), ("the",), ("the cat",), ("can",)], "term string")
    assert sorted(tuple(r) for r in fs.stopword_groups(groups, ["the", "can't"]).collect()) == [("can", "can"), ("not_The", "the"), ("the", "the")]


CONFIG = [{"feature_selector_ablation": True, "feature_set_ablation": True, "model": [{"name": "naive_bayes", "alpha": [0.1, 1.0]}], "features": {"bag_of_words": {}, "tfidf": {}, "liwc": {"norm": ["l1", "l2"]}}, "standardize": [False], "feature_selector": {"pmi": {"top_k": [6], "smoothing": [1.0]}}}]


def test_search(spark, data, tmp_path):
    corpus, labels = data
    (space,) = se.search_space(CONFIG)
    assert len(space) == 2 * 2 * 4 and space.feature_sets[0][1] == (({"bag_of_words": {}},), ({"tfidf": {}},), ({"tfidf": {}, "liwc": {"norm": "l1"}}, {"tfidf": {}, "liwc": {"norm": "l2"}}))
    small = [CONFIG[0] | {"feature_selector": {}, "model": [{"name": "naive_bayes", "alpha": [1.0]}]}]
    best, results = se.search(tm.TextModel(), small, corpus, labels, lexicon=lexicon(spark))
    rows = results.orderBy("place").collect()
    assert len(rows) == 4 and max(r["score"] for r in rows) > 0.9
    assert accuracy(best.predict(corpus), labels) > 0.9
    (whole,) = se.search_space([CONFIG[0] | {"feature_set_ablation": False, "features": {"bag_of_words": {}, "tfidf": {}, "liwc": {"norm": ["l1"]}}}])
    assert whole.feature_sets[0][1] == (({"tfidf": {}, "liwc": {"norm": "l1"}},),)
    with pytest.raises(ValueError):
        se.search_space([CONFIG[0] | {"feature_set_ablation": False}])


def test_splits(spark):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "source long, label int")
    got = sp.split_data(labels, sp.SplitConfig(kfolds=3, class_ratio=(1, 1))).collect()
    test = {r["source"] for r in got if r["role"] == "test"}
    assert len(test) == 18 and sum(s % 3 == 0 for s in test) == 6
    dev = collections.defaultdict(set)
    for r in got:
        if r["role"] == "dev":
            dev[r["fold"]].add(r["source"])
    whole = set().union(*dev.values())
    assert len(whole) == 48 == sum(map(len, dev.values())) and not whole & test
    for k in dev:
        assert {r["source"] for r in got if r["role"] == "train" and r["fold"] == k} == whole - dev[k]
    rows = spark.createDataFrame(got)
    assert {(r["role"], r["source"]) for r in sp.recombine(rows).collect()} == {("train", s) for s in whole} | {("test", s) for s in test}
    given = labels.withColumn("split", F.expr("case when source < 60 then 'train' when source < 75 then 'dev' else 'test' end"))
    got = sp.split_data(given, sp.SplitConfig(kfolds=2)).collect()
    assert {r["source"] for r in got if r["role"] == "dev"} == set(range(60, 75)) and {r["source"] for r in got if r["role"] == "test"} == set(range(75, 90))
    paired = sp.pair_across(rows, spark.createDataFrame(got)).collect()
    assert {r["source"] for r in paired if r["role"] == "dev"} == set(range(60, 75)) and {r["source"] for r in paired if r["role"] == "train"} == whole


def test_controls(spark):
    rows = [(i, "target" if i < 10 else "control" if i < 60 else None, "train", "f" if i % 2 else "m", float(20 + i % 5), [10 + i] if i < 10 else [], ["clpsych"] if i % 2 else ["multitask"]) for i in range(70)]
    df = spark.createDataFrame(rows, "source long, label string, split string, gender string, age double, matches array<long>, datasets array<string>")
    assert {r["source"] for r in sp.isolate_controls(df, "multitask", 5).collect()} == set(range(20))
    got = sp.isolate_controls(df, "clpsych", 3).collect()
    assert len(got) == 16 and {(r["gender"], r["age"]) for r in got} <= {(r["gender"], r["age"]) for r in got if r["label"] == "target"}
    assert sp.isolate_controls(df, "rsdd", 5).count() == 60
    assert {r["label"] for r in sp.isolate_controls(df, "merged", 3).collect()} == {"target", "control"}
    hot = sp.one_hot(spark.createDataFrame([(1, ["PTSD", "mdd"]), (2, None), (3, ["odd"])], "id int, c array<string>"), "c", {"ptsd": "ptsd", "mdd": "depression"})
    assert [tuple(r)[2:] for r in hot.orderBy("id").collect()] == [(1, 1), (0, 0), (0, 0)]


def test_anomalies_and_overlap(spark):
    df = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 4, 1), (4, 3, 0), (5, 6, 1)], "id int, match int, flag int")
    assert sorted(r["id"] for r in sp.without_anomalies(df, "id", "match", spark.createDataFrame([(6,)], "id int"), ["flag"]).collect()) == [1, 2]
    flags = sp.overlap_flags(df, "id", a=spark.createDataFrame([(1,), (1,)], "id int")).orderBy("id").collect()
    assert [r["in_a"] for r in flags] == [True, False, False, False, False]


def test_temporal_splits(spark):
    import datetime as dt

    bounds = ["2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01"]
    posts = [(u, dt.datetime(2024, m, 5)) for u in range(40) for m in (1, 2, 3) if m < 3 or u < 2]
    df = spark.createDataFrame(posts, "source int, at timestamp_ntz")
    labels = spark.createDataFrame([(u, u % 2) for u in range(40)], "source int, y int")
    splits = sp.temporal_splits(df, labels, bounds, sp.SplitConfig(kfolds=2, test_size=0.25), min_users=5)
    got = splits.collect()
    assert {r["bin"] for r in got} == {0, 1}
    for b in (0, 1):
        test = [r for r in got if r["bin"] == b and r["role"] == "test"]
        assert sorted(r["label"] for r in test) == [0] * 5 + [1] * 5
        assert {r["source"] for r in got if r["bin"] == b and r["role"] == "dev"} == set(range(40)) - {r["source"] for r in test}
    periods = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]))], "bin int, lo string, hi string")
    pred = spark.createDataFrame([(a, b, f, u, 0.5) for a in (0, 1) for b in (0, 1) for f in (1, 2) for u in range(40)], "train_bin int, test_bin int, fold int, source int, y_pred double")
    rows = sp.assemble_predictions(pred, splits, periods).collect()
    train = {(r["bin"], r["fold"], r["source"]) for r in got if r["role"] == "train"}
    assert len(rows) == 2 * 2 * (30 + 2 * 10) and all(r["user_in_training"] == ((r["train_bin"], r["fold"], r["source"]) in train) for r in rows)
    assert not any(r["user_in_training"] for r in rows if r["train_bin"] == r["test_bin"])
    sizes = sp.combination_sizes(spark.createDataFrame(rows)).collect()
    assert len(sizes) == 2 * 2 * 2 * 2 * 2 and sum(r["n"] for r in sizes) == len(rows)
    assert sp.temporal_splits(df, labels, bounds, sp.SplitConfig(), min_users=500).count() == 0


def test_small_things(spark, tmp_path):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],)], "a array<int>")
    assert [r[0] for r in df.select(an.chunks(F.col("a"), 2)).collect()] == [[[1, 2], [3, 4], [5]], [[]]]
    names = spark.createDataFrame([("ok \U0001f602",), (None,), ("plain",)], "t string").select(an.name_emoji(F.col("t")))
    assert [r[0] for r in names.collect()] == ["ok EMOJI=face with tears of joy", None, "plain"]
    rows = spark.createDataFrame([("a/1.gz", "target", ["x", "y"]), ("/b/2.gz", None, None)], "source string, label string, datasets array<string>")
    readers.write_metadata(rows, f"file://{tmp_path}/meta")
    back = readers.read_metadata_csv(spark, f"file://{tmp_path}/meta", "source string, label string, datasets array<string>", lambda d: d.where("label is not null"), "/root")
    assert [tuple(r) for r in back.collect()] == [("/root/a/1.gz", "target", ["x", "y"])]
    assert readers.discover("x/one.json.gz") == {} and readers.discover("x") == {"pathGlobFilter": "*.gz"}
    (tmp_path / "plain.json").write_text('{"a": 1}\n{"a": 2}\n')
    at = f"file://{tmp_path}/plain.json"
    assert spark.read.options(**readers.discover(at, spark=spark)).json(at).count() == 2
    assert readers.discover(f"file://{tmp_path}", spark=spark) == {"pathGlobFilter": "*.gz"}
    words = spark.createDataFrame([("Calm", 2), ("calm", 2), ("awe", 3), ("rare", 1)], "term string, n long")
    assert sorted(r["term"] for r in vo.external_terms(words, lexicon(spark), 3).collect()) == ["awe", "calm"]
    learned = spark.createDataFrame([("calm", 7, 0), ("z", 1, 1)], "term string, n long, idx long")
    assert [tuple(r) for r in vo.protect(learned, words.select("term")).select("term", "n", "idx").orderBy("idx").collect()][:3] == [("Calm", 1, 0), ("awe", 1, 1), ("calm", 7, 2)]
    (tmp_path / "e.txt").write_text("".join(f"w{i} 0.5\n" for i in range(50)))
    assert {r["term"] for r in readers.read_embedding_vocabulary(spark, f"file://{tmp_path}/e.txt", 3).collect()} == {"w0", "w1", "w2"}


def config():
    vocab = dict.fromkeys(cf.NESTED["vocab_kwargs"], False) | {"emoji_handling": None, "max_tokens_per_document": None, "max_documents_per_user": None, "max_vocab_size": None, "min_token_freq": 2, "max_token_freq": None, "ngrams": [1, 1], "binarize_counter": True}
    return {
        "experiment_name": "small", "train_data": "x", "target_disorder": "y", "random_seed": 4, "kfolds": 2, "test_size": 0.2, "downsample": False, "downsample_size": None, "rebalance": True, "class_ratio": [1, 1],
        "model": "logistic", "model_kwargs": {"C": 1.0, "random_state": 1}, "vocab_kwargs": vocab, "grid_search": False, "grid_search_kwargs": dict.fromkeys(cf.NESTED["grid_search_kwargs"]) | {"test_size": 0.2},
        "preprocessing_kwargs": {"feature_flags": {"tfidf": True, "liwc": False}, "feature_kwargs": {}, "standardize": False}, "feature_selector": None, "feature_selection_kwargs": {"top_k": 5},
    }


def test_configuration():
    assert cf.validate(config()) and cf.text_model(config()).features == {"tfidf": {}}
    for change, error in (({"kfolds": "2"}, ValueError), ({"test_size": 1.5}, ValueError), ({"feature_selector": "x"}, ValueError)):
        with pytest.raises(error):
            cf.validate(config() | change)
    for key in ("model", "vocab_kwargs"):
        with pytest.raises(KeyError):
            cf.validate({k: v for k, v in config().items() if k != key})
    with pytest.raises(KeyError):
        cf.validate(config(), "temporal_effects")


def test_command_line(spark, data, tmp_path):
    corpus, labels = data
    corpus.write.parquet(f"{tmp_path}/posts")
    labels.write.parquet(f"{tmp_path}/labels")
    (tmp_path / "c.json").write_text(json.dumps(config()))
    at = lambda p: f"file://{tmp_path}/{p}"
    out = cli.train(spark, at("c.json"), at("posts"), at("labels"), at("out"))
    assert spark.read.parquet(f"{out}/scores").where("accuracy > 0.8").count() == 3  # two folds and the test set
    cli.main(["infer", f"{out}/model", at("posts"), at("predictions")])
    cli.main(["evaluate", at("predictions"), at("labels"), at("report")])
    assert spark.read.parquet(at("report")).first()["accuracy"] > 0.9
