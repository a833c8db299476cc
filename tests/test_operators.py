"""Sources, streaming, models and samplers on small tables."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import analysis, evaluation, models, sampling, temporal
from lexiloom.operators.features import lexicon_features, match_lexicon, pool_embeddings
from lexiloom.operators.ranking import position
from lexiloom.operators.vocabulary import Vocabulary
from lexiloom.sources import readers
from lexiloom.streaming import posts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_users_from_lines(spark, tmp_path):
    with gzip.open(tmp_path / "x_training.json.gz", "wt") as f:
        f.write(json.dumps({"id": "u1", "label": ["control"], "posts": [["5", "hello"], ["7", "again"]]}) + "\n")
    got = rows(readers.read_users(spark, str(tmp_path), {"training": "train", "testing": "test"}).drop("label"))
    assert got == [("u1", "train", 5, "hello"), ("u1", "train", 7, "again")]


def test_tweets_and_comments(spark, tmp_path):
    tweet = {"id_str": "1", "text": "short", "extended_tweet": {"full_text": "long one"}, "user": {"id_str": "9", "name": "n"}}
    (tmp_path / "t.json").write_text(json.dumps(tweet))
    flat = readers.flatten_tweets(spark.read.json(str(tmp_path / "t.json"))).first()
    assert (flat["text"], flat["user_id_str"]) == ("long one", "9")
    df = spark.createDataFrame([("a", 1, "b")], "author string, created_utc long, body string")
    assert readers.rename(df, readers.COMMENT, tolerant=True).columns == list(readers.COMMENT.values())
    with pytest.raises(Exception):
        readers.rename(df, readers.COMMENT).collect()
    assert readers.split_link(spark.createDataFrame([("t3_xyz",)], "link_id string")).first()[0] == "xyz"


def test_lexicon_and_embeddings(spark, tmp_path):
    (tmp_path / "l.dic").write_text("%\n1 pos\n2 neg\n%\ngood 1\nbad* 2\nbadly* 1\n")
    lexicon = readers.read_lexicon(spark, str(tmp_path / "l.dic"))
    terms = spark.createDataFrame([(t,) for t in ("good", "goodness", "bad", "badder", "badlyx", "")], "term string")
    assert rows(match_lexicon(terms, lexicon)) == [("bad", "neg"), ("badder", "neg"), ("badlyx", "pos"), ("good", "pos")]
    with pytest.raises(ValueError):
        lexicon_features(terms, lexicon, "other")
    (tmp_path / "e.txt").write_text("<x> 1 2\n#tag 1 -3\nword 2 1\n")
    e = readers.read_embeddings(spark, str(tmp_path / "e.txt"))
    counts = spark.createDataFrame([("s", "tag", 1), ("s", "word", 3), ("t", "none", 1)], "source string, key string, n long")
    assert rows(pool_embeddings(counts, e)) == [("s", 0, 1.75), ("s", 1, 0.0)]
    assert rows(pool_embeddings(counts, e, "extremum")) == [("s", 0, 2.0), ("s", 1, -3.0)]


def test_vocabulary_rules(spark):
    corpus = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["x", "z"]), ("c", [])], "source string, tokens array<string>")
    assert rows(Vocabulary(min_freq=2).fit(corpus)) == [("x", 2, 0)]
    assert rows(Vocabulary(max_size=1, protected=("q",)).fit(corpus)) == [("q", 1, 0), ("x", 2, 1)]
    assert rows(Vocabulary(binarize=False, max_freq=2, excluded=("z",)).fit(corpus)) == [("y", 1, 0)]
    many = spark.createDataFrame([(f"{i * 7919 % 1000:03d}",) for i in range(1000)], "t string")
    assert all(int(r["t"]) == r["idx"] for r in position(many, "t").collect())


def test_samples(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(100)], "k int, y int")
    got = sampling.rebalance(df, "y", "k", (1, 2)).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {1: 20, 0: 40}
    few = sampling.rebalance(df, "y", "k", (1, 8)).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in few} == {1: 10, 0: 80}
    folds = sampling.stratified_folds(df, "y", "k", 4).groupBy("fold", "y").count().collect()
    assert {r["count"] for r in folds if r["y"] == 1} == {5}


def test_scores(spark):
    df = spark.createDataFrame([("g", 1, 0.9), ("g", 0, 0.9), ("g", 1, 0.4), ("g", 0, 0.1), ("h", 1, 0.7), ("h", 0, 0.8)], "g string, y_true int, y_pred double")
    auc = {r["g"]: r["auc"] for r in evaluation.auc(df, ["g"]).collect()}
    assert auc == {"g": 0.625, "h": 0.0}
    s = {r["g"]: r for r in evaluation.scores(df, ["g"]).collect()}
    assert (s["g"]["precision"], s["g"]["recall"]) == (0.5, 0.5) and s["h"]["f1"] == 0.0
    assert evaluation.best_f1(df, ["g"]).count() == 2


def test_streaming_counts(spark, tmp_path):
    df = spark.sql("select * from values ('a', timestamp'2024-01-01'), ('a', timestamp'2024-01-02'), ('b', timestamp'2024-01-12'), ('a', timestamp'2024-03-01') as t(u, at)")
    df.write.parquet(str(tmp_path / "in"))
    stream = posts.windowed_counts(posts.read_stream(spark, str(tmp_path / "in"), "u string, at timestamp"), "at", ["u"])
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 4


def test_models(spark):
    data = [(f"s{i}", [float(i % 2) + 0.1 * (i % 3), float(i % 5)], i % 2) for i in range(60)]
    df = spark.createDataFrame(data, "source string, f array<double>, label int")
    df = df.select("source", models.array_to_vector("f").alias("features"), F.col("label").cast("double").alias("label"))
    for name in ("logistic", "decision_tree", "adaboost", "svm", "sgd"):
        options = {"n_estimators": 3} if name == "adaboost" else {}
        p = models.predict(models.classifier(name, **options).fit(df), df).join(df, "source")
        right = p.agg(F.avg(((F.col("y_pred") > 0.5) == (F.col("label") == 1)).cast("double"))).first()[0]
        assert right > 0.8, name
    with pytest.raises(ValueError):
        models.classifier("other")


def test_search():
    scores = {"bow": 0.5, "tfidf": 0.6, "lda": 0.4, "glove": 0.6}
    chosen, results = models.greedy_search([models.Stage("a", ["bow", "tfidf"]), models.Stage("b", ["lda"]), models.Stage("c", ["glove"])], lambda c: scores[c[-1]])
    assert chosen == ["tfidf", "glove"] and len(results) == 4
    assert len(models.grid({"C": [1, 2], "x": [3, 4, 5]})) == 6
    assert len(analysis.experiment_matrix(["a", "b"], ["c"], k=[1, 2])) == 4


def test_time_bins(spark):
    df = spark.sql("select * from values (1, timestamp_ntz'2023-12-31'), (1, timestamp_ntz'2024-01-01'), (1, timestamp_ntz'2024-01-08'), (2, timestamp_ntz'2024-02-01') as t(u, at)")
    assert rows(temporal.time_bins(df, "u", "at", ["2024-01-01", "2024-01-08"])) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]
