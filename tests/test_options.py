"""Configurations of every shape that experiments have: translated, honoured or refused."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from lexiloom import cli
from lexiloom.operators import config as cf
from lexiloom.operators import options as op
from lexiloom.operators import search as se

BOTH = lambda a, b=None: {"train": a, "test": a if b is None else b}
MODEL = {
    "experiment_name": "shape", "train_data": "posts", "target_disorder": "t", "jobs": 1, "random_seed": 3, "kfolds": 2, "stratified": True, "test_size": 0.2,
    "date_boundaries": BOTH({"min_date": "2024-01-01", "max_date": "2024-02-01"}), "downsample": BOTH(False), "downsample_size": BOTH(9), "rebalance": BOTH(True), "class_ratio": BOTH([1, 1]),
    "post_sampling": BOTH({"n_samples": None, "randomized": False}), "drop_null": BOTH(False),
    "vocab_kwargs": {
        **dict.fromkeys(["filter_negate", "filter_upper", "filter_punctuation", "filter_numeric", "filter_user_mentions", "filter_url", "filter_retweet", "keep_pronouns", "binarize_counter"], True),
        **dict.fromkeys(["filter_stopwords", "filter_hashtag", "strip_hashtag", "preserve_case", "external_only"], False),
        **dict.fromkeys(["emoji_handling", "max_tokens_per_document", "max_documents_per_user", "max_token_freq"]), "filter_mh_subreddits": "all", "filter_mh_terms": "some", "max_vocab_size": 250, "min_token_freq": 2, "ngrams": [1, 1], "external_vocab": [],
    },
    "grid_search": False, "grid_search_kwargs": {"config": "search.json", "test_size": 0.2, "dev_frac": 0, "dev_in_vocab": False, "score_func": "f1", "use_multiprocessing": False},
    "model": "logistic", "model_kwargs": {"C": 1, "solver": "lbfgs", "random_state": 3, "max_iter": 90, "class_weight": None},
    "preprocessing_kwargs": {
        "feature_flags": {"bag_of_words": False, "tfidf": True, "glove": True, "liwc": True, "lda": True},
        "feature_kwargs": {"tfidf": {}, "glove": {"dim": 25, "pooling": "mean"}, "liwc": {"norm": "matched"}, "lda": {"n_components": 2, "doc_topic_prior": None, "topic_word_prior": None, "random_state": 3}}, "standardize": False,
    },
    "feature_selector": "kldivergence", "feature_selection_kwargs": {"top_k": 100, "min_support": 1, "stopwords": None, "add_lambda": 0.01, "beta": 0.1, "keep_pronouns": False, "preserve_protected": False, "filter_stopwords": False},
}
TRANSFER = MODEL | {"test_data": "other", "run_on_test": False, "model_kwargs": {"C": 1000.0, "solver": "lbfgs", "random_state": 3, "max_iter": 50, "class_weight": "balanced"}}
TEMPORAL = TRANSFER | {"date_boundaries": BOTH(["2024-01-01", "2024-02-01"]), "min_posts": BOTH(1), "post_sampling": BOTH({"n_samples": 3, "randomized": True}), "mixed_time_windows": False, "balance_date_splits": False, "min_users_per_split": 2}
SEARCH = [{
    "name": "shape", "feature_selector_ablation": False, "feature_set_ablation": False, "model": [{"name": "logistic", "solver": ["lbfgs"], "max_iter": [50], "C": [0.1, 1], "class_weight": [None, "balanced"], "random_state": [3]}, {"name": "svm", "kernel": ["linear"], "C": [1]}],
    "features": {"tfidf": {}, "liwc": {"norm": ["matched"]}, "glove": {"dim": [200], "pooling": ["mean"]}, "lda": {"n_components": [2], "doc_topic_prior": [None], "topic_word_prior": [None], "random_state": [3]}}, "standardize": [False, True],
    "feature_selector": {"kldivergence": {"top_k": [50], "min_support": [1], "add_lambda": [0.001], "beta": [0.1], "keep_pronouns": [True], "preserve_protected": [True], "filter_stopwords": [True]}},
}]


@pytest.mark.parametrize(("kind", "config"), [("model", MODEL), ("domain_transfer", TRANSFER), ("temporal_effects", TEMPORAL)])
def test_shapes_are_translated(spark, kind, config):
    model = cf.text_model(cf.validate(config, kind))
    assert model.features == {"tfidf": {}, "liwc": {"norm": "matched"}, "glove": {"dim": 25, "how": "mean"}, "lda": {"k": 2, "seed": 3}}
    assert model.model_kwargs == {"C": config["model_kwargs"]["C"], "max_iter": config["model_kwargs"]["max_iter"]} and model.class_weight == config["model_kwargs"]["class_weight"]
    assert (model.selector.kind, model.selector.smoothing, model.selector.beta) == ("kldivergence", 0.01, 0.1)
    loader = cf.post_loader(config, {"subreddits": {"all": ["S"]}, "terms": {"some": ["word"]}})
    assert loader.filter_url and not loader.preserve_case and loader.ignore_subreddits == ("S",) and loader.ignore_terms == ("word",)
    chosen = cf.post_selection(config, "test")
    assert (chosen["min_date"], chosen["max_date"], chosen["n_samples"]) == ("2024-01-01", "2024-02-01", 3 if kind == "temporal_effects" else None)
    assert cf.split_config(config | {"test_size": 0}).test_size == 0


def test_search_shape(spark):
    (space,) = se.search_space(SEARCH)
    assert len(space.models) == 5 and space.models[1] == ("logistic", {"max_iter": 50, "C": 0.1, "class_weight": "balanced"}) and space.models[4] == ("svm", {"kernel": "linear", "C": 1})
    assert space.selectors[0].smoothing == 0.001 and space.selectors[0].keep_pronouns and len(space) == 10
    assert space.feature_sets[0][1] == (({"tfidf": {}, "liwc": {"norm": "matched"}, "glove": {"dim": 200, "how": "mean"}, "lda": {"k": 2, "seed": 3}},),)


def test_what_cant_be_honoured_raises(spark):
    for call in (
        lambda: op.model_options("logistic", {"penalty": "l1"}), lambda: op.model_options("mlp", {"activation": "tanh"}), lambda: op.model_options("naive_bayes", {"class_weight": "balanced"}), lambda: op.model_options("oracle", {}),
        lambda: op.feature_options("glove", {"dim": 30}), lambda: op.feature_options("lda", {"odd": 1}), lambda: op.selector_options({"odd": 1}), lambda: cf.post_loader(MODEL), lambda: cf.post_loader(MODEL | {"vocab_kwargs": MODEL["vocab_kwargs"] | {"external_vocab": ["liwc"]}}),
    ):
        with pytest.raises(ValueError):
            call()
    assert op.model_options("mlp", {"hidden_layer_sizes": [7], "activation": "logistic"}) == ({"layers": (0, 7, 2)}, None)


def test_train_and_infer_by_a_configuration(spark, tmp_path):
    """Filters, dates and the test set take effect: excluded words, places and days never reach the model."""
    day = 86_400
    start = 1_704_067_200  # 2024-01-01
    rows = []
    for u in range(40):
        mood = ["awful", "nasty"] if u % 2 else ["lovely", "calm"]
        rows += [(u, start + d * day, [*mood, "the", "<URL_TOKEN>", f"W{u % 3}"], "place") for d in range(2)]
        rows += [(u, start - day, ["early"], "place"), (u, start + day, ["hidden"], "Secret"), (u, start + day, ["forbidden", "word"], "place"), (u, start + 40 * day, ["late"], "place")]
    posts = spark.createDataFrame(rows, "source long, created_utc long, tokens array<string>, subreddit string")
    posts.write.parquet(f"{tmp_path}/posts")
    spark.createDataFrame([(u, u % 2) for u in range(40)], "source long, y int").write.parquet(f"{tmp_path}/labels")
    (tmp_path / "lists.json").write_text(json.dumps({"subreddits": {"all": ["secret"]}, "terms": {"some": ["forbidden"]}}))
    (tmp_path / "lexicon.dic").write_text("%\n1\tneg\n2\tpos\n%\nawf*\t1\nnasty\t1\nlovely\t2\ncalm\t2\n")
    c = copy.deepcopy(MODEL)
    c["preprocessing_kwargs"]["feature_flags"] |= {"glove": False, "lda": False}
    c["feature_selector"] = None
    (tmp_path / "c.json").write_text(json.dumps(c))
    at = lambda p: f"file://{tmp_path}/{p}"
    out = cli.train(spark, at("c.json"), at("posts"), at("labels"), at("out"), lexicon=at("lexicon.dic"), excluded=at("lists.json"))
    terms = {r["term"] for r in spark.read.parquet(f"{out}/model/terms").collect()}
    assert terms == {"awful", "nasty", "lovely", "calm", "the", "w0", "w1", "w2"}
    scores = {(r["group"], r["fold"]): r["accuracy"] for r in spark.read.parquet(f"{out}/scores").collect()}
    assert set(scores) == {("dev", 1), ("dev", 2), ("test", 0)} and min(scores.values()) > 0.9
    cli.infer(spark, f"{out}/model", at("posts"), at("predictions"), lexicon=at("lexicon.dic"))
    got = spark.read.json(at("predictions")).withColumn("y", F.col("source").cast("long") % 2)
    assert got.count() == 40 and got.where("(y_pred > 0.5) = (y = 1)").count() == 40
    with pytest.raises(ValueError, match="created_utc"):
        cli.filtered(posts.drop("created_utc"), cf.post_loader(c, {"subreddits": {"all": []}, "terms": {"some": []}}), min_date="2024-01-01")
