"""The table store: keys, sharing, lifetimes and what a killed run leaves."""

import os

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import search as se
from lexiloom.operators import text_model as tm
from lexiloom.sources.store import TableStore, digest, fingerprint


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, None), (2, None, None)], "i int, s string, v array<double>")
    same = df.select("v", "s", "i").repartition(3)
    assert fingerprint(df) == fingerprint(same)
    others = [df.distinct(), df.withColumn("i", F.col("i") + 1), df.withColumnRenamed("s", "t"), df.limit(0), df.union(df)]
    assert len({fingerprint(df), *map(fingerprint, others)}) == 6
    assert digest({"a": 1, "b": 2}) == digest({"b": 2, "a": 1}) != digest({"a": 1})


def test_made_once_and_deleted(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    make = lambda: spark.range(3)
    at = lambda tag: os.path.isdir(f"{tmp_path}/s/{tag}-k")
    with store.holding():
        assert store.table("a", "k", make).count() == 3
        with store.holding():
            store.table("a", "k", make)
            store.table("b", "k", make)
            assert at("a") and at("b")
        assert at("a") and not at("b")  # the outer scope holds the first
    assert not at("a") and store.made == {"a": 1, "b": 1}
    with pytest.raises(ZeroDivisionError), store.holding():
        store.table("a", "k", make)
        1 / 0  # noqa: B018
    assert not at("a")
    store.table("c", "k", make)  # outside of any scope a table stays until the store closes
    assert at("c")
    store.close()
    assert not os.path.isdir(f"{tmp_path}/s")


def test_unfinished_table_is_made_anew(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    store.table("a", "k", lambda: spark.range(5))
    assert TableStore(spark, f"file://{tmp_path}/s").table("a", "k", lambda: spark.range(9)).count() == 5
    os.remove(f"{tmp_path}/s/a-k/_SUCCESS")
    assert TableStore(spark, f"file://{tmp_path}/s").table("a", "k", lambda: spark.range(9)).count() == 9


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, (["calm", "good", f"w{i % 5}"] if i % 2 else ["awful", "bad", f"w{i % 7}"]) * 2) for i in range(40)]
    rows += [(100 + i, ["heldout"] * 9 + ["zz"] * 9) for i in range(20)]
    return spark.createDataFrame(rows, "source long, tokens array<string>"), spark.createDataFrame([(i, i % 2) for i in range(40)], "source long, y int")


def test_search_shares_tables_and_leaves_none(spark, data, tmp_path):
    """Two classifiers and two scalings of two feature sets: each level's tables are made once, and none is left."""
    corpus, labels = data
    config = [{"feature_selector_ablation": False, "feature_set_ablation": True, "model": [{"name": "logistic", "C": [0.1, 1.0]}], "features": {"bag_of_words": {}, "tfidf": {}}, "standardize": [False, True], "feature_selector": {"pmi": {"top_k": [6], "smoothing": [1.0]}}}]
    store = TableStore(spark, f"file://{tmp_path}/s")
    best, results = se.search(tm.TextModel(), config, corpus, labels, store=store)
    assert results.count() == 2 * 2 * 2
    assert store.made["counts"] == 2 and store.made["terms"] == store.made["selected"] == store.made["roles"] == 1  # counts of both parts
    assert store.made["train"] == store.made["vectors"] == 4 and store.made["names"] == 2 and store.made["features"] == 4 and store.made["inside"] == 2
    assert not os.path.isdir(f"{tmp_path}/s") or os.listdir(f"{tmp_path}/s") == []
    right = best.predict(corpus).join(labels, "source").where("round(y_pred) = y").count()
    assert right == 40


def test_vocabulary_of_training_rows_only(spark, data):
    """Unlabelled, development and test words never enter; an empty vocabulary is a ValueError."""
    corpus, labels = data
    for options in (tm.TextModel(vocabulary=tm.Vocabulary(max_size=4)), tm.TextModel()):
        terms = {r["term"] for r in options.fit(corpus, labels).terms.collect()}
        assert terms and not terms & {"heldout", "zz"}
    half = options.fit(corpus, labels.where("source < 4"))
    assert {r["term"] for r in half.terms.collect()} == {"calm", "good", "awful", "bad", "w0", "w1", "w2", "w3"}
    with pytest.raises(ValueError, match="no training row"):
        tm.TextModel(vocabulary=tm.Vocabulary(min_freq=1000)).fit(corpus, labels)
