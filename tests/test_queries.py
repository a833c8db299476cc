"""Every registered query against its SQL."""

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_stability import single
from test_transfer import logistic

import __spark_entry__
from lexiloom.operators import stability
from lexiloom.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        compare.same_rows(QUERIES[name](spark, SF), con, SQL[name])
    else:
        WITHOUT_SQL[name](spark, QUERIES[name](spark, SF))


def rows_of(table, key):
    """One row for each of a table's keys."""

    def check(spark, df):
        want = spark.read.parquet(f"{SF}/{table}.parquet").select(*key).collect()
        assert sorted(map(tuple, df.select(*key).collect())) == sorted(map(tuple, want))

    return check


def probabilities(spark, df):
    """A prediction between 0 and 1 for each labelled document, those of the other folds in all."""
    n = spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").count()
    got = df.collect()
    assert n // 2 - 2 <= len({r["source"] for r in got}) <= n and all(0 <= r["y_pred"] <= 1 for r in got)


def kept_posts(spark, df):
    """At most four posts of a user, with neither flags nor stopwords."""
    got = df.collect()
    seen = {}
    for r in got:
        seen[r["user"]] = seen.get(r["user"], 0) + 1
        assert not {"<NEGATE_FLAG>", "<UPPER_FLAG>", "the"} & set(r["tokens"])
    assert seen and max(seen.values()) <= 4


def stable_coefficients(spark, df):
    """As fifty single fits of the same subsamples."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x, y = np.array([r["embedding"] for r in rows], float), np.array([r["label"] % 2 for r in rows])
    ids = spark.createDataFrame([(r["vec_id"],) for r in rows], "source long")
    limits = stability.thresholds(ids, 50, 0.7, 42)
    drawn = ids.select("source", F.array(*(F.xxhash64("source", F.lit(k), F.lit(42)) <= t for k, t in enumerate(limits))).alias("d")).orderBy("source").collect()
    fits = np.array([single(x[d], y[d]) for d in np.array([r["d"] for r in drawn]).T])
    got = df.orderBy("name").collect()
    assert len(got) == x.shape[1] and {r["fits"] for r in got} == {50}
    assert np.allclose([r["mean"] for r in got], fits.mean(0), atol=2e-6) and np.allclose([r["std"] for r in got], fits.std(0, ddof=1), atol=2e-6)


def held_out_vectors(values):
    """A row for each held-out vector, with values in a range."""

    def check(spark, df):
        got = df.collect()
        n = len({r["source"] for r in got})
        assert 0.2 < n / spark.read.parquet(f"{SF}/embeddings.parquet").count() < 0.4
        assert len(got) == n * (2 if "model" in df.columns else 1) and all(values(r["y_pred"]) for r in got)

    return check


def transferred(spark, df):
    """Accuracy and f1 of plain fits to the features that SQL confirms, for every pair of languages and setting."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").join(spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null"), "doc_id").orderBy("lang", "doc_id").collect()
    values = {}
    names = set()
    for r in QUERIES["transfer_features"](spark, SF).collect():
        values[r["vocabulary"], r["source"], r["name"]] = r["value"]
        names.add(r["name"])
    names, langs = sorted(names), sorted({r["lang"] for r in labels})
    x = {(v, d): np.array([[values.get((v, r["doc_id"], n), 0.0) for n in names] for r in labels if r["lang"] == d]) for v in langs for d in langs}
    y = {d: np.array([r["toxic"] for r in labels if r["lang"] == d]) for d in langs}
    scaling = {k: (m.mean(0), np.where(m.std(0) > 1e-12, m.std(0), 1.0)) for k, m in x.items()}
    got = {(r["train"], r["test"], r["fix_vocabulary"], r["scale_independent"]): r for r in df.collect()}
    able = [d for d in langs if 0 < y[d].sum() < len(y[d])]
    assert set(got) == {(i, j, f, s) for i in able for j in langs for f in (True, False) for s in (True, False)}
    for (i, j, fixed, independent), r in got.items():
        b = logistic((x[i, i] - scaling[i, i][0]) / scaling[i, i][1], y[i])
        at = (i if fixed else j, j)
        m, s = scaling[at] if independent else scaling[i, i]
        hit, t = (x[at] - m) / s @ b[:-1] + b[-1] > 0, y[j] == 1
        assert r["accuracy"] == pytest.approx((hit == t).mean(), abs=1e-6) and r["f1"] == pytest.approx(2 * (hit & t).sum() / max(hit.sum() + t.sum(), 1), abs=1e-6)


def folds_of_words(spark, df):
    """Scores of plain fits to the documents' words in the same folds."""
    from lexiloom.plans import splits as plans

    counts, folds = plans._fold_tables(spark, SF)
    rows = folds.orderBy("source").collect()
    place = {r["source"]: i for i, r in enumerate(rows)}
    found = [r for r in counts.collect() if r["source"] in place and r["term"] not in ("the", "und")]
    terms = {t: j for j, t in enumerate(sorted({r["term"] for r in found}))}
    n = np.zeros((len(rows), len(terms)))
    for r in found:
        n[place[r["source"]], terms[r["term"]]] = r["n"]
    y, fold = np.array([r["y"] for r in rows]), np.array([r["fold"] for r in rows])
    got = {(r["fold"], r["group"]): r for r in df.collect()}
    assert len(got) == 2 * len(set(fold))
    for k in set(fold):
        train = fold != k
        uses = (n[train] > 0).sum(0)
        x = n[:, uses >= 10] * (np.log((1 + train.sum()) / (1 + uses[uses >= 10])) + 1)
        size = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        b = logistic(x[train], y[train])
        hit = x @ b[:-1] + b[-1] > 0
        for group, side in (("train", train), ("test", ~train)):
            r = got[k, group]
            assert r["accuracy"] == pytest.approx((hit[side] == y[side]).mean(), abs=1e-6) and r["null_users"] == (size[side] == 0).sum()


#: Checks of what SQL can't express; the models' values are compared in test_model_queries.
WITHOUT_SQL = {
    "tokenize_full": rows_of("conversations", ["conv_id", "turn"]),
    "tokenize_modelling": rows_of("conversations", ["conv_id", "turn"]),
    "load_posts": kept_posts,
    "logistic_fit": probabilities,
    "cross_validation": probabilities,
    "grid_search": lambda spark, df: [0 <= r["accuracy"] <= 1 or pytest.fail() for r in df.collect()],
    "transfer_scores": transferred,
    "fold_model_scores": folds_of_words,
    "coefficient_stability": stable_coefficients,
    "sequential_classes": held_out_vectors(lambda p: p in (0, 1)),
    "svm_probabilities": held_out_vectors(lambda p: 0 <= p <= 1),
    "lda_topics": lambda spark, df: [r["s"] == pytest.approx(1, abs=1e-3) or pytest.fail() for r in df.groupBy("source").sum("weight").toDF("source", "s").collect()],
}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
