"""Plans that hold at size: what is sent out, and results that don't depend on the order of rows."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from lexiloom.functions import tokenizer as tk
from lexiloom.operators import analysis as an
from lexiloom.operators import features as fe
from lexiloom.operators import models as mo
from lexiloom.operators import transfer as tr
from lexiloom.operators import wide
from lexiloom.operators.ranking import with_average_rank
from lexiloom.operators.vocabulary import Vocabulary
from lexiloom.plans import common
from lexiloom.plans import features as pf
from lexiloom.plans import text as pt
from lexiloom.plans.registry import QUERIES


def broadcast_rows(df):
    """Rows of each broadcast of a plan that has run."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "BroadcastExchangeExec":
                found.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


LEXICON = [("the", False, "function"), ("un", True, "negative"), ("word1", True, "many"), ("word12", True, "longer")]


def lexicon_of(spark):
    return spark.createDataFrame(LEXICON, "entry string, is_prefix boolean, dim string")


def test_lexicon_alone_is_sent_out(spark):
    terms = spark.range(4000).select(F.concat(F.lit("word"), "id").alias("term"))
    df = fe.match_lexicon(terms, lexicon_of(spark))
    sent = broadcast_rows(df)
    assert sent and max(sent) <= len(LEXICON)
    want = {f"word{i}": "longer" if f"word{i}".startswith("word12") else "many" for i in range(4000) if str(i).startswith("1")}
    assert {r["term"]: r["dim"] for r in df.collect()} == want


def test_one_sided_kl_keeps_the_null_dataset(spark):
    rows = [(d, t, a, b) for d in ("x", None) for t, a, b in (("u", 1, 4), ("v", 3, 3), ("w", 1, 4))]
    got = an.one_sided_kl(spark.createDataFrame(rows, "dataset string, term string, c0 long, c1 long")).collect()
    assert sorted((str(r["dataset"]), r["term"], r["rank"]) for r in got) == [(d, t, k) for d in ("None", "x") for t, k in (("u", 1.5), ("v", 3.0), ("w", 1.5))]


def test_transfer_features_send_out_the_lexicon_alone(spark):
    counts = spark.range(3000).select(F.lit("d").alias("domain"), (F.col("id") % 40).alias("source"), F.concat(F.lit("word"), "id").alias("term"), F.lit(1).cast("long").alias("n"))
    for norm in ("matched", "unmatched"):
        df = tr.transfer_features(counts, tr.domain_vocabularies(counts), lexicon_of(spark), norm)
        assert max(broadcast_rows(df)) <= len(LEXICON)


def test_average_ranks_never_send_out_their_table(spark):
    df = spark.range(3000).select(F.lit("d").alias("dataset"), "id", (F.col("id") % 5).alias("v"))
    assert max([0, *broadcast_rows(with_average_rank(df, "v", ["dataset"], "rank"))]) < 100


def test_negation_folds_as_text_and_token_by_token_alike(spark):
    draw = random.Random(3)
    pool = ["not", "NOT", "x", "knot", "not_", "a$1", "\\", "don't", "Can't", "cannot"]
    rows = [([draw.choice(pool) for _ in range(draw.randint(0, 9))],) for _ in range(500)] + [(["a\u0001b", "not", "c"],), (["not"] * 5,)]
    df = spark.createDataFrame(rows, "t array<string>")
    for flag in (False, True):
        assert not df.where(~tk.fold_negation(F.col("t"), flag).eqNullSafe(tk._folded_one_by_one(F.col("t"), flag))).collect()
    long = spark.range(1).select(F.array_repeat(F.lit("not"), 200_000).alias("t")).select(tk.fold_negation(F.concat("t", F.array(F.lit("x"))), False).alias("t"))
    assert [len(x) for x in long.first()["t"]] == [4 * 200_000 + 1]


def test_ngrams_are_put_together_behind_the_explosion(spark):
    rows = [("s", ["a", "f", "b", "c"]), ("s", ["f"]), ("t", []), ("t", None), ("t", ["a"])]
    df = spark.createDataFrame(rows, "source string, tokens array<string>")
    got = Vocabulary(ngram_range=(1, 2), flags=("f",)).occurrences(df).where("term is not null").collect()
    assert sorted(map(tuple, got)) == sorted([("s", "a"), ("s", "b"), ("s", "c"), ("s", "a b"), ("s", "b c"), ("s", "f"), ("s", "f"), ("t", "a")])
    got = Vocabulary(ngram_range=(2, 3)).occurrences(df).where("term is not null").collect()
    assert sorted(r["term"] for r in got) == ["a f", "a f b", "b c", "f b", "f b c"]


def test_counts_by_document_shuffle_texts_alone(spark):
    plan = QUERIES["unit_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Exchange hashpartitioning(source" in plan and "term" not in plan.split("hashpartitioning(")[1].split(")")[0]


def test_terms_join_alike_whether_sent_or_not(spark, monkeypatch):
    monkeypatch.setattr(fe, "MOST_SENT", 3)
    counts = spark.range(200).select((F.col("id") % 7).alias("source"), (F.col("id") % 23).cast("string").alias("term"), F.col("id").alias("n"))
    terms = spark.range(1, 20).select(F.col("id").cast("string").alias("term"), (F.col("id") % 4).alias("k"))
    df = fe.join_terms(counts, terms, "k")
    assert max(broadcast_rows(df)) == 3
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, counts.join(terms, "term").select(*df.columns).collect()))


def test_counts_that_are_read_again_are_made_once(spark):
    for name in ("feature_union", "lexicon_norm_unmatched", "kl_select_top", "naive_bayes_scores"):
        assert "documents.parquet" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString(), name


def test_tokens_are_made_of_kept_posts_only_and_once(spark):
    plan = QUERIES["load_posts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("NEGATE_FLAG>, namedlambda") + plan.count("array_repeat(<NEGATE_FLAG>") > 0
    lines = [line for line in plan.splitlines() if "array_repeat(<NEGATE_FLAG>" in line]
    assert len(lines) == 1 and plan.index("array_repeat(<NEGATE_FLAG>") < plan.index("Window")


def test_wide_logistic_regression_is_the_penalised_optimum(spark, monkeypatch):
    monkeypatch.setattr(wide, "_BLOCK", 40)
    monkeypatch.setattr(wide, "_CHUNK", 7)
    draw = np.random.default_rng(5)
    x = draw.poisson(0.3, (40, 60)) * 1.0
    y = (x[:, 0] + draw.normal(0, 0.5, 40) > 0.3).astype(int)
    values = spark.createDataFrame([(int(i), f"t{j}", float(x[i, j])) for i, j in np.argwhere(x)], "source long, term string, v double")
    model = wide.logistic(values, spark.createDataFrame(list(enumerate(y.tolist())), "source long, y int"), C=2.0, tol=1e-9)
    a, ridge, w = np.c_[x, np.ones(40)], np.diag([0.5] * 60 + [0.0]), np.zeros(61)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (p - y) + ridge @ w)
    got = {r["term"]: r["coef"] for r in model.coefs.collect()}
    assert np.allclose([got.get(f"t{j}", 0.0) for j in range(60)], w[:-1], atol=1e-4) and abs(model.intercept - w[-1]) < 1e-4
    one = wide.logistic(values, spark.createDataFrame([(1, 1)], "source long, y int"))
    assert [r["y_pred"] for r in one.predict(values, spark.createDataFrame([(2,)], "source long")).collect()] == [1.0]


def test_naive_bayes_of_folds_makes_no_vectors(spark):
    plan = QUERIES["cross_validation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan.upper() and "probability" not in plan


def test_labelled_vectors_pass_through_no_python(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a Python function a row")

    monkeypatch.setattr(F, "udf", refuse)
    rows = pt._labelled(spark, "/root/testdata/sf0.001").collect()
    assert rows and all((r["features"].toArray() >= 0).all() for r in rows) and len({r["features"].size for r in rows}) == 1


def test_labelled_documents_alone_are_dealt_and_counted_once(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, "a b a"), (2, "c"), (3, "never dealt")], "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    folds, counts = pt._folds_and_counts(spark, sf)
    assert folds.count() == 3 and {"label", "fold"} <= set(counts.columns)
    assert sorted(tuple(r) for r in counts.select("source", "term", "n").collect()) == [(1, "a", 2), (1, "b", 1), (2, "c", 1)]
    assert pt._labelled(spark, sf).where("source = 1").count() == 2


def test_naive_bayes_groups_a_terms_counts_once(spark):
    counts = spark.createDataFrame([(s, s % 2, s % 3 + 1, t, 1 + s % 2) for s in range(12) for t in ("x", f"y{s % 5}")], "source long, label int, fold int, term string, n long")
    folds = counts.select("source", "label", "fold").distinct()
    every = {(r["fold"], r["source"]): r["y_pred"] for r in mo.naive_bayes_probabilities(counts, folds, 6).collect()}
    part = {(r["fold"], r["source"]): r["y_pred"] for r in mo.naive_bayes_probabilities(counts, folds, 6, held=2).collect()}
    assert len(every) == 12 and len(part) == 4 and all(abs(every[k] - p) < 1e-12 for k, p in part.items())


def test_pooling_explodes_blocks_of_ragged_vectors_not_components(spark):
    draw = random.Random(9)
    vectors = {k: [draw.choice([None, draw.uniform(-1, 1), draw.uniform(-1, 1)]) for _ in range(size)] for k, size in enumerate((0, 1, 31, 32, 33, 64, 65))} | {7: None}
    counts = [(s, k, s + k + 1) for s in range(6) for k in range(11) if (s * k) % 3 != 1]
    e = spark.createDataFrame(list(vectors.items()), "key long, vector array<float>")
    c = spark.createDataFrame(counts, "source long, key long, n long")
    for how in ("mean", "extremum"):
        df = fe.pool_embeddings(c, e, how)
        want = {}
        for s in range(6):
            zero = [0.0] if any(t == s and k not in vectors for t, k, _ in counts) else []
            for d in range(65):
                held = [(n, vectors[k][d]) for t, k, n in counts if t == s and len(vectors.get(k) or []) > d]
                there = [(n, float(np.float32(x))) for n, x in held if x is not None]
                if not held:
                    continue
                if how == "mean":
                    want[s, d] = sum(n * x for n, x in there) / sum(n for n, _ in held) if there else None
                else:
                    ends = [x for _, x in there] + zero
                    want[s, d] = (min(ends) if -min(ends) > max(ends) else max(ends)) if ends else None
        got = {(r["source"], r["dim"]): r["value"] for r in df.collect()}
        assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)
        assert "HashAggregate(keys=[source#" in (plan := df._jdf.queryExecution().executedPlan().toString()) and "_b#" in plan and not re.search(r"keys=\[source#\d+L?, dim#", plan)


def test_pooling_tasks_hold_one_group_of_sources_and_one_of_vectors(spark, monkeypatch):
    c = spark.range(6000).select((F.col("id") % 300).alias("source"), (F.col("id") * 7 % 101).alias("key"), (F.col("id") % 3 + 1).alias("n"))
    e = spark.range(100).select(F.col("id").cast("int").alias("key"), F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.sin(i * F.col("id")).cast("float")).alias("vector"))
    results = lambda how: {(r["source"], r["dim"]): r["value"] for r in fe.pool_embeddings(c, e, how).collect()}
    whole = {how: results(how) for how in ("mean", "extremum")}
    monkeypatch.setattr(fe, "MOST_HELD", 40 * 50)
    tasks = fe.meet_vectors(c, e, 40, 40).groupBy(F.spark_partition_id()).agg(F.countDistinct("source"), F.countDistinct("key"), F.count("*")).collect()
    assert len(tasks) == 12 and max(t[1] for t in tasks) < 100 and max(t[2] for t in tasks) < 80 and sum(t[3] for t in tasks) == c.join(e, "key").count()
    for how, want in whole.items():
        got = results(how)
        assert len(want) == 300 * 40 and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_pooling_vectors_of_one_length_keeps_one_weight_a_row(spark, monkeypatch):
    monkeypatch.setattr(fe, "POOLED", 4)
    c, e = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "source long, key long, n long"), spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64), (3, [])], "key long, vector array<float>")
    df = fe.pool_embeddings(c, e)
    partial = re.search(r"functions=\[partial_[^\n]*", df._jdf.queryExecution().executedPlan().toString())[0]
    assert partial.count("partial_sum(") == 5 and [round(r["value"], 9) for r in df.collect()] == [1.6] * 64


def test_events_of_large_splits_are_dealt_before_they_are_counted(spark, monkeypatch):
    sf, name = "/root/testdata/sf0.001", "embedding_mean_pool"
    dealt = lambda: "REPARTITION_BY_NUM" in pf._event_counts(spark, sf)[0]._jdf.queryExecution().executedPlan().toString()
    assert not dealt()
    whole = QUERIES[name](spark, sf)
    monkeypatch.setattr(pf, "MOST_EVENTS", 300)
    parts = QUERIES[name](spark, sf)
    assert dealt() and not parts.exceptAll(whole).count() and not whole.exceptAll(parts).count()


def test_texts_of_large_splits_are_dealt_before_their_ngrams_are_counted(spark, monkeypatch):
    sf, name = "/root/testdata/sf0.001", "bigram_counts"
    dealt = lambda df: len(re.findall(r"Exchange hashpartitioning\(doc_id", df._jdf.queryExecution().executedPlan().toString()))
    whole = QUERIES[name](spark, sf)
    assert dealt(whole) == 0
    monkeypatch.setattr(common, "MOST_CHARS", 20_000)
    parts = QUERIES[name](spark, sf)
    assert dealt(parts) == 1 and not parts.exceptAll(whole).count() and not whole.exceptAll(parts).count()
