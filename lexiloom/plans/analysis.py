"""Queries: comparisons of classes, datasets and experiments."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import analysis as an
from ..operators import sampling as sm
from ..operators.vocabulary import Vocabulary
from ..sources.scratch import stash
from .common import PRED, TOK, corpus, predictions, query, rounded, table

BY_LANG = f"""WITH {TOK}, t AS (SELECT DISTINCT doc_id, lang, term FROM w),
c AS (SELECT t.lang AS dataset, term, count(*) FILTER (toxic = 0) AS c0, count(*) FILTER (toxic = 1) AS c1 FROM t JOIN labels l ON t.doc_id = l.doc_id GROUP BY ALL)"""


def _by_lang(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    t = Vocabulary().counts(corpus(spark, sf, "doc_id")).select(F.col("source").alias("doc_id"), "term")
    return t.join(d, "doc_id").groupBy(F.col("lang").alias("dataset"), "term").agg(F.count_if(F.col("toxic") == 0).alias("c0"), F.count_if(F.col("toxic") == 1).alias("c1"))


@query("one_sided_kl", BY_LANG + """, p AS (SELECT dataset, term, c0 + c1 AS df, (c0 + 0.01::DOUBLE) / sum(c0 + 0.01::DOUBLE) OVER (PARTITION BY dataset) AS p0, (c1 + 0.01::DOUBLE) / sum(c1 + 0.01::DOUBLE) OVER (PARTITION BY dataset) AS p1 FROM c)
SELECT dataset, term, df, round(p1 * ln(p1 / p0), 7) AS score FROM p""")  # fmt: skip
def one_sided_kl(spark, sf):
    return rounded(an.one_sided_kl(stash(_by_lang(spark, sf), "counts")), "score", digits=7).drop("rank")


@query("representative_terms", BY_LANG + """, s AS (SELECT dataset, term, c0 + c1 AS df, round(c1::DOUBLE / (c0 + c1 + 1), 6) AS score FROM c)
SELECT dataset, term, df, score, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, term)::INTEGER AS place FROM s WHERE df >= 5 QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score DESC, term) <= 20""")  # fmt: skip
def representative_terms(spark, sf):
    s = _by_lang(spark, sf).select("dataset", "term", (F.col("c0") + F.col("c1")).alias("df"), F.round(F.col("c1") / (F.col("c0") + F.col("c1") + 1), 6).alias("score"))
    return an.representatives(s, "dataset", 5, 20)


@query("ratio_correlation", BY_LANG + """, r AS (SELECT dataset, term, ln((c1 + 1.0::DOUBLE) / (c0 + 1.0::DOUBLE)) AS v FROM c)
SELECT a.dataset AS a, b.dataset AS b, round(corr(a.v, b.v), 5) AS pearson FROM r a JOIN r b ON a.term = b.term GROUP BY ALL""")  # fmt: skip
def ratio_correlation(spark, sf):
    r = _by_lang(spark, sf).select("dataset", "term", F.log((F.col("c1") + 1.0) / (F.col("c0") + 1.0)).alias("value"))
    return rounded(an.pairwise_correlation(r), "pearson", digits=5)


@query("combined_vocabulary", f"WITH {TOK}, c AS (SELECT lang, term, count(*) AS n FROM w WHERE lang IS NOT NULL GROUP BY ALL) SELECT term, sum(n)::BIGINT AS n FROM c GROUP BY term")
def combined_vocabulary(spark, sf):
    return an.combined_counts(Vocabulary().counts(corpus(spark, sf, "lang").where("source is not null")).select("term", "n"))


@query("score_pivot", f"WITH {PRED} SELECT grp, round(avg(y_pred) FILTER (y_true = 0), 6) AS \"0\", round(avg(y_pred) FILTER (y_true = 1), 6) AS \"1\" FROM pred GROUP BY grp")
def score_pivot(spark, sf):
    return rounded(an.pivot_scores(predictions(spark, sf), ["grp"], "y_true", "y_pred", values=[0, 1]), "0", "1")


@query("top_and_bottom", f"WITH {PRED} (SELECT doc_id, y_pred FROM pred ORDER BY y_pred DESC, doc_id LIMIT 10) UNION (SELECT doc_id, y_pred FROM pred ORDER BY y_pred, doc_id LIMIT 10)")
def top_and_bottom(spark, sf):
    return an.top_and_bottom(predictions(spark, sf).select("doc_id", "y_pred"), "y_pred", "doc_id", 10)


@query("median_support", """WITH s AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT event_type, median(n) AS m FROM s GROUP BY event_type) SELECT s.event_type, user_id, n FROM s JOIN m ON s.event_type = m.event_type WHERE n >= m""")
def median_support(spark, sf):
    s = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return an.median_support(s, ["event_type"], "n")


@query("class_ids", "SELECT doc_id, dense_rank() OVER (ORDER BY lang, source)::INTEGER - 1 AS class_id FROM documents")
def class_ids(spark, sf):
    return an.class_ids(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"]).select("doc_id", "class_id")


@query("label_expansion", "SELECT doc_id, CASE WHEN toxic = 0 THEN 'control' WHEN toxic = 1 THEN 'toxic' END AS toxic, CASE WHEN toxic = 0 THEN 'control' WHEN quality = 0 THEN 'low' END AS low FROM labels")
def label_expansion(spark, sf):
    marks = F.array_compact(F.array(F.when(F.col("toxic") == 0, "control"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "low")))
    users = table(spark, sf, "labels").select("doc_id", marks.alias("labels"))
    return sm.expand_labels(users, "labels", ["toxic", "low"]).select("doc_id", "toxic", "low")


def _poisson(share: float = 0.7) -> list[float]:
    """Distribution function of a Poisson variable up to where it reaches 1."""
    p, below = math.exp(-share), [math.exp(-share)]
    while below[-1] < 1.0 - 1e-12:
        p *= share / len(below)
        below.append(below[-1] + p)
    return below


@query("bootstrap_difference", f"""WITH {PRED}, u AS (SELECT grp, y_true, y_pred, i, ('0x' || substr(md5('42_' || i || '_' || doc_id), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM pred, range(1, 101) r(i)),
c AS (SELECT grp, y_true, y_pred, i, {" + ".join(f"CASE WHEN u >= {b!r}::DOUBLE THEN 1 ELSE 0 END" for b in _poisson())} AS n FROM u),
m AS (SELECT grp, i, y_true, sum(y_pred * n) / nullif(sum(n), 0) AS m FROM c GROUP BY ALL),
d AS (SELECT grp, i, max(m) FILTER (y_true = 1) - max(m) FILTER (y_true = 0) AS d FROM m GROUP BY ALL)
SELECT grp, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.975), 6) AS high FROM d GROUP BY grp""")  # fmt: skip
def bootstrap_difference(spark, sf):
    p = predictions(spark, sf).withColumnRenamed("y_true", "y")
    return rounded(an.bootstrap_difference(p, "y_pred", "y", "doc_id", by=["grp"]), "low", "median", "high")


@query("aligned_periods", """WITH s AS (SELECT (user_id % 3)::INTEGER AS train, (event_id % 3)::INTEGER AS test, round(avg(value), 6) AS score FROM events GROUP BY ALL)
SELECT test - train AS lag, count(*) AS n, round(avg(score), 5) AS mean FROM s GROUP BY ALL""")  # fmt: skip
def aligned_periods(spark, sf):
    s = table(spark, sf, "events").groupBy((F.col("user_id") % 3).cast("int").alias("train"), (F.col("event_id") % 3).cast("int").alias("test")).agg(F.round(F.avg("value"), 6).alias("score"))
    return an.lag_periods(s, "train", "test").groupBy("lag").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean"))
