"""Queries: features and feature selection."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import selection as fs
from ..operators.vocabulary import Vocabulary
from ..sources.scratch import stash
from .common import DTM, TOK, corpus, query, rounded, table, toxic_labels

STOPWORDS = ["the", "of", "and", "die", "der", "la", "de"]


def _dtm(spark, sf, least: int = 1):
    c = Vocabulary().counts(corpus(spark, sf, "doc_id"))
    if least > 1:
        c = c.join(c.groupBy("term").agg(F.count("*").alias("df")).where(f"df >= {least}").select("term"), "term", "left_semi")
    return c


def _labelled_dtm(spark, sf):
    """Counts of the labelled documents, which alone reach comparisons of classes."""
    return Vocabulary().counts(corpus(spark, sf, "doc_id").join(toxic_labels(spark, sf).select("source"), "source", "left_semi"))


@query("tfidf_l2", f"""WITH {DTM}, k AS (SELECT term, count(*) AS df FROM dtm GROUP BY term HAVING count(*) >= 5),
r AS (SELECT source, d.term, n * (ln((1.0::DOUBLE + (SELECT count(DISTINCT source) FROM dtm)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS v FROM dtm d JOIN k ON d.term = k.term)
SELECT source, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY source)), 6) AS value FROM r""")  # fmt: skip
def tfidf_l2(spark, sf):
    dtm = stash(_dtm(spark, sf), "dtm")
    docs = dtm.agg(F.countDistinct("source").alias("_docs"))
    frequent = dtm.groupBy("term").agg(F.count("*").alias("_df")).where("_df >= 5")
    return rounded(fe.tfidf(dtm, docs, "term", frequent), "value")


PMI = f"""WITH {DTM}, c AS (SELECT term, y, count(*) AS n FROM dtm JOIN lab ON dtm.source = lab.source GROUP BY ALL),
g AS (SELECT t.term, k.y, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT term FROM c) t CROSS JOIN (SELECT DISTINCT y FROM lab) k LEFT JOIN c ON c.term = t.term AND c.y = k.y),
s AS (SELECT count(DISTINCT term)::DOUBLE AS v, sum(n)::DOUBLE AS total FROM g),
p AS (SELECT term, g.y, n, log2(((n + 1.0::DOUBLE) / (sum(n) OVER (PARTITION BY g.y) + v)) / ((sum(n) OVER (PARTITION BY term) + 1.0::DOUBLE) / (total + v))) AS pmi FROM g, s)"""


@query("pmi_scores", PMI + " SELECT term, y, n, round(pmi, 6) AS pmi FROM p")
def pmi_scores(spark, sf):
    return rounded(fs.pmi(_labelled_dtm(spark, sf), toxic_labels(spark, sf)), "pmi")


@query("pmi_top_k", PMI + " SELECT term, y, n, round(pmi, 6) AS pmi FROM p WHERE y = 1 AND n >= 3 ORDER BY round(p.pmi, 6) DESC, term LIMIT 50")
def pmi_top_k(spark, sf):
    return fs.pmi_top_k(rounded(fs.pmi(_labelled_dtm(spark, sf), toxic_labels(spark, sf)), "pmi"), 50, min_support=3)


KL = f"""WITH {DTM}, c AS (SELECT term, y, count(*) AS n FROM dtm JOIN lab ON dtm.source = lab.source GROUP BY ALL),
g AS (SELECT t.term, k.y, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT term FROM c) t CROSS JOIN (SELECT DISTINCT y FROM lab) k LEFT JOIN c ON c.term = t.term AND c.y = k.y),
p AS (SELECT term, y, n, (n + 0.01::DOUBLE) / sum(n + 0.01::DOUBLE) OVER (PARTITION BY term) AS p, sum(n) OVER (PARTITION BY term) AS df FROM g),
s AS (SELECT term AS s, y, p AS q, (df + 0.01::DOUBLE) / sum(df + 0.01::DOUBLE) OVER (PARTITION BY y) AS w FROM p WHERE term IN ('the', 'of', 'and', 'die', 'der', 'la', 'de')),
k AS (SELECT term, sum(w * (p * ln(p / q) + q * ln(q / p))) AS divergence, max(df) AS df FROM p JOIN s ON p.y = s.y GROUP BY term)"""


@query("kl_scores", KL + " SELECT term, df::BIGINT AS df, round(divergence, 6) AS divergence FROM k")
def kl_scores(spark, sf):
    return rounded(fs.kl_scores(_labelled_dtm(spark, sf), toxic_labels(spark, sf), STOPWORDS), "divergence").select("term", "df", "divergence")


@query("kl_select_top", KL + """, r AS (SELECT term, df, divergence, 0.5::DOUBLE * (row_number() OVER (ORDER BY round(divergence, 9) DESC, term) - 1) + 0.5::DOUBLE * (row_number() OVER (ORDER BY df DESC, term) - 1) AS rank FROM k)
SELECT term, df::BIGINT AS df, rank FROM r WHERE df >= 2 ORDER BY rank, term LIMIT 100""")  # fmt: skip
def kl_select_top(spark, sf):
    return fs.select_top(fs.mixed_rank(fs.kl_scores(_labelled_dtm(spark, sf), toxic_labels(spark, sf), STOPWORDS)), 100, 2).select("term", "df", "rank")


RATIO = f"""WITH {DTM}, z AS (SELECT count(*) FILTER (y = 0)::DOUBLE AS n0, count(*) FILTER (y = 1)::DOUBLE AS n1 FROM lab),
c AS (SELECT term, count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM dtm JOIN lab ON dtm.source = lab.source GROUP BY term),
r AS (SELECT term, c0, c1, c0 / n0 AS p0, c1 / n1 AS p1, (c0 + c1) / (n0 + n1) AS p FROM c, z)"""


@query("class_log_ratio", RATIO + " SELECT term, c0, c1, round(p0, 6) AS p0, round(p1, 6) AS p1, round(ln((p1 + 1e-10::DOUBLE) / (p0 + 1e-10::DOUBLE)), 6) AS log_ratio FROM r")
def class_log_ratio(spark, sf):
    return rounded(fs.class_log_ratio(_labelled_dtm(spark, sf), toxic_labels(spark, sf)), "p0", "p1", "log_ratio").select("term", "c0", "c1", "p0", "p1", "log_ratio")


@query("weighted_log_ratio", RATIO + " SELECT term, round(p * ln((p1 + 1e-10::DOUBLE) / (p0 + 1e-10::DOUBLE)), 6) AS weighted_log_ratio, round(ln((p1 + 1e-10::DOUBLE) / (p + 1e-10::DOUBLE)), 6) AS pmi FROM r")
def weighted_log_ratio(spark, sf):
    return rounded(fs.class_log_ratio(_labelled_dtm(spark, sf), toxic_labels(spark, sf)), "weighted_log_ratio", "pmi").select("term", "weighted_log_ratio", "pmi")


POOL = "WITH c AS (SELECT user_id AS source, event_id % (SELECT count(*) FROM embeddings) AS key, count(*) AS n FROM events GROUP BY ALL), x AS (SELECT source, n, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM c JOIN embeddings ON key = vec_id)"


#: Events that one task counts: a task's table holds a row for nearly each of them.
MOST_EVENTS = 500_000


def _event_counts(spark, sf):
    """Counts of events and vectors; where splits of the files are large, events are dealt to more tasks before they are counted."""
    size = F.broadcast(table(spark, sf, "embeddings").agg(F.count("*").alias("size")))
    events = table(spark, sf, "events").select("user_id", "event_id")
    e = events.crossJoin(size).select(F.col("user_id").alias("source"), (F.col("event_id") % F.col("size")).alias("key"))
    parts = -(-events.count() // MOST_EVENTS)
    if parts > events.rdd.getNumPartitions():
        e = e.repartition(parts, "source", "key")
    return e.groupBy("source", "key").agg(F.count("*").alias("n")), table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))


@query("embedding_mean_pool", POOL + " SELECT source, dim::INTEGER AS dim, round(sum(n * x::DOUBLE) / sum(n), 5) AS value FROM x GROUP BY ALL")
def embedding_mean_pool(spark, sf):
    return rounded(fe.pool_embeddings(*_event_counts(spark, sf), "mean"), "value", digits=5)


@query("embedding_extremum_pool", POOL + """, z AS (SELECT source, max(CASE WHEN vec_id IS NULL THEN 0.0::DOUBLE END) AS zero FROM c LEFT JOIN embeddings ON key = vec_id GROUP BY source),
e AS (SELECT x.source, dim, least(min(x::DOUBLE), any_value(zero)) AS lo, greatest(max(x::DOUBLE), any_value(zero)) AS hi FROM x JOIN z ON x.source = z.source GROUP BY ALL)
SELECT source, dim::INTEGER AS dim, round(CASE WHEN -lo > hi THEN lo ELSE hi END, 6) AS value FROM e""")  # fmt: skip
def embedding_extremum_pool(spark, sf):
    return rounded(fe.pool_embeddings(*_event_counts(spark, sf), "extremum"), "value")


LEX = [("the", False, "function"), ("un", True, "negative"), ("ver", True, "prefix"), ("verb", True, "longer"), ("qu", True, "question"), ("and", False, "join"), ("an", True, "article"), ("der", False, "function")]
LEX_SQL = f"""WITH {TOK}, lex(entry, is_prefix, dim) AS (VALUES ('the', false, 'function'), ('un', true, 'negative'), ('ver', true, 'prefix'), ('verb', true, 'longer'), ('qu', true, 'question'), ('and', false, 'join'), ('an', true, 'article'), ('der', false, 'function')),
c AS (SELECT source, term, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT DISTINCT term FROM c),
m AS (SELECT term, dim FROM t JOIN lex ON NOT is_prefix AND term = entry UNION
  SELECT term, arg_max(dim, length(entry)) FROM t JOIN lex ON is_prefix AND starts_with(term, entry) WHERE term NOT IN (SELECT entry FROM lex WHERE NOT is_prefix) GROUP BY term),
s AS (SELECT source, dim, sum(n)::DOUBLE AS value FROM c JOIN m ON c.term = m.term GROUP BY ALL)"""


def _lexicon(spark, sf, norm):
    lexicon = spark.createDataFrame(LEX, "entry string, is_prefix boolean, dim string")
    return rounded(fe.lexicon_features(stash(Vocabulary().counts(corpus(spark, sf)), "counts"), lexicon, norm), "value")


for _norm, _sql in {
    None: "SELECT source, dim, value FROM s",
    "matched": "SELECT source, dim, round(value / (SELECT sum(n) FROM c WHERE c.source = s.source AND term IN (SELECT term FROM m)), 6) AS value FROM s",
    "unmatched": "SELECT source, dim, round(value / (SELECT sum(n) FROM c WHERE c.source = s.source), 6) AS value FROM s",
    "max": "SELECT source, dim, round(value / max(value) OVER (PARTITION BY source), 6) AS value FROM s",
    "l1": "SELECT source, dim, round(value / sum(value) OVER (PARTITION BY source), 6) AS value FROM s",
    "l2": "SELECT source, dim, round(value / sqrt(sum(value * value) OVER (PARTITION BY source)), 6) AS value FROM s",
}.items():
    query(f"lexicon_norm_{_norm}" if _norm else "lexicon_counts", f"{LEX_SQL} {_sql}")(lambda spark, sf, norm=_norm: _lexicon(spark, sf, norm))


@query("standardize", f"""{LEX_SQL}, q AS (SELECT dim, avg(value) AS m, stddev_pop(value) AS d FROM s GROUP BY dim)
SELECT source, s.dim, round((value - m) / CASE WHEN d > 0 THEN d ELSE 1 END, 6) AS value FROM s JOIN q ON s.dim = q.dim""")  # fmt: skip
def standardize(spark, sf):
    lexicon = spark.createDataFrame(LEX, "entry string, is_prefix boolean, dim string")
    return rounded(fe.standardize(fe.lexicon_features(Vocabulary().counts(corpus(spark, sf)), lexicon)), "value")


@query("feature_union", f"""{LEX_SQL} SELECT 'bag_of_words' AS feature_set, source, term AS name, n::DOUBLE AS value FROM c UNION ALL SELECT 'liwc', source, dim, value FROM s""")
def feature_union(spark, sf):
    counts = stash(Vocabulary().counts(corpus(spark, sf)), "counts")
    lexicon = spark.createDataFrame(LEX, "entry string, is_prefix boolean, dim string")
    return fe.union_features(liwc=fe.lexicon_features(counts, lexicon).withColumnRenamed("dim", "name"), bag_of_words=counts.select("source", F.col("term").alias("name"), F.col("n").alias("value")))


@query("cosine_similarity", f"""{LEX_SQL}, u AS (SELECT source, dim, value / sqrt(sum(value * value) OVER (PARTITION BY source)) AS v FROM s)
SELECT a.source AS a, b.source AS b, round(sum(a.v * b.v), 6) AS cosine FROM u a JOIN u b ON a.dim = b.dim GROUP BY ALL""")  # fmt: skip
def cosine_similarity(spark, sf):
    """All sources against all, a stated small set of groups; only shared dimensions meet."""
    lexicon = spark.createDataFrame(LEX, "entry string, is_prefix boolean, dim string")
    return rounded(fe.cosine_between(fe.lexicon_features(Vocabulary().counts(corpus(spark, sf)), lexicon).withColumnRenamed("dim", "name")), "cosine")


@query("naive_bayes_scores", f"""WITH {DTM}, t AS (SELECT term, y, sum(n)::DOUBLE AS n FROM dtm JOIN lab ON dtm.source = lab.source GROUP BY ALL),
g AS (SELECT v.term, k.y, coalesce(t.n, 0) AS n FROM (SELECT DISTINCT term FROM t) v CROSS JOIN (SELECT DISTINCT y FROM lab) k LEFT JOIN t ON t.term = v.term AND t.y = k.y),
l AS (SELECT term, y, ln((n + 1.0::DOUBLE) / (sum(n) OVER (PARTITION BY y) + count(*) OVER (PARTITION BY y))) AS lp FROM g),
o AS (SELECT term, max(lp) FILTER (y = 1) - max(lp) FILTER (y = 0) AS d FROM l GROUP BY term),
pr AS (SELECT ln(count(*) FILTER (y = 1)::DOUBLE / count(*) FILTER (y = 0)) AS prior FROM lab)
SELECT source, round(any_value(prior) + sum(n * d), 4) AS log_odds FROM dtm JOIN o ON dtm.term = o.term, pr GROUP BY source""")  # fmt: skip
def naive_bayes_scores(spark, sf):
    from ..operators.models import naive_bayes_log_odds

    dtm = stash(_dtm(spark, sf), "dtm")
    return rounded(naive_bayes_log_odds(dtm, toxic_labels(spark, sf), dtm), "log_odds", digits=4)



