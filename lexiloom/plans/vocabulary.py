"""Queries: term counts, vocabularies, document-term tables and set comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import analysis as an
from ..operators import vocabulary as vo
from ..operators.ranking import position
from ..operators.sets import set_pairs
from ..sources import readers
from .common import TOK, corpus, dealt_corpus, query, rounded, table


@query("token_counts", f"WITH {TOK} SELECT source, term, count(*) AS n FROM w GROUP BY ALL")
def token_counts(spark, sf):
    return vo.Vocabulary().counts(corpus(spark, sf))


@query("token_counts_binarized", f"WITH {TOK} SELECT term, count(DISTINCT source) AS n FROM w GROUP BY ALL")
def token_counts_binarized(spark, sf):
    return vo.Vocabulary().counts(corpus(spark, sf), binarize=True).groupBy("term").agg(F.sum("n").alias("n"))


@query("bigram_counts", f"""WITH {TOK}, b AS (SELECT source, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS term FROM tok)
SELECT source, term, count(*) AS n FROM b GROUP BY ALL""")  # fmt: skip
def bigram_counts(spark, sf):
    return vo.Vocabulary(ngram_range=(2, 2)).counts(dealt_corpus(spark, sf))


@query("ngrams_with_flags", f"""WITH {TOK},
f AS (SELECT source, list_filter(tokens, lambda t: NOT list_contains(['the', 'und'], t)) AS p, list_filter(tokens, lambda t: list_contains(['the', 'und'], t)) AS k FROM tok),
g AS (SELECT source, unnest(p) AS term FROM f UNION ALL SELECT source, unnest(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1])) FROM f UNION ALL SELECT source, unnest(k) FROM f)
SELECT source, term, count(*) AS n FROM g GROUP BY ALL""")  # fmt: skip
def ngrams_with_flags(spark, sf):
    return vo.Vocabulary(ngram_range=(1, 2), flags=("the", "und")).counts(dealt_corpus(spark, sf))


@query("vocab_top_k", f"WITH {TOK} SELECT term, count(*) AS n FROM w GROUP BY ALL ORDER BY n DESC, term LIMIT 100")
def vocab_top_k(spark, sf):
    total = vo.Vocabulary().counts(corpus(spark, sf)).groupBy("term").agg(F.sum("n").alias("n"))
    return total.orderBy(F.desc("n"), "term").limit(100)


@query("vocab_threshold_index", f"""WITH {TOK}, c AS (SELECT term, count(DISTINCT source) AS n FROM w GROUP BY ALL HAVING count(DISTINCT source) BETWEEN 2 AND 15)
SELECT term, n, row_number() OVER (ORDER BY term) - 1 AS idx FROM c""")  # fmt: skip
def vocab_threshold_index(spark, sf):
    return vo.Vocabulary(min_freq=2, max_freq=15).fit(corpus(spark, sf))


@query("vocab_protected", f"""WITH {TOK}, c AS (SELECT term, count(DISTINCT source) AS n FROM w GROUP BY ALL),
k AS (SELECT * FROM c WHERE term IN ('the', 'zzzabsent') OR n BETWEEN 2 AND 10),
a AS (SELECT * FROM k UNION ALL SELECT t, 1 FROM (VALUES ('the'), ('zzzabsent')) x(t) WHERE t NOT IN (SELECT term FROM k))
SELECT term, n::BIGINT AS n, row_number() OVER (ORDER BY term) - 1 AS idx FROM a""")  # fmt: skip
def vocab_protected(spark, sf):
    return vo.Vocabulary(min_freq=2, max_freq=10, protected=("the", "zzzabsent")).fit(corpus(spark, sf))


@query("dtm_long", f"""WITH {TOK}, v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT term FROM w GROUP BY ALL HAVING count(DISTINCT source) >= 10))
SELECT source, idx, count(*) AS n FROM w JOIN v ON w.term = v.term GROUP BY ALL""")  # fmt: skip
def dtm_long(spark, sf):
    c = corpus(spark, sf)
    vocab = vo.Vocabulary(min_freq=10)
    return vo.vectorize(vocab.counts(c), vocab.fit(c))


@query("oov_hit_rate", f"""WITH {TOK}, v AS (SELECT term FROM w GROUP BY ALL HAVING count(DISTINCT source) >= 10)
SELECT source, count(*) AS n_tokens, round(count(*) FILTER (term IN (SELECT term FROM v))::DOUBLE / count(*), 6) AS hit_rate FROM w GROUP BY ALL""")  # fmt: skip
def oov_hit_rate(spark, sf):
    vocab = vo.Vocabulary(min_freq=10)
    counts = vocab.counts(corpus(spark, sf))
    rate = an.hit_rate(counts, vocab.fit_counts(counts)).withColumnRenamed("rate", "hit_rate")
    return rounded(counts.groupBy("source").agg(F.sum("n").alias("n_tokens")).join(rate, "source"), "hit_rate")


@query("null_feature_users", f"""WITH {TOK} SELECT doc_id AS source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM w WHERE term IN ('the', 'der', 'la'))""")
def null_feature_users(spark, sf):
    c = corpus(spark, sf, "doc_id")
    vocab = vo.assign(spark.createDataFrame([("the",), ("der",), ("la",)], "term string"))
    return vo.without_terms(c, vo.vectorize(vo.Vocabulary().counts(c), vocab))


@query("min_word_users", """SELECT source, sum(len(string_split_regex(trim(text), '\\s+'))) AS n_words FROM documents GROUP BY source HAVING sum(len(string_split_regex(trim(text), '\\s+'))) >= 10000""")
def min_word_users(spark, sf):
    comments = table(spark, sf, "documents").select(F.col("source").alias("author"), F.col("text").alias("body"))
    none = comments.select("author", F.lit(None).cast("string").alias("title"), F.col("body").alias("selftext")).where("false")
    return readers.min_words(comments, none, 10_000).withColumnRenamed("author", "source")


@query("label_vector", """SELECT d.doc_id AS source, CASE WHEN l.toxic = 1 THEN 1 WHEN l.toxic = 0 THEN 0 ELSE -1 END AS y FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def label_vector(spark, sf):
    names = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "control").alias("label"))
    users = table(spark, sf, "documents").select("doc_id").join(names, "doc_id", "left")
    return vo.label_vector(users, "label", "toxic").select(F.col("doc_id").alias("source"), "y")


PAIRS = f"WITH {TOK}, s AS (SELECT DISTINCT lang, term FROM w), z AS (SELECT lang, count(*) AS n FROM s GROUP BY ALL), i AS (SELECT a.lang AS a, b.lang AS b, count(*) AS n_both FROM s a JOIN s b ON a.term = b.term GROUP BY ALL)"


def _pairs(spark, sf):
    terms = table(spark, sf, "documents").select(F.col("lang").alias("dataset"), F.explode(words(F.col("text"))).alias("term"), F.lit(1).alias("n"))
    return set_pairs(terms).where("n_both > 0")


@query("jaccard_matrix", PAIRS + " SELECT a, b, n_both, round(n_both::DOUBLE / (x.n + y.n - n_both), 6) AS jaccard FROM i JOIN z x ON a = x.lang JOIN z y ON b = y.lang")
def jaccard_matrix(spark, sf):
    return rounded(_pairs(spark, sf).select("a", "b", "n_both", "jaccard"), "jaccard")


@query("overlap_matrix", PAIRS + " SELECT a, b, x.n AS size_a, round(n_both::DOUBLE / x.n, 6) AS overlap FROM i JOIN z x ON a = x.lang")
def overlap_matrix(spark, sf):
    return rounded(_pairs(spark, sf).select("a", "b", "size_a", "overlap"), "overlap")


@query("jaccard_by_threshold", f"""WITH {TOK}, c AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w WHERE lang IS NOT NULL GROUP BY ALL HAVING count(*) > 10),
s AS (SELECT t::INTEGER AS threshold, lang, term FROM c, range(10, 21) r(t) WHERE n > t), z AS (SELECT threshold, lang, count(*) AS n FROM s GROUP BY ALL),
i AS (SELECT x.threshold, x.lang AS a, y.lang AS b, count(*) AS k FROM s x JOIN s y ON x.threshold = y.threshold AND x.term = y.term GROUP BY ALL)
SELECT x.threshold, x.lang AS a, y.lang AS b, x.n AS size_a, y.n AS size_b, coalesce(k, 0) AS n_both, x.n + y.n - coalesce(k, 0) AS n_either, round(coalesce(k, 0)::DOUBLE / (x.n + y.n - coalesce(k, 0)), 6) AS jaccard, round(coalesce(k, 0)::DOUBLE / x.n, 6) AS overlap
FROM z x JOIN z y ON x.threshold = y.threshold LEFT JOIN i ON i.threshold = x.threshold AND i.a = x.lang AND i.b = y.lang""")  # fmt: skip
def jaccard_by_threshold(spark, sf):
    counts = vo.Vocabulary().counts(corpus(spark, sf, "lang")).withColumnRenamed("source", "dataset")
    return rounded(set_pairs(counts, tuple(range(10, 21))), "jaccard", "overlap")


@query("vocab_survival_curve", f"""WITH {TOK}, c AS (SELECT count(*) AS f FROM w GROUP BY term), g AS (SELECT f, count(*) AS k FROM c GROUP BY f)
SELECT f AS frequency, sum(k) OVER (ORDER BY f DESC)::BIGINT AS n_terms FROM g""")  # fmt: skip
def vocab_survival_curve(spark, sf):
    c = vo.Vocabulary().counts(corpus(spark, sf)).groupBy("term").agg(F.sum("n").alias("frequency"))
    g = c.groupBy("frequency").agg(F.count("*").alias("k"))  # distinct frequencies, few
    w = Window.orderBy(F.desc("frequency")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.select("frequency", F.sum("k").over(w).alias("n_terms"))


@query("rank_overlap_at_k", f"""WITH {TOK}, c AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT term, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS r FROM c),
m AS (SELECT term, max(r) AS worst FROM r GROUP BY term HAVING count(*) = (SELECT count(DISTINCT lang) FROM documents))
SELECT k::INTEGER AS k, count(*) FILTER (worst <= k) AS n_common FROM m, range(100, 1001, 100) x(k) GROUP BY k""")  # fmt: skip
def rank_overlap_at_k(spark, sf):
    c = vo.Vocabulary().counts(corpus(spark, sf, "lang"))
    langs = F.broadcast(table(spark, sf, "documents").agg(F.countDistinct("lang").alias("langs")))
    top = c.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "term"))).where("r <= 1000")
    m = top.groupBy("term").agg(F.max("r").alias("worst"), F.count("*").alias("have")).crossJoin(langs).where("have = langs")
    cols = [F.count_if(F.col("worst") <= k).alias(str(k)) for k in range(100, 1001, 100)]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("n_common")) for k in range(100, 1001, 100))))
    return m.agg(*cols).select(rows.alias("r")).select("r.*")


@query("term_union_sorted", f"WITH {TOK}, t AS (SELECT DISTINCT term FROM w) SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM t")
def term_union_sorted(spark, sf):
    return position(corpus(spark, sf).select(F.explode("tokens").alias("term")).distinct(), "term")


@query("rank_stability", f"""WITH {TOK}, c AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL),
r AS (SELECT lang, term, rank() OVER (PARTITION BY lang ORDER BY n DESC) + (count(*) OVER (PARTITION BY lang, n) - 1) / 2.0::DOUBLE AS r FROM c)
SELECT term, count(*) AS n_langs, round(avg(r), 6) AS mean_rank, round(stddev_samp(r), 6) AS std_rank FROM r GROUP BY term HAVING count(*) > 1""")  # fmt: skip
def rank_stability(spark, sf):
    c = vo.Vocabulary().counts(corpus(spark, sf, "lang")).withColumnRenamed("source", "lang")
    # ranks of frequencies, not of terms: equal counts share one row, so no partition holds a language's terms
    g = c.groupBy("lang", "n").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = c.join(g.select("lang", "n", (before + 1 + (F.col("k") - 1) / F.lit(2.0)).alias("r")), ["lang", "n"])
    out = r.groupBy("term").agg(F.count("*").alias("n_langs"), F.avg("r").alias("mean_rank"), F.stddev_samp("r").alias("std_rank")).where("n_langs > 1")
    return rounded(out, "mean_rank", "std_rank")
