"""Features from long document-term tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stash

NORMS = ("matched", "unmatched", "max", "l1", "l2", None)


#: Rows of a table of terms that are sent to every task.
MOST_SENT = 20_000


def join_terms(counts: DataFrame, terms: DataFrame, order: str, key: str = "term") -> DataFrame:
    """Inner join of ``counts`` with the distinct terms of ``terms``; those with the largest ``order`` are sent out, the others meet by hash.

    A few thousand terms make up most of a table of counts, whose rows then stay where they are.  Both tables are read twice.
    """
    terms = stash(terms, "terms")
    sent = stash(terms.orderBy(F.desc(order), key).limit(MOST_SENT), "sent")
    names = F.broadcast(sent.select(key))
    near = counts.join(F.broadcast(sent), key)
    far = counts.join(names, key, "left_anti").join(terms.join(names, key, "left_anti").hint("shuffle_hash"), key)
    return near.unionByName(far)


def tfidf(dtm: DataFrame, n_docs: DataFrame | None = None, key: str = "idx", df: DataFrame | None = None) -> DataFrame:
    """(source, key, value): counts times smooth idf + 1, rows scaled to unit length.

    ``df(key, _df)``, if given, names the terms to keep and their numbers of sources.
    """
    docs = F.broadcast(n_docs if n_docs is not None else dtm.agg(F.countDistinct("source").alias("_docs")).select("_docs"))
    df = dtm.groupBy(key).agg(F.count("*").alias("_df")) if df is None else df
    idf = F.log((F.lit(1.0) + F.col("_docs")) / (F.lit(1.0) + F.col("_df"))) + 1.0
    raw = join_terms(dtm, df, "_df", key).crossJoin(docs).select("source", key, (F.col("n") * idf).alias("v"))
    return l2_rows(raw, "v", key).withColumnRenamed("v", "value")


def l2_rows(df: DataFrame, value: str, key: str) -> DataFrame:
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy("source")))
    return df.select("source", key, F.when(norm > 0, F.col(value) / norm).otherwise(F.lit(0.0)).alias(value))


def match_lexicon(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(term, dim): exact entries first, else the longest prefix entry.

    ``lexicon(entry, is_prefix, dim)``.  A term's prefixes are its candidates, so both are equi-joins.  Only the lexicon is
    sent out, never terms or their prefixes, of which Spark's estimates know too little.
    """
    whole, starts = F.broadcast(lexicon.where("not is_prefix")), F.broadcast(lexicon.where("is_prefix"))
    exact = terms.join(whole, F.col("term") == F.col("entry")).select("term", "dim")
    rest = terms.join(whole, F.col("term") == F.col("entry"), "left_anti")
    heads = rest.select("term", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda i: F.substring("term", 1, i))).alias("entry")).where("term <> ''")
    hits = heads.join(starts, "entry").select("term", "entry", "dim")
    longest = F.max(F.length("entry")).over(Window.partitionBy("term"))
    return exact.union(hits.withColumn("_n", longest).where(F.length("entry") == F.col("_n")).select("term", "dim")).distinct()


def lexicon_features(counts: DataFrame, lexicon: DataFrame, norm: str | None = None) -> DataFrame:
    """(source, dim, value): lexicon hits of each source, divided as ``norm`` says; zero-safe."""
    if norm not in NORMS:
        raise ValueError(f"norm must be one of {NORMS}")
    dims = match_lexicon(counts.select("term").distinct(), lexicon)
    hits = counts.join(dims, "term")
    sums = hits.groupBy("source", "dim").agg(F.sum("n").cast("double").alias("value"))
    by_source = Window.partitionBy("source")
    if norm is None:
        return sums
    if norm in ("matched", "unmatched"):
        base = counts.join(dims.select("term").distinct(), "term", "left_semi") if norm == "matched" else counts
        total = base.groupBy("source").agg(F.sum("n").alias("_t"))
        return sums.join(total, "source").select("source", "dim", (F.col("value") / F.nullif(F.col("_t"), F.lit(0))).alias("value"))
    scale = {"max": F.max("value"), "l1": F.sum(F.abs("value")), "l2": None}[norm]
    total = scale.over(by_source) if scale is not None else F.sqrt(F.sum(F.col("value") * F.col("value")).over(by_source))
    return sums.select("source", "dim", F.coalesce(F.col("value") / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("value"))


#: Components of vectors that are pooled side by side.
POOLED = 32

#: Sums, and components of vectors, that one task holds while vectors are pooled, and rows of counts that it reads.
MOST_HELD, MOST_POOLED = 2**24, 2_000_000


def meet_vectors(counts: DataFrame, embeddings: DataFrame, widest: int, sums: int) -> DataFrame:
    """Inner join on ``key`` by cells, a group of sources and a group of keys each, of which a task has one.

    A task thus holds the vectors of one group of keys and, of ``sums`` numbers a source, those of one group of sources, however
    many there are of either; counts move once, vectors once for each group of sources.  Both tables are read twice.
    """
    rows, sources = counts.agg(F.count("*"), F.approx_count_distinct("source")).first()
    keys = embeddings.count()
    tasks = max(-(-rows // MOST_POOLED), counts.sparkSession.sparkContext.defaultParallelism)
    groups = max(-(-sources * sums // MOST_HELD), min(tasks, round((tasks * sources * sums * 2 / max(1, keys * widest)) ** 0.5)), 1)
    parts = max(-(-keys * widest // MOST_HELD), -(-tasks // groups))
    kind = counts.select("key").union(embeddings.select("key")).schema["key"].dataType
    cell = F.col("_g") * parts + F.pmod(F.xxhash64(F.col("key").cast(kind)), F.lit(parts)).cast("int")
    near = counts.withColumn("_g", F.pmod(F.xxhash64("source"), F.lit(groups)).cast("int"))
    far = embeddings.select("key", "vector", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"))
    near, far = (df.withColumn("_cell", cell).drop("_g").repartitionById(groups * parts, "_cell") for df in (near, far))
    return near.join(far.hint("shuffle_hash"), ["_cell", "key"])


def pool_embeddings(counts: DataFrame, embeddings: DataFrame, how: str = "mean") -> DataFrame:
    """(source, dim, value) of ``counts(source, key, n)`` and ``embeddings(key, vector)``.

    ``mean`` weights vectors by counts; ``extremum`` takes the component of largest magnitude over
    the distinct terms (positive if equal), terms without a vector counting as zeros.
    ``POOLED`` components of a source are columns of one row, so that a task's table has few rows; where all vectors
    have one length, one weight a row serves all of them.
    """
    if how not in ("mean", "extremum"):
        raise ValueError("how must be 'mean' or 'extremum'")
    counts, vectors = stash(counts, "counts"), embeddings.where(F.size("vector") > 0)
    least, most = vectors.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    even, most = least == most, most or 0
    at = F.col("_b") * POOLED
    met = meet_vectors(counts, vectors, most, most if how == "mean" and even else 2 * most)
    blocks = F.sequence(F.lit(0), F.floor((F.size("vector") - 1) / POOLED).cast("int"))
    met = met.select("source", "n", F.size("vector").alias("_size"), "vector", F.explode(blocks).alias("_b"))
    x = [F.get("vector", at + i).cast("double") for i in range(POOLED)]
    if how == "mean":
        pairs = [(F.sum(F.col("n") * x[i]), F.sum("n" if even else F.when(F.col("_size") > at + i, F.col("n")))) for i in range(POOLED)]
    else:
        pairs = [(F.min(c), F.max(c)) for c in x]
    sums = met.groupBy("source", "_b").agg(F.max("_size").alias("_size"), *(c.alias(f"_{k}{i}") for i, pair in enumerate(pairs) for k, c in zip("pq", pair, strict=True)))
    ends = sums.select("source", "_b", "_size", F.posexplode(F.array(*(F.struct(F.col(f"_p{i}").alias("p"), F.col(f"_q{i}").alias("q")) for i in range(POOLED)))).alias("_i", "_e"))
    ends = ends.select("source", (at + F.col("_i")).alias("dim"), F.col("_e.p").alias("lo"), F.col("_e.q").alias("hi"), "_size").where("dim < _size")
    if how == "mean":
        return ends.select("source", "dim", (F.col("lo") / F.col("hi")).alias("value"))
    missing = counts.join(embeddings, "key", "left_anti").select("source").distinct().withColumn("_zero", F.lit(0.0))
    ends = ends.join(missing, "source", "left")
    lo, hi = F.least("lo", "_zero"), F.greatest("hi", "_zero")
    return ends.select("source", "dim", F.when(-lo > hi, lo).otherwise(hi).alias("value"))


def standardize(features: DataFrame, by: str = "dim") -> DataFrame:
    """Values less their mean over their population deviation (1 if 0)."""
    stats = features.groupBy(by).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return features.join(stats, by).withColumn("value", (F.col("value") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))).drop("_m", "_s")


def union_features(**sets: DataFrame) -> DataFrame:
    """Feature sets side by side in the order of their names: (feature_set, source, name, value)."""
    out = None
    for name in sorted(sets):
        df = sets[name].select(F.lit(name).alias("feature_set"), "source", F.col("name").cast("string").alias("name"), F.col("value").cast("double").alias("value"))
        out = df if out is None else out.unionByName(df)
    return out


def cosine_between(features: DataFrame) -> DataFrame:
    """(a, b, cosine) of sources that share a feature; both orders and the diagonal."""
    unit = l2_rows(features, "value", "name")
    a, b = unit.alias("a"), unit.alias("b")
    return a.join(b, F.col("a.name") == F.col("b.name")).groupBy(F.col("a.source").alias("a"), F.col("b.source").alias("b")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("cosine"))
