"""Overlap of the term sets of data sets: all pairs and all frequency thresholds from one aggregate.

A term's row says which data sets hold it and how often, capped beyond the largest threshold.  Terms
with the same row count together, so that pairs are made of the few distinct rows, not of terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_pairs(counts: DataFrame, thresholds: tuple[int, ...] = (0,)) -> DataFrame:
    """(threshold, a, b, size_a, size_b, n_both, n_either, jaccard, overlap) of every ordered pair of data sets.

    ``counts`` is (dataset, term, n); a set holds the terms with n above the threshold, repeated rows add up.
    ``overlap`` is the share of a's terms that b holds.  A pair without a common term has 0; a data set without a
    term above a threshold has no row at it.  Null data sets and terms are ignored.
    """
    top = max(thresholds) + 1
    held = counts.where("dataset is not null and term is not null").groupBy("term", "dataset").agg(F.least(F.sum("n"), F.lit(top)).alias("n")).where(F.col("n") > min(thresholds))
    rows = held.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("dataset", "n"))).alias("sets"))  # as long as there are data sets
    rows = rows.groupBy("sets").agg(F.count("*").alias("terms"))
    above = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    above = above.select("threshold", F.expr("transform(filter(sets, s -> s.n > threshold), s -> s.dataset)").alias("sets"), "terms").where(F.size("sets") > 0)
    above = above.groupBy("threshold", "sets").agg(F.sum("terms").alias("terms"))
    pairs = above.select("threshold", F.explode("sets").alias("a"), "sets", "terms").select("threshold", "a", F.explode("sets").alias("b"), "terms").groupBy("threshold", "a", "b").agg(F.sum("terms").alias("n_both"))
    size = pairs.where("a = b").select("threshold", F.col("a").alias("dataset"), F.col("n_both").alias("size"))
    grid = size.select("threshold", F.col("dataset").alias("a"), F.col("size").alias("size_a")).join(size.select("threshold", F.col("dataset").alias("b"), F.col("size").alias("size_b")), "threshold")
    both = F.coalesce("n_both", F.lit(0).cast("long"))
    out = grid.join(pairs, ["threshold", "a", "b"], "left").withColumn("n_both", both).withColumn("n_either", F.col("size_a") + F.col("size_b") - F.col("n_both"))
    return out.select("threshold", "a", "b", "size_a", "size_b", "n_both", "n_either", (F.col("n_both") / F.col("n_either")).alias("jaccard"), (F.col("n_both") / F.col("size_a")).alias("overlap"))
