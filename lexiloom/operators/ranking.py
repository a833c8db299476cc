"""Ranks and positions over whole tables, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stash


def _sorted(df: DataFrame, *order) -> DataFrame:
    """``df`` as a table sorted in ranges, with ``_id``: the range in the upper bits, the row's place there in the lower 33."""
    return stash(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """Zero-based number of each row in the given order, ``name``.

    Rows are sorted by ranges of about equal size, whatever the values; the ranges' sizes, one number
    a partition, are summed up in order.
    """
    rows = _sorted(df, *order).withColumn("_range", F.shiftright("_id", 33))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = F.broadcast(rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_start")))  # one row a partition
    return rows.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_range", "_start", "_id")


def position(df: DataFrame, order: str, name: str = "idx") -> DataFrame:
    """Zero-based position of each row in the order of the column ``order`` (distinct values)."""
    return numbered(df, name, order)


def rank_of(df: DataFrame, value: Column, tie: str, name: str) -> DataFrame:
    """Zero-based rank of each row, the largest value first and ties by ``tie``."""
    return numbered(df.withColumn("_v", value.cast("double")), name, F.desc("_v"), tie).drop("_v")


def running(df: DataFrame, by: list[str], order: list, values: list[str]) -> DataFrame:
    """``df`` with ``before_<value>`` and ``all_<value>``: sums over the group's earlier rows, and over all of them.

    Sums run within ranges of the sorted table; each range's total is added to the later ranges' rows,
    so no group has to be in one task.
    """
    rows = _sorted(df, *by, *order).withColumn("_range", F.shiftright("_id", 33))
    here = Window.partitionBy(*by, "_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    if not by:
        earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_range").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))  # a few rows a range
    totals = totals.select(*by, "_range", *(F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_s_{v}") for v in values), *(F.sum(f"_t_{v}").over(whole).alias(f"all_{v}") for v in values))
    local = rows.withColumns({f"_l_{v}": F.coalesce(F.sum(v).over(here), F.lit(0)) for v in values})
    same = local["_range"] == totals["_range"]
    for c in by:
        same &= local[c].eqNullSafe(totals[c])
    out = local.join(totals, same)
    return out.select(*(local[c] for c in df.columns), *((F.col(f"_l_{v}") + F.col(f"_s_{v}")).alias(f"before_{v}") for v in values), *(F.col(f"all_{v}") for v in values))


def with_average_rank(df: DataFrame, value: str, by: list[str], name: str, descending: bool = True) -> DataFrame:
    """``df`` with ``name``: the rank from 1 in which equal values share the mean of their places."""
    sizes = df.groupBy(*by, value).agg(F.count("*").alias("_k"))
    placed = running(sizes, by, [F.desc(value) if descending else F.asc(value)], ["_k"])
    placed = placed.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), F.col(value).alias("_gv"), (F.col("before__k") + (F.col("_k") + 1) / F.lit(2.0)).alias(name))
    same = df[value].eqNullSafe(placed["_gv"])
    for i, c in enumerate(by):
        same &= df[c].eqNullSafe(placed[f"_g{i}"])
    # Every row has its place; a left join never sends out ``df``, whatever its files' size.
    return df.join(placed, same, "left").select(*(df[c] for c in df.columns), name)


def placed(df: DataFrame, by: list[str], key: Column, tie: str, name: str) -> DataFrame:
    """``df`` with ``name``, each row's place from 1 in its group in the order of ``key``, a hash in hexadecimal.

    The hash's first digits cut a group into even ranges, whose sizes are summed up in order.
    """
    rows = df.withColumn("_key", key).withColumn("_cut", F.substring("_key", 1, 3))
    sizes = rows.groupBy(*by, "_cut").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), F.col("_cut").alias("_gc"), F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")).alias("_start"))
    rows = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*by, "_cut").orderBy("_key", tie)))
    same = F.col("_cut") == F.col("_gc")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(starts, same).withColumn(name, (F.col("_start") + F.col("_local")).cast("long")).select(*df.columns, name)


def latest(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")
