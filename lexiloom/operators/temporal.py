"""Time bins, periods and user histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MOST_PERIODS = 10_000


def bin_of(at: Column, bounds: list[str]) -> Column:
    """Index of the half-open bin [b_i, b_i+1); the last is open-ended; null before the first."""
    out = F.lit(None).cast("int")
    for i, b in enumerate(bounds):
        out = F.when(at >= F.lit(b).cast("timestamp_ntz"), i).otherwise(out)
    return out


def time_bins(df: DataFrame, user: str, at: str, bounds: list[str]) -> DataFrame:
    """(user, bin, n) of posts from the first boundary on."""
    return df.withColumn("bin", bin_of(F.col(at), bounds)).where("bin is not null").groupBy(user, "bin").agg(F.count("*").alias("n"))


def user_bounds(df: DataFrame, user: str, at: str) -> DataFrame:
    """First and last post, their number, and the whole days between."""
    days = F.floor((F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))) / F.lit(86_400_000_000))
    return df.groupBy(user).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"), days.alias("n_days"))


def valid_bins(counts: DataFrame, labels: DataFrame, user: str, min_posts: int, min_users: int) -> DataFrame:
    """(bin, smallest class): bins in which every class has enough users with enough posts."""
    active = counts.where(F.col("n") >= min_posts).join(labels, user)
    per = active.groupBy("bin", "y").agg(F.count("*").alias("users"))
    classes = F.broadcast(labels.agg(F.countDistinct("y").alias("classes")))
    return per.groupBy("bin").agg(F.min("users").alias("users"), F.count("*").alias("have")).crossJoin(classes).where((F.col("have") == F.col("classes")) & (F.col("users") >= min_users)).select("bin", "users")


def closed_range(df: DataFrame, at: str, lo: str, hi: str) -> DataFrame:
    return df.where(F.col(at).between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")))


def half_open_dates(df: DataFrame, at: str, lo: str, hi: str) -> DataFrame:
    day = F.to_date(at)
    return df.where((day >= F.lit(lo).cast("date")) & (day < F.lit(hi).cast("date")))


def period_stats(counts: DataFrame, users: DataFrame, periods: DataFrame, user: str, above: list[int]) -> DataFrame:
    """(bin, min, max, mean, median, users above each number) over all users, absent ones counting 0.

    The zeros are added by number, not as rows: the grid of users and periods is never built.
    """
    total = F.broadcast(users.agg(F.countDistinct(user).alias("total")))
    by_n = counts.groupBy("bin", "n").agg(F.count("*").alias("k"))
    have = by_n.groupBy("bin").agg(F.sum("k").alias("have")).crossJoin(total)
    zeros = periods.join(have, "bin", "left").crossJoin(total.withColumnRenamed("total", "all")).select("bin", F.lit(0).cast("long").alias("n"), (F.col("all") - F.coalesce("have", F.lit(0))).alias("k"))
    grid = by_n.union(zeros).where("k > 0")
    return grid.groupBy("bin").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), (F.sum(F.col("n") * F.col("k")) / F.sum("k")).alias("mean"), F.percentile("n", F.lit(0.5), F.col("k")).alias("median"),
        *(F.sum(F.when(F.col("n") > a, F.col("k")).otherwise(0)).alias(f"above_{a}") for a in above),
    )


def join_periods(df: DataFrame, periods: DataFrame, at: str) -> DataFrame:
    """Rows with each period [lo, hi) that holds them; a null hi is open.

    At most ``MOST_PERIODS`` periods are sent to every task; more are refused.
    """
    if periods.limit(MOST_PERIODS + 1).count() > MOST_PERIODS:
        raise ValueError(f"more than {MOST_PERIODS} periods")
    return df.join(F.broadcast(periods), (F.col(at) >= F.col("lo")) & (F.col("hi").isNull() | (F.col(at) < F.col("hi"))))
