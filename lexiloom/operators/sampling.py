"""Reproducible samples, splits and folds keyed by a hash of the row's id, the same in every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import order_key, uniform
from .ranking import placed, running


def _placed(df: DataFrame, by: list[str], key: str, seed: int, name: str = "_p") -> DataFrame:
    return placed(df, by, order_key(F.col(key), seed), key, name)


def rebalance(df: DataFrame, label: str, key: str, ratio: tuple[int, int] = (1, 1), seed: int = 42) -> DataFrame:
    """Sample classes 1 and 0 to the ratio (target, control) without repeats.

    The class in short supply is kept whole and the other cut to fit.
    """
    t, c = ratio
    n = F.broadcast(df.agg(F.count_if(F.col(label) == 1).alias("_t"), F.count_if(F.col(label) == 0).alias("_c")))
    enough = F.col("_t") * c <= F.col("_c") * t
    most_t = F.when(enough, F.col("_t")).otherwise(F.expr(f"(_c * {t}) div {c}"))
    most_c = F.when(enough, F.expr(f"(_t * {c}) div {t}")).otherwise(F.col("_c"))
    rows = _placed(df.where(F.col(label).isin(0, 1)), [label], key, seed).crossJoin(n)
    return rows.where(F.col("_p") <= F.when(F.col(label) == 1, most_t).otherwise(most_c)).select(df.columns)


def downsample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(order_key(F.col(key), seed), key).limit(n)


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """``fold`` from 1 to k, each with an equal share of every class."""
    rows = _placed(df.drop("fold"), [label], key, seed)
    return rows.withColumn("fold", ((F.col("_p") - 1) % k + 1).cast("int")).drop("_p")


def held_out_split(df: DataFrame, label: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """``role`` test for the given share of each class, else train."""
    n = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))  # one row a class
    rows = _placed(df, [label], key, seed).join(F.broadcast(n), F.col(label).eqNullSafe(F.col("_label")))
    return rows.withColumn("role", F.when(F.col("_p") <= F.floor(F.col("_n") * share), "test").otherwise("train")).drop("_p", "_n", "_label")


def recent_posts(df: DataFrame, by: str, at: str, ordinal: str, n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(at), ordinal)
    return df.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= n).drop("_p")


def random_posts(df: DataFrame, by: str, key: str, n: int | float, seed: int = 42) -> DataFrame:
    """``n`` posts of each user, or that fraction of them."""
    size = F.lit(n) if isinstance(n, int) else F.floor(F.count("*").over(Window.partitionBy(by)) * n)
    return df.withColumn("_n", size).withColumn("_p", F.row_number().over(Window.partitionBy(by).orderBy(order_key(F.col(key), seed), key))).where(F.col("_p") <= F.col("_n")).drop("_n", "_p")


def matched_pairs(targets: DataFrame, controls: DataFrame, matches: str, key: str) -> DataFrame:
    """Targets and the controls that any target's list names."""
    wanted = targets.select(F.explode(matches).alias(key)).distinct()
    return targets.select(key).withColumn("role", F.lit("target")).union(controls.join(wanted, key, "left_semi").select(key).withColumn("role", F.lit("control")))


def histogram_matched(pool: DataFrame, reference: DataFrame, value: str, key: str, n: int | None, lo: float | None, hi: float | None, bins: int, by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """``n`` rows of each stratum of the pool, drawn without replacement by the reference's histogram.

    Each row's key is -ln(u) / weight; the smallest keys are a weighted sample.  Without ``n`` a stratum gets as many
    rows as the reference has there.  With bounds values beyond them count to the outer bins and the last one is closed.
    Without, the bounds of a stratum are the reference's least and largest value (half a unit around a single one), and
    rows of the pool from the upper one on or below the lower one are never drawn.  Rows without a value aren't either.
    """
    by = by or []
    strata = reference.where(F.col(value).isNotNull()).groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by))).agg(F.count("*").alias("_n"), F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    strata = strata.withColumns({"_lo": F.col("_lo") - F.when(flat, 0.5).otherwise(0.0), "_hi": F.col("_hi") + F.when(flat, 0.5).otherwise(0.0)})
    if n is not None:
        strata = strata.withColumn("_n", F.lit(n).cast("long"))
    own = lo is None or hi is None
    if not own:
        strata = strata.withColumns({"_lo": F.lit(float(lo)), "_hi": F.lit(float(hi))})
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    x = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins
    bin_of = F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(bins - 1))
    placed_in = lambda df: df.where(F.col(value).isNotNull()).join(strata if by else F.broadcast(strata), same).withColumn("_bin", bin_of)  # noqa: E731  one row without strata
    weight = placed_in(reference).groupBy(*(f"_g{i}" for i in range(len(by))), "_bin").agg(F.count("*").cast("double").alias("_w"))
    drawn = placed_in(pool)
    if own:
        drawn = drawn.where((F.col(value) >= F.col("_lo")) & (F.col(value) < F.col("_hi")))
    met = drawn["_bin"] == weight["_bin"]
    for i in range(len(by)):
        met &= drawn[f"_g{i}"].eqNullSafe(weight[f"_g{i}"])
    drawn = drawn.join(weight, met).select(*(drawn[c] for c in pool.columns), drawn["_n"], weight["_w"], F.lit(1).alias("_one"))
    drawn = drawn.withColumn("_k", -F.log(F.greatest(uniform(F.col(key), seed), F.lit(1e-12))) / F.col("_w"))
    if not by and n is not None:
        return drawn.orderBy("_k", key).limit(n).select(pool.columns)
    return running(drawn, by, ["_k", key], ["_one"]).where(F.col("before__one") < F.col("_n")).select(pool.columns)


def expand_labels(users: DataFrame, labels: str, disorders: list[str]) -> DataFrame:
    """A column for each disorder: its name for members, ``control`` for controls, else null."""
    return users.select("*", *(F.when(F.array_contains(labels, "control"), "control").when(F.array_contains(labels, d), d).alias(d) for d in disorders))


def resolve_label(posts: DataFrame, user: str, category: str, target: str) -> DataFrame:
    """1 for users with any post in the target category."""
    return posts.groupBy(user).agg(F.max(F.when(F.col(category) == target, 1).otherwise(0)).alias("y"))


def overlay(*labels: DataFrame) -> DataFrame:
    """(source, label): the last table with a source has the say."""
    all_of = None
    for i, df in enumerate(labels):
        part = df.select("source", "label", F.lit(i).alias("_i"))
        all_of = part if all_of is None else all_of.union(part)
    return all_of.groupBy("source").agg(F.max_by("label", "_i").alias("label"))
