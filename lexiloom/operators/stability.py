"""How stable coefficients are: many logistic fits to subsamples, all of them in one pass a step.

A row carries its features once and a flag for each subsample that drew it.  Newton's steps of all
subsamples go on together: each task adds up, for every subsample, the loss, gradient and curvature at that
subsample's coefficients, the sums of tasks meet by subsample, and the driver solves one small system for
each.  The work on the driver grows with subsamples and features, never with rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import TableStore

#: Curvature has the square of it; wider tables are refused.
MOST_FEATURES = 256
_BUCKETS = 4096
_STEPS = 50


def _hash(replicate, seed: int):
    return F.xxhash64(F.col("source"), replicate, F.lit(seed))


def thresholds(sources: DataFrame, replicates: int, share: float, seed: int) -> list[int | None]:
    """The largest hash that each subsample takes, so that it has int(n * share) of the n sources.

    One pass counts hashes in ranges, a second one sorts the range of each subsample that holds the limit.
    """
    n = sources.count()
    size = int(n * share)
    if not size:
        return [None] * replicates
    every = sources.select("source", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r")).withColumn("h", _hash(F.col("r"), seed))
    every = every.withColumn("bucket", F.shiftright(F.col("h"), 52) + _BUCKETS // 2)
    held = np.zeros((replicates, _BUCKETS), np.int64)
    for row in every.groupBy("r", "bucket").count().toArrow().to_pylist():
        held[row["r"], row["bucket"]] = row["count"]
    upto = held.cumsum(1)
    at = (upto < size).sum(1)
    before = [int(upto[r, b - 1]) if b else 0 for r, b in enumerate(at)]
    limits = sources.sparkSession.createDataFrame([(r, int(b), size - before[r]) for r, b in enumerate(at)], "r int, bucket long, k long")
    place = F.row_number().over(Window.partitionBy("r").orderBy("h"))
    found = every.join(F.broadcast(limits), ["r", "bucket"]).withColumn("place", place).where("place = k").select("r", "h").collect()
    out: list[int | None] = [None] * replicates
    for row in found:
        out[row["r"]] = row["h"]
    return out


def dense_table(features: DataFrame, labels: DataFrame, names: list[str], drawn: list[Column]) -> DataFrame:
    """(y, x, drawn): dense features in the order of the names and a flag for each subsample, from columns of the labels."""
    spark = features.sparkSession
    index = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    values = features.join(F.broadcast(index), "name").groupBy("source", "i").agg(F.sum("value").cast("double").alias("v"))
    rows = values.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    rows = labels.join(rows.hint("shuffle_hash"), "source", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,double>")))
    x = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return rows.select(F.col("y").cast("double").alias("y"), x.alias("x"), F.array(*drawn).cast("array<tinyint>").alias("drawn"))


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    return b.column("y").to_numpy(), wide("x"), wide("drawn").astype(float)


def _summed(rows: DataFrame, replicates: int, partial) -> list[np.ndarray]:
    """For each subsample the sum over all rows of the vectors that ``partial(y, x, drawn)`` gives for a batch, as replicates x values."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = partial(*_columns(b))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(replicates), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["r", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for r, v in zip(b.column("r").to_pylist(), b.column("v"), strict=True):
                v = v.values.to_numpy()
                total[r] = total[r] + v if r in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["r", "v"])

    kind = "r int, v array<double>"
    found = rows.mapInArrow(tasks, kind).repartition("r").mapInArrow(meet, kind).toArrow()
    out = dict(zip(found["r"].to_pylist(), found["v"].to_pylist(), strict=True))
    return [np.array(out[r]) for r in range(replicates)]


def _moments(y: np.ndarray, x: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    return np.concatenate([drawn.sum(0)[:, None], (drawn * y[:, None]).sum(0)[:, None], drawn.T @ x, drawn.T @ (x * x)], 1)


def _curvature(y: np.ndarray, x: np.ndarray, drawn: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of each subsample, one after the other."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
    out = np.empty((len(beta), 1 + x1.shape[1] + x1.shape[1] ** 2))
    f = x1 @ beta.T
    p = 0.5 * (1 + np.tanh(f / 2))
    loss = np.logaddexp(0, f) - y[:, None] * f
    out[:, 0] = (drawn * loss).sum(0)
    out[:, 1 : 1 + x1.shape[1]] = (drawn * (p - y[:, None])).T @ x1
    weight = drawn * p * (1 - p)
    for r in range(len(beta)):
        out[r, 1 + x1.shape[1] :] = ((x1 * weight[:, r, None]).T @ x1).reshape(-1)
    return out


class Fits(NamedTuple):
    """Standardised coefficients (the intercept last) of each subsample, and whether it holds both classes."""

    coef: np.ndarray
    able: np.ndarray


def newton(rows: DataFrame, replicates: int, d: int, C: float = 1.0, tolerance: float = 1e-9) -> Fits:
    """L2-penalised logistic fits to all subsamples of a ``dense_table`` with ``d`` features, each standardised by itself."""
    moments = np.array(_summed(rows, replicates, _moments))
    n, ones = moments[:, 0], moments[:, 1]
    able = (ones > 0) & (ones < n)
    size = np.maximum(n, 1)[:, None]
    mean = moments[:, 2 : 2 + d] / size
    spread = np.sqrt(np.maximum(moments[:, 2 + d :] / size - mean**2, 0))
    still = spread <= 1e-12 * np.maximum(1, np.abs(mean))
    scale = np.where(still, 1.0, spread)
    # Raw coefficients are a linear map of the standardised ones.
    turn = np.zeros((replicates, d + 1, d + 1))
    turn[:, range(d), range(d)] = np.where(still, 0, 1 / scale)
    turn[:, d, :d] = np.where(still, 0, -mean / scale)
    turn[:, d, d] = 1
    penalty = np.append(np.ones(d), 0.0) / C
    now = np.zeros((replicates, d + 1))
    step, best = np.zeros_like(now), np.full(replicates, np.inf)
    done = ~able
    for _ in range(_STEPS):
        if done.all():
            break
        beta = np.einsum("rij,rj->ri", turn, now)
        sums = _summed(rows, replicates, lambda y, x, drawn, beta=beta: _curvature(y, x, drawn, beta))
        for r in np.flatnonzero(~done):
            loss = sums[r][0] + 0.5 * (penalty * now[r] ** 2).sum()
            if loss > best[r] + 1e-9 * abs(best[r]):  # too far: half of the step back
                step[r] /= 2
                now[r] = now[r] - step[r]
                continue
            best[r] = min(loss, best[r])
            gradient = turn[r].T @ sums[r][1 : d + 2] + penalty * now[r]
            if np.abs(gradient).max() <= tolerance * n[r]:
                done[r] = True
                continue
            curved = turn[r].T @ sums[r][d + 2 :].reshape(d + 1, d + 1) @ turn[r] + np.diag(penalty)
            step[r] = -np.linalg.lstsq(curved, gradient, rcond=None)[0]
            now[r] = now[r] + step[r]
    return Fits(now, able)


def names_of(features: DataFrame) -> list[str]:
    """The features' names in order; more than ``MOST_FEATURES`` raise ValueError."""
    names = [r["name"] for r in features.select("name").distinct().orderBy("name").limit(MOST_FEATURES + 1).collect()]
    if len(names) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    return names


def replicate_fits(features: DataFrame, labels: DataFrame, replicates: int = 50, share: float = 0.7, C: float = 1.0, seed: int = 42, tolerance: float = 1e-9) -> DataFrame:
    """(replicate, name, coef) of L2-penalised logistic fits to ``replicates`` subsamples without replacement.

    ``features`` is (source, name, value), an absent one 0, repeated ones add up; ``labels`` (source, y) has one row
    of 0 or 1 for each source, other labels are ignored.  Each subsample is standardised by itself (mean 0,
    population deviation 1, constant features 0); ``C`` weighs the loss against the penalty, the intercept has
    none.  A subsample of one class has null coefficients.  No feature or no label: no row.
    """
    spark = features.sparkSession
    labels = labels.where("y in (0, 1) and source is not null").select("source", "y")
    features = features.where("name is not null and value is not null").join(labels.select("source"), "source", "left_semi").select("source", "name", "value")
    names = names_of(features)
    kind = "replicate int, name string, coef double"
    if not names:
        return spark.createDataFrame([], kind)
    limits = thresholds(labels.select("source"), replicates, share, seed)
    drawn = [F.lit(False) if t is None else _hash(F.lit(r), seed) <= t for r, t in enumerate(limits)]
    with TableStore(spark) as store:
        fits = newton(store.table("rows", "all", lambda: dense_table(features, labels, names, drawn)), replicates, len(names), C, tolerance)
    found = [(r, name, float(fits.coef[r, i]) if fits.able[r] else None) for r in range(replicates) for i, name in enumerate(names)]
    return spark.createDataFrame(found, kind)


def coefficient_stability(fits: DataFrame) -> DataFrame:
    """(name, fits, mean, std, same_sign) of ``replicate_fits``: sample deviation, and the share of fits with the mean's sign."""
    whole = fits.where("coef is not null").groupBy("name").agg(F.count("*").alias("fits"), F.avg("coef").alias("mean"), F.stddev_samp("coef").alias("std"), F.avg((F.col("coef") > 0).cast("double")).alias("_up"))
    return whole.select("name", "fits", "mean", "std", F.when(F.col("mean") > 0, F.col("_up")).otherwise(1 - F.col("_up")).alias("same_sign"))
