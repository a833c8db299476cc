"""Logistic regression over any number of terms: the driver holds numbers of rows, never of terms.

From zero, every step of an L2-penalised fit is a sum of training rows, w = X'a, so a and the margins XX'a say all of
it.  Terms are dealt to blocks; a step sends one number a row to the tasks, each block takes it through its terms and
back, and the sums come home as one number a row.  The steps are those of limited-memory BFGS; along a step margins are
linear, so a search for its length reads no table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stash
from .ranking import position

#: Values a block holds, as far as one term's don't exceed it, and rows of a chunk of sums.
_BLOCK, _CHUNK = 1_000_000, 65_536
_PAIRS = 10


@dataclass(frozen=True)
class WideModel:
    """``coefs``: a table (term, coef); terms it lacks have 0."""

    coefs: DataFrame
    intercept: float

    def margins(self, values: DataFrame, sources: DataFrame) -> DataFrame:
        """(source, margin) of every source, from ``values(source, term, v)``."""
        sums = values.join(self.coefs.hint("shuffle_hash"), "term").groupBy("source").agg(F.sum(F.col("v") * F.col("coef")).alias("_m"))
        return sources.select("source").join(sums.hint("shuffle_hash"), "source", "left").select("source", (F.coalesce("_m", F.lit(0.0)) + F.lit(self.intercept)).alias("margin"))

    def predict(self, values: DataFrame, sources: DataFrame) -> DataFrame:
        """(source, y_pred): the probability of class 1."""
        return self.margins(values, sources).select("source", (0.5 * (1 + F.tanh(F.col("margin") / 2))).alias("y_pred"))


def _blocks(long: DataFrame) -> DataFrame:
    """(c, r, v): term within the block, row and value of a block's entries, as bytes."""
    parts = max(1, -(-long.count() // _BLOCK))

    def pack(t: pa.Table) -> pa.Table:
        codes = t.column("term").combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        arrays = codes.indices.to_numpy(zero_copy_only=False).astype("<i4"), t.column("row").to_numpy().astype("<i4"), t.column("v").to_numpy().astype("<f8")
        return pa.table({n: pa.array([a.tobytes()], pa.binary()) for n, a in zip("crv", arrays, strict=True)})

    return long.withColumn("_b", F.pmod(F.xxhash64("term"), F.lit(parts))).groupBy("_b").applyInArrow(pack, "c binary, r binary, v binary")


def _product(blocks: DataFrame, x: np.ndarray) -> np.ndarray:
    """XX'x."""
    n, sent = len(x), blocks.sparkSession.sparkContext.broadcast(x)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for c, r, v in zip(*(b.column(k) for k in "crv"), strict=True):
                c, r, v = np.frombuffer(c.as_py(), "<i4"), np.frombuffer(r.as_py(), "<i4"), np.frombuffer(v.as_py(), "<f8")
                part = np.bincount(r, v * np.bincount(c, v * sent.value[r])[c], minlength=n)
                total = part if total is None else total + part
        if total is not None:
            for k, at in enumerate(range(0, n, _CHUNK)):
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "s": pa.array([total[at : at + _CHUNK].tobytes()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(x.as_py(), "<f8") for x in t.column("s"))
        return pa.table({"k": t.column("k").slice(0, 1), "s": pa.array([s.tobytes()], pa.binary())})

    got = blocks.mapInArrow(tasks, "k int, s binary").groupBy("k").applyInArrow(add, "k int, s binary").collect()
    sent.destroy()
    return np.concatenate([np.frombuffer(r["s"], "<f8") for r in sorted(got, key=lambda r: r["k"])]) if got else np.zeros(n)


def _loss(f: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y == 1, -f, f)).sum())


def _length(f, g, y, linear: float, square: float) -> float:
    """The best length of a step that moves margins f by g, the penalty by linear * t + square * t * t / 2."""

    def slope(t: float) -> float:
        return float(g @ (0.5 * (1 + np.tanh((f + t * g) / 2)) - y)) + linear + square * t

    low, high = 0.0, 1.0
    while slope(high) < 0 and high < 1e12:
        low, high = high, high * 4
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) < 0 else (low, mid)
        if high - low <= 1e-10 * high:
            break
    return (low + high) / 2


def _fit(blocks: DataFrame, y: np.ndarray, C: float, max_iter: int, tol: float) -> tuple[np.ndarray, float]:
    """(a, intercept) of the least loss + |X'a|^2 / 2C.

    A vector is (a, its image XX'a, intercept), so inner products of weights and all sums of vectors need no table; each
    step's one product is the image of its residuals.
    """

    def dot(u, v) -> float:
        return float(u[0] @ v[1]) + u[2] * v[2]

    def plus(u, v, t: float = 1.0):
        return u[0] + t * v[0], u[1] + t * v[1], u[2] + t * v[2]

    n, lam = len(y), 1.0 / C
    share = y.mean()
    w = (np.zeros(n), np.zeros(n), float(np.log(share / (1 - share))))
    value, pairs, old = _loss(w[1] + w[2], y), [], None
    for _ in range(max_iter):
        rest = y - 0.5 * (1 + np.tanh((w[1] + w[2]) / 2))
        grad = (lam * w[0] - rest, lam * w[1] - _product(blocks, rest), -float(rest.sum()))
        if old is not None:
            s, d = old[1], plus(grad, old[0], -1.0)
            if dot(s, d) > 0:
                pairs = [*pairs[1 - _PAIRS :], (s, d, 1.0 / dot(s, d))]
        if dot(grad, grad) <= (tol * n) ** 2 * 1e-4:
            break
        q, kept = grad, []
        for s, d, rho in reversed(pairs):
            t = rho * dot(s, q)
            kept.append(t)
            q = plus(q, d, -t)
        if pairs:
            s, d, rho = pairs[-1]
            scale = 1.0 / (rho * dot(d, d))
            q = tuple(scale * x for x in q)
        for (s, d, rho), t in zip(pairs, reversed(kept), strict=True):
            q = plus(q, s, t - rho * dot(d, q))
        step = tuple(-x for x in q)
        t = _length(w[1] + w[2], step[1] + step[2], y, lam * float(w[0] @ step[1]), lam * float(step[0] @ step[1]))
        old = (grad, tuple(t * x for x in step))
        w = plus(w, old[1])
        now = _loss(w[1] + w[2], y) + lam / 2 * float(w[0] @ w[1])
        if abs(value - now) <= tol * 1e-3 * max(abs(now), 1e-300):
            break
        value = now
    return w[0], w[2]


def logistic(values: DataFrame, labels: DataFrame, C: float = 1.0, max_iter: int = 100, tol: float = 1e-6) -> WideModel:
    """The L2-penalised logistic regression of ``values(source, term, v)`` on ``labels(source, y)``, a row of 0 or 1 a source.

    The intercept has no penalty.  Labels of one class give its certainty, none raise ValueError.
    """
    spark = values.sparkSession
    rows = stash(position(labels.select("source", F.col("y").cast("double").alias("y")), "source", "row"), "rows")
    y = np.concatenate([np.zeros(0), *(b.column("y").to_numpy() for b in rows.select("row", "y").orderBy("row").toArrow().to_batches())])
    if not len(y):
        raise ValueError("no labelled source")
    if y.min() == y.max():
        return WideModel(spark.createDataFrame([], "term string, coef double"), float("inf") if y[0] else float("-inf"))
    long = stash(values.join(rows.select("source", "row").hint("shuffle_hash"), "source").select("term", "row", F.col("v").cast("double").alias("v")), "values")
    a, intercept = _fit(stash(_blocks(long), "blocks"), y, C, max_iter, tol)
    sent = spark.sparkContext.broadcast(a)

    @F.pandas_udf("double")
    def part(row: pd.Series, v: pd.Series) -> pd.Series:
        return v * sent.value[row.to_numpy()]

    coefs = stash(long.select("term", part("row", "v").alias("x")).groupBy("term").agg(F.sum("x").alias("coef")), "coefs")
    sent.destroy()
    return WideModel(coefs, intercept)
