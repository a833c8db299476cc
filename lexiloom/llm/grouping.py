"""Streams of small sorted groups through one Arrow function, without a call for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KINDS = {"binary": pa.binary(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}


#: At most so many keys are cut up: those with more than this part of all rows, and of ``LEAST_HUB`` rows.
HUBS, LEAST_HUB = 10_000, 256


def join_hubs(rows: DataFrame, one: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``one``, which has one row for each ``key`` and its number of rows, ``size``.

    ``total`` bounds the sum of the sizes.  Frequent keys, of which there are at most ``HUBS``, are known
    to every task; their rows are dealt to as many cuts as keep each small, and their row of ``one`` is
    repeated for each cut.  Rows without a partner go; ``size`` isn't kept.
    """
    limit = max(LEAST_HUB, total // HUBS)
    cuts = F.ceil(F.col(size) / limit).cast("int")
    hubs = one.where(F.col(size) > limit).select(F.col(key).alias("_hub"), cuts.alias("_cuts"))
    left = rows.join(F.broadcast(hubs), rows[key] == F.col("_hub"), "left")
    left = left.select(*rows.columns, F.pmod(F.xxhash64(*rows.columns), F.coalesce("_cuts", F.lit(1))).cast("int").alias("_cut"))
    right = one.withColumn("_cut", F.explode(F.sequence(F.lit(0), F.when(F.col(size) > limit, cuts - 1).otherwise(F.lit(0))))).drop(size)
    return left.join(right, [key, "_cut"]).drop("_cut")


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[list, np.ndarray]]:
    """(columns as lists or arrays, bounds of the runs of equal keys), only whole runs.

    The first ``n_keys`` columns are the keys, by which the rows come sorted.
    """
    rest: pa.Table | None = None

    def columns(t: pa.Table) -> tuple[list, np.ndarray]:
        cols = [c.to_numpy() if pa.types.is_primitive(c.type) and not c.null_count else np.array(c.to_pylist(), dtype=object) for c in t.columns[:n_keys]]
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        return cols, np.flatnonzero(new)

    def ready(t: pa.Table, cols: list, bounds: np.ndarray) -> tuple[list, np.ndarray]:
        n = int(bounds[-1])
        more = [c.to_numpy() if pa.types.is_primitive(c.type) and not c.null_count else c.to_pylist() for c in t.slice(0, n).columns[n_keys:]]
        return [c[:n] for c in cols] + more, bounds

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        cols, starts = columns(t)
        if len(starts) > 1:
            yield ready(t, cols, starts)
            rest = t.slice(int(starts[-1]))
        else:
            rest = t
    if rest is not None and rest.num_rows:
        cols, starts = columns(rest)
        yield ready(rest, cols, np.append(starts, rest.num_rows))


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[list, int, int], Iterable[tuple]], schema: str, order: tuple[str, ...] = (), whole: Callable | None = None) -> DataFrame:
    """Rows ``fn(columns, start, end)`` gives for each group of equal ``keys``; groups must be of bounded size."""
    rest = [c for c in df.columns if c not in keys]
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    kinds = [_KINDS[f.strip().split(" ")[1]] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for cols, bounds in runs(batches, len(keys)):
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                out.extend(fn(cols, lo, hi))
                if len(out) >= 8192:
                    yield batch()
        if out:
            yield batch()

    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
