"""Vector code compression: codebooks for the parts of a vector, by Lloyd's rounds that are kept up by differences.

Every vector is cut into equal consecutive parts of integer components, and each part is replaced by
the index of the nearest entry of its codebook.  A table in the shared folder holds the rows with the
assignments of the last round; the driver holds the codebooks and their running integer sums and counts
(parts x entries x components, whatever the rows).  A round assigns anew, writes the next table, and
shuffles only what changed: each task adds up plus and minus contributions of parts that moved, and
emits a row for each sum that isn't zero.  Sums are integers, so no order of tasks or retries alters them.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped, zero and
empty vectors stay; shorter vectors, and all if the longest can't be cut equally, are filled up with
zeros; integer components are held within +-2^27, an error within a long; with fewer rows than entries
the codebooks have as many entries as rows; null ids come last in the order of ids, equal ids go by
their vectors; repeated rows count each; an entry without parts stays; a sum of errors beyond a long is
null; an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stash, stash_at
from .grouping import join_hubs
from .vectors import by_dimension

LARGEST = 1 << 27
_ROWS_AT_ONCE = 4_096


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor holds null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def parts_of(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """rows x parts x width, filled up with zeros."""
    out = np.zeros((len(column), parts * width), np.int64)
    for rows, x in by_dimension(column, "<i8"):
        out[rows, : x.shape[1]] = x
    return out.reshape(len(column), parts, width)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, lowest first; its squared distance) of each row's parts."""
    n, parts, width = x.shape
    code, dist = np.zeros((n, parts), np.uint8 if books.shape[1] <= 256 else np.int64), np.zeros((n, parts), np.int64)
    if not width:
        return code, dist
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    if 4 * width * largest**2 < 1 << 53:  # doubles hold every sum exactly
        for p in range(parts):
            c = books[p].astype(float)
            part = x[:, p].astype(float)
            d = (c * c).sum(1)[None] - 2 * (part @ c.T)
            best = d.argmin(1)
            code[:, p], dist[:, p] = best, d[np.arange(n), best] + (part * part).sum(1)
        return code, dist
    kind = np.int64 if width <= 128 else object
    for p in range(parts):
        c = books[p].astype(kind)
        for i in range(n):
            d = ((x[i, p].astype(kind)[None] - c) ** 2).sum(1)
            best = int(np.argmin(d))
            code[i, p], dist[i, p] = best, min(int(d[best]), (1 << 63) - 1)
    return code, dist


def contributions(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> np.ndarray:
    """parts x entries x (1 + width): counts and sums that the parts whose entry changed take along."""
    n, parts, width = x.shape
    out = np.zeros((parts, entries, 1 + width), np.int64)
    for p in range(parts):
        moved = np.arange(n) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        for sign, code in ((1, new), (-1, old)):
            if code is None or not len(moved):
                continue
            to = code[moved, p].astype(np.int64)
            order = np.argsort(to, kind="stable")
            at, first = np.unique(to[order], return_index=True)
            out[p, at, 0] += sign * np.diff(np.append(first, len(to)))
            out[p, at, 1:] += sign * np.add.reduceat(x[moved[order], p], first, axis=0)
    return out


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", report: dict | None = None) -> DataFrame:
    """Per usable row: vec_id, label, code (a byte for each part), error, label_error, codebooks_sha256.

    ``entries`` is 256 at most.  ``report`` gets the codebooks and how many sums each round moved.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: entries is 1 to 256")
    spark = vectors.sparkSession
    every = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label"))
    rows, path = stash_at(every.where(usable(F.col("v"))).withColumn("v", whole_numbers(F.col("v"), scale)), "parts")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // parts)
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    k = len(first)
    books = np.zeros((parts, k, width), np.int64)
    for i, r in enumerate(first):
        flat = np.zeros(parts * width, np.int64)
        flat[: len(r["v"])] = r["v"]
        books[:, i] = flat.reshape(parts, width)
    sums = np.zeros((parts, k, 1 + width), np.int64)
    columns = f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>, old binary, code binary, error long"

    def assigned(now: DataFrame, books: np.ndarray, last: bool) -> DataFrame:
        """``now`` with its codes as the old ones and new codes and errors; the last time without vectors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, _ROWS_AT_ONCE):
                    some = b.slice(at, _ROWS_AT_ONCE)
                    code, dist = nearest(parts_of(some.column("v"), parts, width), books)
                    coded = pa.array([c.tobytes() for c in code], pa.binary())
                    error = pa.array([min(int(e), (1 << 63) - 1) for e in dist.astype(object).sum(1)], pa.int64())
                    old = some.column("code") if "code" in some.schema.names else pa.nulls(len(some), pa.binary())
                    held = pa.nulls(len(some), pa.list_(pa.int32())) if last else some.column("v")
                    yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), held, old, coded, error], ["vec_id", "label", "v", "old", "code", "error"])

        return now.mapInArrow(run, columns)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, 1 + width), np.int64)
        for b in batches:
            new = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            fresh = b.column("old").null_count > 0
            old = None if fresh else np.frombuffer(b"".join(b.column("old").to_pylist()), np.uint8).reshape(-1, parts)
            total += contributions(parts_of(b.column("v"), parts, width), old, new, k)
        flat = total.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(flat[at])], ["slot", "value"])

    steps = []
    for _ in range(rounds if k else 0):
        following, following_path = stash_at(assigned(rows, books, False), "parts")
        discard(spark, path)
        rows, path = following, following_path
        changed = rows.where("old is null or old <> code").select("v", "old", "code").mapInArrow(moved, "slot long, value long")
        found = changed.groupBy("slot").agg(F.sum("value").alias("value")).where("value <> 0").toArrow()
        steps.append(found.num_rows)
        if not found.num_rows:  # nothing moved: all further rounds would leave everything as it is
            break
        sums.reshape(-1)[found["slot"].to_numpy()] += found["value"].to_numpy()
        used = sums[:, :, 0] > 0
        books[used] = sums[used][:, 1:] // sums[used][:, :1]
    text = ",".join(map(str, books.reshape(-1).tolist()))
    if report is not None:
        report |= {"codebooks": books, "sums_moved": steps}
    coded = stash(assigned(rows, books, True).drop("v", "old").withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))), "codes")
    discard(spark, path)
    by_label = stash(coded.groupBy("key").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    total = by_label.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = join_hubs(coded, by_label, "key", "n", total)
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
