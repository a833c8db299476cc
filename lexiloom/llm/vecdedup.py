"""Near-duplicate vectors by randomised-rotation binary codes.

A vector's code is the signs of its rotated components; stored with it is a correction factor,
the inner product of the vector with its code.  Code times rotated vector over factor estimates a
cosine without bias, with a known spread.  Only pairs whose upper confidence bound reaches the
threshold are recomputed exactly; nothing is linked by an estimate.

Candidates come from further rotations: runs of sign bits are keys of bucket tables, as many as
make the chance that a pair at the threshold shares no bucket at most ``MISS``.  Equal vectors of
a label are one class and make no pairs.  Of buckets with the same members one stays.  Large
buckets are dealt out in blocks; a pair counts in the first table where it meets, so each link
counts once.  Blocks give sums of links and a spanning set of edges, never the pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components, and those with a
null label, link with nothing and are kept; vectors of different dimensions never link; repeated
rows are copies that link; a null id never is a component's id unless all are null; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .components import components
from .grouping import join_hubs, map_groups
from .vectors import by_dimension, fine, kind_of, stacked

MISS = 1e-6
#: Standard deviations of the confidence bound.
SIGMAS = 5.0
BLOCK = 512
#: Bits of a key at most; reached at labels of 2^27 vectors, beyond which buckets grow with the rows.
MOST_BITS = 30


def plan(threshold: float, largest: int) -> tuple[int, int]:
    """(bits of a key, tables) for labels of up to ``largest`` vectors: random pairs seldom meet."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(8, min(MOST_BITS, math.ceil(math.log2(max(2, largest))) + 3))
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree**bits))


def rotations(dim: int, count: int, seed: int = 17) -> np.ndarray:
    """Random orthogonal matrices side by side: dim x (dim * count)."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(count)], 1)


def encode(x: np.ndarray, turn: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signs as packed bits, correction factors, table keys) of unit vectors."""
    dim = x.shape[1]
    turned = x @ turn
    first = turned[:, :dim]
    signs = turned[:, dim : dim + bits * tables] > 0
    keys = (signs.reshape(len(x), tables, bits) << np.arange(bits)).sum(2).astype("<u4")
    return np.packbits(first > 0, axis=1), np.abs(first).sum(1) / math.sqrt(dim), keys


def upper_bounds(turned: np.ndarray, codes: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Upper confidence bounds of the cosines of unit vectors (rotated) with coded ones."""
    dim = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    estimate = turned.astype(np.float32) @ signs.T / math.sqrt(dim) / factor[None]
    return estimate + SIGMAS * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1))[None]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.  Rows link if their labels are equal and their cosine is at least ``threshold``."""
    spark = vectors.sparkSession
    every = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label"))
    kind = kind_of(every, "v")
    takes_part = fine("v") & F.col("label").isNotNull()
    # A label of vectors of one dimension is a label of its own.
    part = every.where(takes_part).select("vec_id", F.concat_ws(":", F.size("v"), F.col("label").cast("string")).alias("label"), "v")
    id_kind = every.schema["vec_id"].dataType.simpleString()

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw: list[bytes] = [b""] * b.num_rows
            for at, x in by_dimension(b.column(2), kind):
                for i, r in zip(at.tolist(), x, strict=True):
                    raw[i] = r.tobytes()
            cls = [hashlib.md5(x + lab.encode(), usedforsecurity=False).digest() for x, lab in zip(raw, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cls, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "label", "cls", "v"])

    rows = part.mapInArrow(classify, f"vec_id {id_kind}, label string, cls binary, v binary")
    rows = stash(rows, "vectors")
    classes = rows.groupBy("cls").agg(F.min("vec_id").alias("min_id"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("v").alias("v"))
    largest = part.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(threshold, largest)

    def turn_of(dim: int) -> np.ndarray:
        return rotations(dim, 1 + -(-bits * tables // dim))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        step = max(64, 3_000_000 // (bits * tables))
        for b in batches:
            for at in range(0, b.num_rows, step):
                some = b.slice(at, step)
                raw = some.column(4).to_pylist()
                coded: list[tuple] = [()] * len(raw)
                length = np.array([len(r) for r in raw])
                for n in np.unique(length).tolist():
                    at_n = np.flatnonzero(length == n).tolist()
                    x = stacked([raw[i] for i in at_n], kind).astype(float)
                    x /= np.abs(x).max(1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    if x.shape[1] not in turns:
                        turns = {x.shape[1]: turn_of(x.shape[1])}
                    for i, c, f, k in zip(at_n, *encode(x, turns[x.shape[1]], bits, tables), strict=True):
                        coded[i] = (c.tobytes(), float(f), k.tobytes())
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(c, t) for c, t in zip(zip(*coded, strict=True), (pa.binary(), pa.float64(), pa.binary()), strict=True))], [*some.schema.names, "code", "factor", "keys"])

    classes = stash(classes.mapInArrow(code, f"cls binary, min_id {id_kind}, size long, label string, v binary, code binary, factor double, keys binary"), "classes")
    at_table = F.sequence(F.lit(0), F.lit(tables - 1))
    keys = F.transform(at_table, lambda t: F.struct(t.alias("t"), F.xxhash64("label", t, F.substring("keys", t * 4 + 1, F.lit(4))).alias("bucket")))
    members = classes.select(F.explode(keys).alias("k"), "cls").select("k.t", "k.bucket", "cls")
    buckets = members.groupBy("bucket").agg(F.min("t").alias("t"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y")).where("n > 1")
    buckets = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("t", "bucket")).alias("b")).select("b.bucket", "n")
    blocks = F.ceil(F.col("n") / BLOCK)
    at = members.join(buckets, "bucket").select("bucket", "t", "cls", F.pmod(F.xxhash64("cls"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("o"))
    at = stash(at.select("bucket", "t", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "cls"), "buckets")
    info = classes.select("cls", "size", "v", "code", "factor", "keys")

    def links(cols: list, lo: int, hi: int) -> list[tuple]:
        if hi - lo < 2:
            return []
        t, i, j, own = int(cols[1][lo]), cols[2][lo], cols[3][lo], np.asarray(cols[4][lo:hi])
        cls, size = cols[5][lo:hi], np.asarray(cols[6][lo:hi])
        raw = stacked(cols[7][lo:hi], kind).astype(float)
        unit = raw / np.abs(raw).max(1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        code, factor, keys = stacked(cols[8][lo:hi], np.uint8), np.asarray(cols[9][lo:hi]), stacked(cols[10][lo:hi], "<u4")
        a, b = (np.flatnonzero(own == i), np.flatnonzero(own == j)) if i != j else (np.arange(hi - lo),) * 2
        if not len(a) or not len(b):
            return []
        maybe = upper_bounds(unit[a] @ rotation(unit.shape[1]), code[b], factor[b]) >= threshold
        if i == j:
            maybe &= np.arange(len(a))[:, None] < np.arange(len(b))[None]
        x, y = np.nonzero(maybe)
        x, y = a[x], b[y]
        sums, group, out = np.zeros(hi - lo, np.int64), list(range(hi - lo)), []
        for s in range(0, len(x), 50_000):
            p, q = x[s : s + 50_000], y[s : s + 50_000]
            cos = (unit[p] * unit[q]).sum(1)
            keep = cos >= threshold
            p, q = p[keep], q[keep]
            first = (keys[p] == keys[q]).argmax(1) == t
            p, q = p[first], q[first]
            np.add.at(sums, p, size[q])
            np.add.at(sums, q, size[p])
            for u, w in zip(p.tolist(), q.tolist(), strict=True):
                while group[u] != u:
                    u = group[u]
                while group[w] != w:
                    w = group[w]
                if u != w:
                    group[max(u, w)] = min(u, w)
                    out.append((cls[u], cls[w], 0))
        out += [(cls[k], None, int(sums[k])) for k in np.flatnonzero(sums).tolist()]
        return out

    memo: dict[int, np.ndarray] = {}

    def rotation(dim: int) -> np.ndarray:
        if dim not in memo:
            memo[dim] = rotations(dim, 1)
        return memo[dim]

    found = map_groups(at.join(info, "cls").select("bucket", "t", "i", "j", "own", "cls", "size", "v", "code", "factor", "keys"), ["bucket", "t", "i", "j"], links, "a binary, b binary, w long")
    found = stash(found, "links")
    root = components(found.where("b is not null")).select(F.col("node").alias("cls"), "root")
    more = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("w").alias("w"))
    known = classes.select("cls", "min_id", "size").join(root, "cls", "left").join(more, "cls", "left")
    known = stash(known.select("cls", "min_id", "size", F.coalesce("root", "cls").alias("root"), (F.coalesce("w", F.lit(0).cast("long")) + F.col("size") - 1).alias("n_links")), "known")
    least = known.groupBy("root").agg(F.min("min_id").alias("component_id"), F.count("*").alias("n"))
    total = known.agg(F.count("*").alias("classes"), F.coalesce(F.sum("size"), F.lit(0)).alias("rows")).first()
    known = join_hubs(known, least, "root", "n", total["classes"]).select("cls", "n_links", "component_id", "size")
    inside = join_hubs(rows.select("vec_id", "cls"), known, "cls", "size", total["rows"]).select("vec_id", "n_links", "component_id")
    outside = every.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = inside.union(outside)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
