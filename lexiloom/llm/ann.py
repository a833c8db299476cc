"""Approximate nearest neighbours by learned partitions.

On a sample of ``SAMPLE_A_PART`` rows a part the graph of nearest neighbours is cut into parts of
equal size with few edges between them, and a small classifier learns the parts of a vector's
neighbours.  There are a quarter of the root of the rows of parts, 2 at least and ``MOST_PARTS`` at most
(from 17 million rows on, beyond which parts grow with the rows).  Every row is indexed in its likeliest
part.  A query goes to its likeliest parts, as many as a held-out part of the sample needs for
``RECALL``, and to more while they hold too few rows; their rows are ranked by exact inner products
in double precision.

Of equal vectors only the ``k + 1`` rows with the smallest ids can be among anyone's nearest, so
the others need no place in the index.  Parts and their queries meet in blocks of bounded size.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor
do null ids; only vectors of one dimension are compared, and those of each dimension but the
commonest are a part of their own, searched whole; repeated rows count once; ties go to the
smaller id; with fewer candidates all are returned; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .grouping import map_groups
from .vectors import by_dimension, fine, kind_of, matrix, stacked

SAMPLE, SAMPLE_A_PART, HELD_OUT = 6_144, 96, 256
NEIGHBOURS = 10
MOST_PARTS = 1_024
RECALL = 0.96
HIDDEN, EPOCHS = 128, 60
BLOCK, QUERY_BLOCK = 4_096, 1_024


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    out = np.zeros((len(x), min(k, len(x) - 1)), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, out.shape[1] - 1, 1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, passes: int = 8, seed: int = 5) -> np.ndarray:
    """Part of each vertex: median splits to begin with, then moves and swaps that save edges, within the size bound."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            part[rows] = first
            continue
        a, b = x[rng.choice(rows)], x[rng.choice(rows)]
        order = rows[np.argsort(x[rows] @ (a - b), kind="stable")]
        half = n // 2
        cut = len(rows) * half // n
        todo += [(order[:cut], first, half), (order[cut:], first + half, n - half)]
    most = int(np.ceil(len(x) / parts * 1.1))
    size = np.bincount(part, minlength=parts)
    near: list[list[int]] = [[] for _ in range(len(x))]
    for i, js in enumerate(graph.tolist()):
        near[i] += js
        for j in js:
            near[j].append(i)
    for _ in range(passes):
        moved = 0
        for i in rng.permutation(len(x)).tolist():
            count = np.bincount(part[near[i]], minlength=parts)
            own = part[i]
            count[size >= most] = -1
            best = int(count.argmax())
            if best != own and count[best] > np.count_nonzero(part[near[i]] == own):
                size[own] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A perceptron with one hidden layer: vector to log odds of the parts."""

    def __init__(self, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray, scale: float):
        self.w1, self.b1, self.w2, self.b2, self.scale = w1, b1, w2, b2, scale

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, seed: int = 11) -> Router:
    """Fit by Adam to soft targets: the shares of parts among each vector's neighbours, its own counting twice."""
    rng = np.random.default_rng(seed)
    d, each = x.shape[1], graph.shape[1] + 2
    scale = 1.0 / max(float(np.sqrt((x * x).mean())), 1e-30)
    p = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    xs = x * scale
    for _ in range(EPOCHS if parts > 1 else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            h = np.maximum(xs[rows] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            q = np.exp(z - z.max(1, keepdims=True))
            g = q / q.sum(1, keepdims=True)
            np.subtract.at(g, (np.repeat(np.arange(len(rows)), graph.shape[1]), part[graph[rows]].ravel()), 1 / each)
            g[np.arange(len(rows)), part[rows]] -= 2 / each
            g /= len(rows)
            gh = (g @ p[2].T) * (h > 0)
            step += 1
            for k, gr in enumerate((xs[rows].T @ gh + 1e-5 * p[0], gh.sum(0), h.T @ g + 1e-5 * p[2], g.sum(0))):
                m[k] += 0.1 * (gr - m[k])
                v[k] += 0.001 * (gr * gr - v[k])
                p[k] -= 0.002 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*p, scale)


def learn(sample: np.ndarray, parts: int, k: int) -> tuple[Router, int]:
    """Router and the number of parts a query needs, as held-out vectors of the sample show."""
    if parts == 1:
        x = sample[:1] if len(sample) else np.ones((1, 1))
        return train_router(x, np.zeros(1, np.int64), np.zeros((1, 0), np.int64), 1), 1
    n_held = min(HELD_OUT, len(sample) // 4)
    held, rest = sample[:n_held], sample[n_held:]
    graph = neighbour_graph(rest)
    part = balanced_parts(rest, graph, parts)
    router = train_router(rest, part, graph, parts)
    home = router.logits(rest).argmax(1)
    true = np.argsort(-(held @ rest.T), 1, kind="stable")[:, :k]
    order = np.argsort(-router.logits(held), 1, kind="stable")
    place = np.argsort(order, 1)  # rank of each part for each query
    ranks = np.take_along_axis(place, home[true], 1)
    share = [(ranks < n).mean() for n in range(1, parts + 1)]
    return router, 1 + next(i for i, s in enumerate(share) if s >= RECALL)


def parts_of(n: int) -> int:
    """Parts for so many rows; under 16 rows there is nothing to cut."""
    return 1 if n < 16 else max(2, min(MOST_PARTS, math.ceil(math.sqrt(n) / 4)))


def nearest(vectors: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product found for each row that ``is_query`` marks.

    ``report`` takes the number of parts and the share of the rows that a query reads.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")).where(fine("v") & F.col("vec_id").isNotNull())
    kind = kind_of(rows, "v")
    best = Window.partitionBy("v").orderBy("vec_id")
    once = rows.distinct()
    kept = stash(once.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("vec_id", "v", F.lit(False).alias("query")), "rows")
    common = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim, n = (common[0]["d"], common[0]["count"]) if common else (0, 0)
    parts = parts_of(n)
    of_dim = kept.where(F.size("v") == dim)
    share = max(SAMPLE, SAMPLE_A_PART * parts)
    h = F.xxhash64("vec_id")
    drawn = of_dim.where(h / 2.0**64 + 0.5 <= min(1.0, 2 * share / max(n, 1))).orderBy(h, "vec_id").limit(share).select("v").toArrow()["v"].combine_chunks()
    router, probes = learn(matrix(drawn, kind).astype(float), parts, k)
    sent = spark.sparkContext.broadcast(router)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in by_dimension(b.column(1), kind):
                home = -x.shape[1] if x.shape[1] != dim else sent.value.logits(x.astype(float)).argmax(1) if parts > 1 else 0
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(home, len(x)).astype(np.int32)), b.column(0).take(pa.array(at)), pa.array([r.tobytes() for r in x], pa.binary())], ["part", "vec_id", "v"])

    index = stash(kept.select("vec_id", "v").mapInArrow(assign, "part int, vec_id long, v binary"), "index")
    size = np.zeros(parts, np.int64)
    for r in index.where("part >= 0").groupBy("part").count().collect():  # one row a part
        size[r["part"]] = r["count"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                for rows_at, x in by_dimension(some.column(1), kind):
                    raw = [r.tobytes() for r in x]
                    if x.shape[1] != dim or parts == 1:
                        who, go = np.arange(len(x)), np.full(len(x), 0 if x.shape[1] == dim else -x.shape[1])
                    else:
                        order = np.argsort(-sent.value.logits(x.astype(float)), 1, kind="stable")
                        few = (np.cumsum(size[order], 1) - size[order]) < 4 * (k + 1)  # the parts before hold too few rows
                        who, col = np.nonzero(few | (np.arange(parts)[None] < probes))
                        go = order[who, col]
                    yield pa.RecordBatch.from_arrays([pa.array(go, pa.int32()), some.column(0).take(pa.array(rows_at[who])), pa.array([raw[i] for i in who], pa.binary())], ["part", "vec_id", "v"])

    asked = once.where(F.expr(is_query)).select("vec_id", "v").mapInArrow(route, "part int, vec_id long, v binary")
    asked = stash(asked, "queries")
    if report is not None:
        reads = asked.where("part >= 0").groupBy("part").count().collect()  # one row a part
        total = max(1, sum(r["count"] for r in reads))
        who = max(1, asked.where("part >= 0").select("vec_id").distinct().count())
        report |= {"parts": parts, "parts_a_query": round(total / who, 1), "share_of_rows_read": round(sum(r["count"] * int(size[r["part"]]) for r in reads) / who / max(1, n), 3)}
    many = asked.groupBy("part").agg(F.count("*").alias("q"))
    held = index.groupBy("part").agg(F.count("*").alias("d"))
    blocks = held.join(many, "part").select("part", F.ceil(F.col("d") / BLOCK).alias("di"), F.ceil(F.col("q") / QUERY_BLOCK).alias("qi"))
    zero = F.lit(0).cast("long")
    data = index.join(F.broadcast(blocks), "part").select("part", F.pmod(h, "di").alias("i"), F.explode(F.sequence(zero, F.col("qi") - 1)).alias("j"), F.lit(0).alias("kind"), "vec_id", "v")
    ask = asked.join(F.broadcast(blocks), "part").select("part", F.explode(F.sequence(zero, F.col("di") - 1)).alias("i"), F.pmod(h, "qi").alias("j"), F.lit(1).alias("kind"), "vec_id", "v")

    def rank(cols: list, lo: int, hi: int) -> Iterator[tuple]:
        flag, ids = np.asarray(cols[3][lo:hi]), np.asarray(cols[4][lo:hi])
        x = stacked(cols[5][lo:hi], kind).astype(float)
        is_q = flag == 1
        q, d, qi, di = x[is_q], x[~is_q], ids[is_q], ids[~is_q]
        if not len(q) or not len(d):
            return
        s = q @ d.T
        s[qi[:, None] == di[None]] = -np.inf
        n_best = min(k, len(d))
        edge = -np.partition(-s, n_best - 1, 1)[:, n_best - 1]
        edge = edge - 1e-9 * (1 + np.abs(edge))
        for r in range(len(q)):
            near = np.flatnonzero((s[r] >= edge[r]) & (s[r] > -np.inf))
            exact = (q[r] * d[near]).sum(1)  # one order of summation: equal vectors get equal scores
            best = np.lexsort((di[near], -exact))[:k]
            yield int(qi[r]), di[near[best]].astype("<i8").tobytes(), exact[best].tobytes()

    def merge(cols: list, lo: int, hi: int) -> Iterator[tuple]:
        ids = np.frombuffer(b"".join(cols[1][lo:hi]), "<i8")
        scores = np.frombuffer(b"".join(cols[2][lo:hi]), "<f8")
        for r, c in enumerate(np.lexsort((ids, -scores))[:k].tolist(), 1):
            yield int(cols[0][lo]), r, int(ids[c]), float(scores[c])

    # One row for each query and block, with its best few, then one merge for each query.
    found = map_groups(data.union(ask), ["part", "i", "j"], rank, "query_id long, ids binary, scores binary")
    return map_groups(found, ["query_id"], merge, "query_id long, rank int, vec_id long, score double")
