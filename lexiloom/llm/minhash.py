"""Near-duplicate documents by one-permutation MinHash.

One hash of each shingle decides both its bin and its value; the least value of a bin is its
minimum.  Empty bins borrow from a full one that a per-bin probe sequence finds (optimal
densification), so all bins agree with the Jaccard similarity as probability.  Bands of bins are
bucket keys.  Equal sets are one class from the start, so copies make no pairs.

1. Buckets of classes; of buckets with the same members one stays.  Large ones are dealt out in
   blocks.  In a block each group of similar signatures gives a star of candidate edges around
   its busiest member, so edges are fewer than members.
2. Components of the candidate edges are clusters.  Edges are confirmed on full shingle sets.
3. In clusters that the confirmed links leave in several parts, signatures of all members outside
   the largest part meet the others', in blocks; near ones of different parts are confirmed on
   full sets in place, and a spanning set of links leaves the block.
4. Components of all links.

The chance that two documents at the threshold share no band is at most ``MISS``; a signature
rejects a pair only ``SIGMAS`` standard deviations below the threshold.  There is no cap on
bucket, cluster or partner counts.

Defined cases: without a word (null, empty, white space) a document has an empty set, links with
nothing and is kept; fewer words than a shingle count as one shingle; repeated rows are copies of
one another; a null ``doc_id`` never is a component's id unless all are null; an empty table gives
no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import hold
from .common import mix, segments, stash, words_of
from .components import components
from .grouping import join_hubs, map_groups

WORDS = 5
BAND_ROWS = 6
MISS = 1e-6
SIGMAS = 4.5
BLOCK = 256
#: Bits of the filter that keeps documents of candidate classes; more candidates only pass more.
FILTER_BITS = 1 << 23


def band_count(threshold: float, rows: int = BAND_ROWS) -> int:
    return max(1, math.ceil(math.log(MISS) / math.log(1 - threshold**rows)))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    from xxhash import xxh3_64_intdigest

    parts = []
    for segment in segments((text or "").encode()):
        w = words_of(segment)
        parts.append(np.fromiter(map(xxh3_64_intdigest, w), np.uint64, len(w)))
    h = np.concatenate(parts)
    if not len(h):
        return h
    k, n = min(words, len(h)), max(1, len(h) - words + 1)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def signature(s: np.ndarray, bins: int) -> np.ndarray:
    """16 bits of each bin's minimum, empty bins filled by optimal densification."""
    bin_of = ((s >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # ascending, as s is
    first = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]])
    sig, full = np.zeros(bins, np.uint16), np.zeros(bins, bool)
    at = bin_of[first].astype(np.int64)
    sig[at], full[at] = (mix(s[first]) & np.uint64(0xFFFF)).astype(np.uint16), True
    if len(at) == 1:
        return np.full(bins, sig[at[0]])
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        attempt += 1
        probe = (mix(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
        found = full[probe]
        sig[empty[found]] = sig[probe[found]]
        empty = empty[~found]
    return sig


def _class_id(s: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(s.tobytes())


def sketch(docs: DataFrame, threshold: float, words: int = WORDS) -> DataFrame:
    """(doc_id, row_key, n_shingles, cls, sig) of ``docs(doc_id, text)``; cls and sig are null for empty sets."""
    bins = band_count(threshold) * BAND_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("minhash", lambda: None)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                sets = [shingle_set(t, words) for t in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_id(s) if len(s) else None for s in sets], pa.binary()), pa.array([signature(s, bins).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "row_key", "n_shingles", "cls", "sig"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("row_key"), "text").mapInArrow(run, f"doc_id {kind}, row_key string, n_shingles long, cls binary, sig binary")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cls, n, shingles) of the wanted classes, from a second look at the documents that can hold them."""
    bit = F.pmod(F.xxhash64("min_id"), F.lit(FILTER_BITS))
    got = wanted.select(bit.alias("p")).groupBy(F.floor(F.col("p") / 32).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 32))")).alias("bits")).toArrow()
    filled = np.zeros(FILTER_BITS // 32, np.uint32)
    filled[got["w"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    bits = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(1).to_numpy()
            hit = pa.array((bits.value[p >> 5] >> (p & 31).astype(np.uint32) & 1).astype(bool))
            some = b.filter(hit)
            for at in range(0, some.num_rows, 256):
                sets = [s for t in some.column(0).slice(at, 256).to_pylist() if len(s := shingle_set(t, words))]
                yield pa.RecordBatch.from_arrays([pa.array([_class_id(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["cls", "n", "shingles"])

    seen = docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("p")).mapInArrow(run, "cls binary, n long, shingles binary")
    return seen.join(wanted.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))


def _near(sig_a: np.ndarray, n_a: np.ndarray, sig_b: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose sizes and signatures allow the threshold."""
    bins = sig_a.shape[1]
    out = np.zeros((len(n_a), len(n_b)), bool)
    for at in range(0, len(n_a), 64):
        rows = slice(at, at + 64)
        small, large = np.minimum(n_a[rows, None], n_b[None]), np.maximum(n_a[rows, None], n_b[None])
        agree = (sig_a[rows, None] == sig_b[None]).sum(-1, dtype=np.int32) / bins
        slack = SIGMAS * np.sqrt(threshold * (1 - threshold) / np.minimum(bins, large))
        out[rows] = (small >= threshold * large * (1 - 1e-12)) & (agree >= threshold - slack)
    return out


def _groups(pairs: np.ndarray) -> np.ndarray:
    """Smallest index of each item's component, from a matrix of symmetric links."""
    label = np.arange(len(pairs))
    linked = pairs | pairs.T | np.eye(len(pairs), dtype=bool)
    while True:
        new = np.where(linked, label[None], len(label)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def candidate_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): stars of candidates within buckets, of ``classes(cls, n, sig)``."""
    bands = band_count(threshold)
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (2 * BAND_ROWS) + 1, F.lit(2 * BAND_ROWS))))
    members = classes.select(F.explode(keys).alias("bucket"), "cls")
    buckets = members.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y")).where("size > 1")
    buckets = buckets.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket"))
    at = stash(members.join(buckets.select("bucket", "size"), "bucket"), "buckets")
    degree = at.groupBy("cls").agg(F.sum("size").alias("degree"))
    blocks = F.ceil(F.col("size") / BLOCK)
    info = degree.join(classes, "cls")
    own = F.pmod(F.xxhash64("cls"), blocks)
    dealt = at.select("bucket", "cls", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls")

    def stars(cols: list, lo: int, hi: int) -> list[tuple]:
        if hi - lo < 2:
            return []
        cls, degree, n = cols[3][lo:hi], np.asarray(cols[4][lo:hi]), np.asarray(cols[5][lo:hi])
        sig = np.frombuffer(b"".join(cols[6][lo:hi]), np.uint16).reshape(hi - lo, -1)
        order = sorted(range(hi - lo), key=lambda i: (-degree[i], cls[i]))
        near = _near(sig, n, sig, n, threshold)
        label = _groups(near[np.ix_(order, order)])
        return [(cls[order[c]], cls[order[k]]) for k, c in enumerate(label.tolist()) if c != k]

    return map_groups(dealt.join(info, "cls").select("bucket", "i", "j", "cls", "degree", "n", "sig"), ["bucket", "i", "j"], stars, "a binary, b binary").distinct()


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.searchsorted(a, b)
    both = int((a[np.minimum(both, len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges whose full sets are similar enough.  Members meet their star's centre in blocks."""
    size = edges.groupBy("a").agg(F.count("*").alias("size"), F.count("*").alias("n"))
    e = join_hubs(edges, size, "a", "n", edges.count()).select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / BLOCK)).alias("i"), "b")
    both = e.select("a", "i", "b", F.lit(1).alias("kind")).union(e.select("a", "i", F.col("a").alias("b"), F.lit(0).alias("kind")).distinct())
    rows = both.join(sets.select(F.col("cls").alias("b"), "shingles"), "b").select("a", "i", "kind", "b", "shingles")

    def run(cols: list, lo: int, hi: int) -> list[tuple]:
        centre = np.frombuffer(cols[4][lo], "<u8")
        return [(cols[0][lo], cols[3][k]) for k in range(lo + 1, hi) if _linked(centre, np.frombuffer(cols[4][k], "<u8"), percent)]

    return map_groups(rows, ["a", "i"], run, "a binary, b binary", ("kind",))


def _rest(edges: DataFrame, links: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between parts of a cluster that no confirmed edge joins yet, a spanning set of each block."""
    threshold = percent / 100
    cluster = components(edges).select(F.col("node").alias("cls"), F.col("root").alias("cluster"))
    part = components(links).select(F.col("node").alias("cls"), F.col("root").alias("part"))
    at = stash(cluster.join(part, "cls", "left").withColumn("part", F.coalesce("part", "cls")), "clusters")
    parts = at.groupBy("cluster", "part").agg(F.count("*").alias("size"))
    top = parts.groupBy("cluster").agg(F.max(F.struct("size", "part")).alias("top"), F.sum("size").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    top = top.select("cluster", F.col("top.part").alias("main"), F.ceil((F.col("all") - F.col("top.size")) / BLOCK).alias("few"), F.ceil(F.col("top.size") / BLOCK).alias("many"), "all")
    m = join_hubs(at, top, "cluster", "all", at.count()).withColumn("h", F.xxhash64("cls"))
    inside = F.col("part") == F.col("main")
    zero = F.lit(0).cast("long")
    outer = m.where(~inside).withColumn("own", F.pmod("h", "few"))
    dealt = [
        outer.select("cluster", "cls", "part", "own", F.explode(F.sequence(zero, F.col("few") - 1)).alias("o")).select("cluster", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), F.lit(0).alias("kind"), "cls", "part"),
        outer.select("cluster", F.col("own").alias("i"), F.explode(F.sequence(zero, F.col("many") - 1)).alias("j"), F.lit(1).alias("kind"), "cls", "part"),
        m.where(inside).select("cluster", F.explode(F.sequence(zero, F.col("few") - 1)).alias("i"), F.pmod("h", "many").alias("j"), F.lit(1).alias("kind"), "cls", "part"),
    ]
    rows = dealt[0].union(dealt[1].select(*dealt[0].columns)).union(dealt[2].select(*dealt[0].columns))
    rows = rows.join(classes.join(sets.select("cls", "shingles"), "cls"), "cls").select("cluster", "kind", "i", "j", "cls", "part", "n", "sig", "shingles")

    def run(cols: list, lo: int, hi: int) -> list[tuple]:
        cls, parts, n = cols[4][lo:hi], cols[5][lo:hi], np.asarray(cols[6][lo:hi])
        if len(set(parts)) < 2:
            return []
        sig = np.frombuffer(b"".join(cols[7][lo:hi]), np.uint16).reshape(hi - lo, -1)
        group = {p: p for p in parts}

        def find(p: bytes) -> bytes:
            while group[p] != p:
                group[p] = group[group[p]]
                p = group[p]
            return p

        out, arrays = [], {}
        for x, y in np.argwhere(np.triu(_near(sig, n, sig, n, threshold), 1)).tolist():
            p, q = find(parts[x]), find(parts[y])
            if p != q:
                for k in (x, y):
                    if k not in arrays:
                        arrays[k] = np.frombuffer(cols[8][lo + k], "<u8")
                if _linked(arrays[x], arrays[y], percent):
                    group[max(p, q)] = min(p, q)
                    out.append((cls[x], cls[y]))
        return out

    return map_groups(rows, ["cluster", "kind", "i", "j"], run, "a binary, b binary")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, and row_key (md5 of the text), component (a key of the group).

    Documents link if 100 * intersection >= percent * union of their shingle sets.
    """
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    rows = stash(sketch(docs, percent / 100, words), "sketch")
    full = rows.where("cls is not null")
    classes = full.groupBy("cls").agg(F.count("*").alias("copies"), F.min("doc_id").alias("min_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = stash(classes, "classes")
    edges = stash(candidate_edges(classes.select("cls", "n", "sig"), percent / 100), "candidates")
    wanted = classes.join(edges.select(F.col("a").alias("cls")).union(edges.select("b")).distinct(), "cls", "left_semi")
    wanted = stash(wanted, "wanted")
    sets = stash(_sets(docs, wanted, words), "sets")
    links = stash(_confirm(edges, sets, percent), "links")
    more = stash(_rest(edges, links, wanted.select("cls", "n", "sig"), sets, percent), "more")
    root = components(links.union(more)).select(F.col("node").alias("cls"), "root")
    found = classes.select("cls", "min_id", "copies").join(root, "cls", "left").withColumn("component", F.coalesce("root", "cls"))
    found = stash(found.select("cls", "min_id", "copies", "component"), "found")
    least = found.groupBy("component").agg(F.min("min_id").alias("component_id"), F.count("*").alias("n"))
    total = found.agg(F.count("*").alias("classes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    found = join_hubs(found, least, "component", "n", total["classes"]).select("cls", "component", "component_id", "copies")
    out = join_hubs(full.select("doc_id", "n_shingles", "row_key", "cls"), found, "cls", "copies", total["rows"]).select("doc_id", "n_shingles", "component_id", "row_key", "component")
    empty = rows.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row_key", F.lit(None).cast("binary").alias("component"))
    return out.union(empty).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row_key", "component")
