"""Toxicity scores from averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams and of itself; its vector is their mean, and a
text's vector is the mean of its words'.  A two-class softmax reads it.  Embeddings and softmax
are fitted together by Adam on a bounded sample of labelled rows (``SAMPLE_TOXIC`` and
``SAMPLE_CLEAN`` documents of any length, taken in the order of a hash of their ids).  An unseen
misspelling shares most n-gram vectors with the word it comes from.

A text is read in overlapping windows of ``WINDOW`` words, whole and to its end; its score is the
highest of its windows', so that a long text doesn't dilute a toxic passage.  In training too a
document's likeliest window stands for it; all its windows are read where it lies, and the
``SENT_WINDOWS`` with the highest class ratio of their buckets go to the driver.

Defined cases: a null or empty text gets the score of the bias alone; without labelled rows all
scores are 0; a repeated label row counts once, the larger label holds; repeated documents count
once, the smallest text of an id holds; null labels and null texts teach nothing; other columns are
ignored, and a kept one named ``score`` gives way to the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .caches import BoundedCache, give_back, hold, in_groups
from .common import mix, segments, stash, words_of

BUCKETS = 1 << 16
DIMS = 4
GRAMS = (3, 4, 5)
WINDOW = 128
#: Bytes of a text turned into words at a time.
SEGMENT = 1 << 16
#: The bounded training sample: at most so many documents of each class, and windows of each.
SAMPLE_TOXIC, SAMPLE_CLEAN, SENT_WINDOWS = 1_000, 2_000, 16
EPOCHS = 150
#: A bucket takes part if the classes' shares of documents with it differ by so many standard errors.
#: Only what these buckets hold of the sample reaches the driver.
LEAST_Z = 4.0
DECAY = 2e-6
#: Bytes of a worker's cache of words and their log odds.
CACHE_BYTES = 40 << 20


def bag(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how many each word has): of the words and their character n-grams, with marks at both ends."""
    whole = [f"<{w.decode('utf-8', 'replace').lower()}>" for w in words]
    n = np.fromiter(map(len, whole), np.int64, len(whole))
    ends = np.cumsum(n)
    char = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    left = np.repeat(ends, n) - np.arange(len(char))  # characters from here to the word's end
    owner = np.repeat(np.arange(len(whole)), n)
    rolled, found, owners = char.copy(), [], []
    for size in range(2, max(GRAMS) + 1):
        rolled = rolled[: len(char) - size + 1] * np.uint64(0x9E3779B97F4A7C15) + char[size - 1 :]
        if size in GRAMS:
            at = np.flatnonzero(left[: len(rolled)] >= size)
            found.append(mix(rolled[at] + np.uint64(size)))
            owners.append(owner[at])
    found.append(np.fromiter((xxh3_64_intdigest(w) for w in whole), np.uint64, len(whole)))
    owners.append(np.arange(len(whole)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(BUCKETS)).astype(np.int32), np.bincount(owner, minlength=len(whole))


def _windows(n: int) -> list[tuple[int, int]]:
    if n <= WINDOW:
        return [(0, n)]
    return [(at, min(n, at + WINDOW)) for at in range(0, n - WINDOW // 2, WINDOW // 2)]


def _rows(text: str, seen: np.ndarray, odds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of a text's windows, of the buckets that take part: the likeliest, in order."""
    found: list[tuple[float, int, np.ndarray, np.ndarray]] = []
    words: list[bytes] = []
    at = 0
    pieces = [*segments(text.encode(), SEGMENT)]
    for k, segment in enumerate(pieces):
        words += words_of(segment)
        last = k == len(pieces) - 1
        while words and (len(words) >= WINDOW + WINDOW // 2 or last):
            hi = min(len(words), WINDOW)
            b, n = bag(words[:hi])
            keep = seen[b]
            ids, place = np.unique(b[keep], return_inverse=True)
            vals = np.bincount(place, np.repeat(1.0 / (n * hi), n)[keep], len(ids))
            found.append((-float(vals @ odds[ids]), at, ids, vals.astype(np.float32)))
            if len(found) > 2 * SENT_WINDOWS:
                found = sorted(found, key=lambda f: f[:2])[:SENT_WINDOWS]
            at += 1
            if len(words) <= WINDOW:
                break
            words = words[WINDOW // 2 :]
    found = sorted(found, key=lambda f: f[:2])[:SENT_WINDOWS]
    return [f[2:] for f in sorted(found, key=lambda f: f[1])]


def significant(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Buckets whose shares of documents differ between the classes by ``LEAST_Z`` standard errors."""
    n1, n0 = max(1, n_toxic), max(1, n_clean)
    rate = (toxic + clean + 0.5) / (n1 + n0 + 1)
    return np.abs(toxic / n1 - clean / n0) >= LEAST_Z * np.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0))


class Model:
    def __init__(self, embed: np.ndarray, softmax: np.ndarray, bias: float):
        self.embed, self.softmax, self.bias = embed, softmax, bias
        self.logit_of = embed @ softmax
        self.cache = BoundedCache(self.words, CACHE_BYTES)

    def words(self, words: list[bytes]) -> list[float]:
        """Log odds of each word: the softmax of the mean of its vectors."""
        b, n = bag(words)
        return (np.add.reduceat(self.logit_of[b], np.r_[0, np.cumsum(n)[:-1]]) / n).tolist()

    def scores(self, texts: list[str | None]) -> list[float]:
        out: list[float] = []
        for group in in_groups(texts):
            if len(group) == 1:
                parts = [words_of(s) for s in segments((group[0] or "").encode())]
                values = [np.concatenate([np.fromiter(map(self.cache.values(set(w)).__getitem__, w), np.float64, len(w)) for w in parts])]
            else:
                parts = [words_of((t or "").encode()) for t in group]
                known = self.cache.values(set().union(*parts)).__getitem__
                values = [np.fromiter(map(known, w), np.float64, len(w)) for w in parts]
            out += map(self._best, values)
        return out

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]

    def _best(self, values: np.ndarray) -> float:
        best = self.bias
        if len(values):
            total = np.r_[0.0, np.cumsum(values)]
            lo, hi = np.array(_windows(len(values))).T
            best += float(((total[hi] - total[lo]) / (hi - lo)).max())
        return 1 / (1 + math.exp(-min(max(best, -500.0), 500.0)))


def train(windows: list[list[tuple[np.ndarray, np.ndarray]]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit embeddings and softmax jointly; each document counts through its likeliest window."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMS))
    softmax, bias = rng.normal(0, 0.5, DIMS), 0.0
    flat = [w for ws in windows for w in ws]
    owner = np.repeat(np.arange(len(windows)), [len(ws) for ws in windows])
    ids, vals = np.concatenate([w[0] for w in flat]), np.concatenate([w[1] for w in flat])
    row = np.repeat(np.arange(len(flat)), [len(w[0]) for w in flat])
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.bincount(row, minlength=len(flat))
    cuts, full = np.r_[0, np.cumsum(sizes)[:-1]], sizes > 0
    weight = np.full(len(labels), 1.0 / len(labels))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (embed, softmax, np.zeros(1))]
    for step in range(1, epochs + 1):
        vec = np.zeros((len(flat), DIMS))
        for d in range(DIMS):
            vec[full, d] = np.add.reduceat(embed[ids, d] * vals, cuts[full])
        logit = vec @ softmax + bias
        top = np.maximum.reduceat(logit, first)
        share = np.exp(np.minimum(0.0, logit - top[owner]) * (1.0 + 4.0 * step / epochs))
        share /= np.add.reduceat(share, first)[owner]
        pooled = np.add.reduceat(share * logit, first)
        g = (1 / (1 + np.exp(-np.clip(pooled, -60, 60))) - labels) * weight
        gw = share * g[owner]
        grads = [np.empty_like(embed), vec.T @ gw + 1e-5 * softmax, np.array([g.sum()])]
        push = vals * gw[row]
        per_bucket = np.bincount(ids, push, BUCKETS)
        for d in range(DIMS):
            grads[0][:, d] = per_bucket * softmax[d] + DECAY * embed[:, d]
        rates, values = (0.3, 0.3, 0.1), [embed, softmax, np.array([bias])]
        for (m, v), gr, rate, p in zip(state, grads, rates, values, strict=True):
            m += 0.1 * (gr - m)
            v += 0.01 * (gr * gr - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias = float(values[2][0])
        embed[np.abs(embed) < 1e-12] = 0.0
    embed[~np.isin(np.arange(BUCKETS), ids)] = 0.0
    return Model(embed, softmax, bias)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> Model | None:
    """Train on a bounded sample of ``docs(doc_id, text)`` with ``labels(doc_id, <label_col>)``; None without labels."""
    y = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.where("text is not null")
    y = y.join(texts.select("doc_id"), "doc_id", "left_semi")  # before the limits, so that no other id takes a place
    order = F.xxhash64("doc_id")
    ids = y.where("y = 1").orderBy(order, "doc_id").limit(SAMPLE_TOXIC).union(y.where("y = 0").orderBy(order, "doc_id").limit(SAMPLE_CLEAN))
    sample = texts.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = stash(sample.select("doc_id", "y", "text"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BUCKETS), np.int64)
        docs_of = np.zeros(2, np.int64)
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs_of[y] += 1
                inside = np.zeros(BUCKETS, bool)
                for segment in segments(t.encode(), SEGMENT):
                    if words := list(set(words_of(segment))):
                        inside[bag(words)[0]] = True
                held[y] += inside
        y, at = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[y, 0, 1], pa.int32()), pa.array(np.r_[at, -1, -1], pa.int32()), pa.array(np.r_[held[y, at], docs_of])], ["y", "bucket", "n"])

    counts = sample.select("y", "text").mapInArrow(count, "y int, bucket int, n long").groupBy("bucket").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic")).toArrow()
    bucket, clean, toxic = (counts[c].to_numpy() for c in ("bucket", "clean", "toxic"))
    held, total = np.zeros((2, BUCKETS), np.int64), (int(clean[bucket < 0].sum()), int(toxic[bucket < 0].sum()))
    held[0, bucket[bucket >= 0]], held[1, bucket[bucket >= 0]] = clean[bucket >= 0], toxic[bucket >= 0]
    odds = np.log((held[1] + 0.5) / (total[1] + 1)) - np.log((held[0] + 0.5) / (total[0] + 1))
    sent = docs.sparkSession.sparkContext.broadcast((significant(held[1], held[0], total[1], total[0]), odds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                rows = [(d, y, n, i.astype(np.int32).tobytes(), v.tobytes()) for d, y, t in zip(*(c.to_pylist() for c in some.columns), strict=True) for n, (i, v) in enumerate(_rows(t, *sent.value))]
                cols = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [some.column(0).type, pa.int32(), pa.int32(), pa.binary(), pa.binary()], strict=True)], ["doc_id", "y", "n", "ids", "vals"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"doc_id {kind}, y int, n int, ids binary, vals binary").toArrow().sort_by([("doc_id", "ascending"), ("n", "ascending")])
    windows: list[list] = []
    ys: list[int] = []
    last = object()
    for d, y1, i, v in zip(*(got[c].to_pylist() for c in ("doc_id", "y", "ids", "vals")), strict=True):
        if d != last:
            windows.append([])
            ys.append(y1)
            last = d
        windows[-1].append((np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)))
    del got
    model = train(windows, np.array(ys)) if any(len(w[0]) for ws in windows for w in ws) else None
    windows.clear()
    give_back()
    return model


def score_toxicity(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns and ``score`` (0 to 1) of each whole text."""
    keep = tuple(k for k in keep if k != "score")
    src = docs.select(*keep, docs[text_col].alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model and (model.embed.astype(np.float32), model.softmax, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value and Model(*sent.value)
        hold("toxicity", lambda: own and own.cache.clear())
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                texts = some.column(some.num_columns - 1).to_pylist()
                scores = own.scores(texts) if own else [0.0] * len(texts)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(scores, pa.float64())], [*keep, "score"])
        if own:
            own.cache.clear()

    return src.mapInArrow(run, T.StructType([*src.schema.fields[:-1], T.StructField("score", T.DoubleType())]))
