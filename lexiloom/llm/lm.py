"""Language-model scores from a subword lattice.

A word's probability weights all its segmentations into pieces of an existing vocabulary: a
forward recursion in log space sums them.  A first piece comes from those that begin a word, then
others follow until the word ends; each choice is a proper distribution, so the words' marginals
sum to one at most.  The file's piece scores are merge ranks; by Zipf's law they are the pieces'
prior.  Expectation maximisation over all distinct training words adapts them: each round's
expected counts are added to the prior, which weighs as much as one occurrence a piece.

In the lattice of a word seen in training one more arc spans the whole word, with the weight of its
discounted count; the rest of the mass goes through the pieces, so the sum over all paths is

    P(word) = (c - D(c)) / N + M * marginal(word);   P(end) = c(end) / N

D(c) is Good and Turing's discount for c up to 3 (then as for 3), M the mass all discounts free.

Counts cover the whole training corpus and live in a table that grows with it.  Frequent words
(at most ``HOT_WORDS``) are sent to every task; the others' counts are joined.

A word of any length is scored whole; over ``LONG_WORD`` bytes the recursion keeps only as many
nodes as the longest piece has bytes, and learning reads such a word in blocks of that size.

Defined cases: a null text is an empty one, whose only token is the end; an empty training set
leaves N = 0, base probability 1 for each token and the lattice alone; repeated rows score alike;
a null ``doc_id`` hashes as the text 'null'; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import segments, stash, words_of

#: Words sent to every task; the bound makes the broadcast a few dozen MB at any corpus size.
HOT_WORDS = 1 << 17
#: Distinct words a task counts before it passes them on.
HELD_WORDS = 400_000
#: Rounds of expectation maximisation over all training words.
ROUNDS = 2
#: Bytes of the words whose lattices are summed together; longer words than the second go by themselves.
BATCH_BYTES, LONG_WORD = 1 << 15, 1 << 12
MARK = "▁"


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes with a leading ``MARK`` byte sequence where a word begins, and their log weights.

    Single bytes are always pieces, inside a word; so every word has a segmentation.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if piece == MARK * len(piece) or MARK in piece[1:]:
            continue
        raw = piece.encode()
        weight[raw] = max(weight.get(raw, 0.0), 1.0 / (2.0 - model.get_score(i)))
    weight[MARK.encode()] = max(weight.values())
    least = min(weight.values())
    for b in range(256):
        weight.setdefault(bytes([b]), least)
    pieces = sorted(weight)
    return pieces, np.log(np.array([weight[p] for p in pieces]))


class Lattice:
    """Marginal log probabilities of words under piece probabilities."""

    def __init__(self, pieces: list[bytes]):
        mark = MARK.encode()
        self.pieces = pieces
        self.starts = np.array([p.startswith(mark) for p in pieces])
        self.first = {p[len(mark) :]: i for i, p in enumerate(pieces) if p.startswith(mark)}
        self.inner = {p: i for i, p in enumerate(pieces) if not p.startswith(mark)}
        self.longest = max(map(len, self.inner), default=1)
        self.first_grows, self.inner_grows = ({p[:k] for p in t for k in range(len(p))} for t in (self.first, self.inner))

    def set(self, log_first: np.ndarray, log_end: float) -> None:
        """Log probabilities of each piece within its kind, and of the word's end."""
        self.logp, self.log_end = log_first, log_end

    def start(self, weights: np.ndarray) -> None:
        """From log weights of pieces: a proper distribution of each kind, the end at a third."""
        w = np.exp(weights)
        self.prior = np.where(self.starts, w / w[self.starts].sum(), w / w[~self.starts].sum())
        self.set(np.log(np.where(self.starts, self.prior, self.prior * (2 / 3))), math.log(1 / 3))

    def fit(self, expected: np.ndarray, ends: float) -> None:
        """From expected counts on top of the prior, which weighs one count a piece."""
        e = expected + self.prior * np.where(self.starts, self.starts.sum(), (~self.starts).sum())
        inner = e[~self.starts].sum() + ends + 1
        self.set(np.log(np.where(self.starts, e / e[self.starts].sum(), e / inner)), math.log((ends + 1) / inner))

    def arcs(self, words: list[bytes]) -> tuple[list[int], list[int], list[int], list[int]]:
        """(word, from, to, piece) of all arcs: node 0 is before the mark, node k + 1 after k bytes."""
        owner, src, dst, piece = [], [], [], []
        first, inner, grow_first, grow_inner = self.first, self.inner, self.first_grows, self.inner_grows
        for w, word in enumerate(words):
            n = len(word)
            for at in range(-1, n):
                table, grows, lo = (first, grow_first, 0) if at < 0 else (inner, grow_inner, at)
                for end in range(max(at + 1, 0), n + 1):
                    part = word[lo:end]
                    i = table.get(part)
                    if i is not None:
                        owner.append(w)
                        src.append(at + 1)
                        dst.append(end + 1)
                        piece.append(i)
                    if part not in grows:
                        break
        return owner, src, dst, piece

    def forward(self, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, float]:
        """Marginal natural log probability of each word; with counts also expected pieces and ends.

        All words advance together, one node at a time: the arcs of a batch that reach node k are
        gathered, and their sums taken in log space.
        """
        owner, *flat = (np.array(x, np.int64) for x in self.arcs(words))
        flat = np.stack(flat, 1)
        nodes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        base = np.r_[0, np.cumsum(nodes)]
        score = self.logp[flat[:, 2]]
        src, dst = base[owner] + flat[:, 0], base[owner] + flat[:, 1]
        alpha = np.full(base[-1], -np.inf)
        alpha[base[:-1]] = 0.0
        by = np.argsort(flat[:, 1], kind="stable")
        cuts = np.searchsorted(flat[by, 1], np.arange(1, int(nodes.max(initial=1)) + 1))
        steps = [by[lo:hi] for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for arc in steps:
            _log_add(alpha, dst[arc], alpha[src[arc]] + score[arc])
        total = alpha[base[1:] - 1] + self.log_end
        if counts is None:
            return total, None, 0.0
        beta = np.full(base[-1], -np.inf)
        beta[base[1:] - 1] = self.log_end
        by = np.argsort(-flat[:, 0], kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(flat[by, 0])) + 1, len(by)]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            arc = by[lo:hi]
            _log_add(beta, src[arc], beta[dst[arc]] + score[arc])
        used = np.exp(alpha[src] + score + beta[dst] - total[owner]) * counts[owner]
        return total, np.bincount(flat[:, 2], used, len(self.pieces)), float(counts.sum())

    def score(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for some in batched(words):
            if len(words[some[0]]) > LONG_WORD:
                out[some] = [self.rolling(words[i]) for i in some]
            else:
                out[some] = self.forward([words[i] for i in some])[0]
        return out

    def rolling(self, word: bytes) -> float:
        """The same sum for one word, with no more nodes held than the longest piece has bytes."""
        logp, n, size = self.logp.tolist(), len(word), max(self.longest, max(map(len, self.first))) + 1
        waiting: list[list[float]] = [[] for _ in range(size)]
        for p, i in self.first.items():
            if word.startswith(p):
                waiting[len(p)].append(logp[i])
        inner, grows = self.inner, self.inner_grows
        for at in range(n + 1):
            sums, waiting[at % size] = waiting[at % size], []
            top = max(sums, default=-math.inf)
            here = top + math.log(sum(math.exp(x - top) for x in sums)) if top > -math.inf else top
            if at == n:
                return here + self.log_end
            for end in range(at + 1, min(n, at + size) + 1):
                part = word[at:end]
                i = inner.get(part)
                if i is not None:
                    waiting[end % size].append(here + logp[i])
                if part not in grows:
                    break
        raise AssertionError("unreachable")


def batched(words: list[bytes]) -> Iterator[list[int]]:
    """Places of the words in order of length, as many together as have ``BATCH_BYTES``; long ones alone."""
    batch: list[int] = []
    held = 0
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if batch and (held + len(words[i]) > BATCH_BYTES or len(words[i]) > LONG_WORD):
            yield batch
            batch, held = [], 0
        batch.append(i)
        held += len(words[i]) + 8
    if batch:
        yield batch


def _log_add(into: np.ndarray, where: np.ndarray, value: np.ndarray) -> None:
    """into[where] = log(exp(into[where]) + sum of exp(value)), for repeated targets."""
    if not len(where):
        return
    order = np.argsort(where, kind="stable")
    where, value = where[order], value[order]
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    top = np.maximum(np.maximum.reduceat(value, first), into[where[first]])
    safe = np.where(np.isfinite(top), top, 0.0)
    total = np.add.reduceat(np.exp(value - np.repeat(safe, np.diff(np.r_[first, len(where)]))), first) + np.exp(into[where[first]] - safe)
    with np.errstate(divide="ignore"):
        into[where[first]] = safe + np.log(total)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, c_all): counts in rows marked ``train`` and in all rows of ``docs(text, train)``, for every distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        learnt: Counter = Counter()

        def batches_of() -> Iterator[pa.RecordBatch]:
            for c in learnt:
                seen[c] += 0
            words = list(seen)
            for at in range(0, len(words), 20_000):
                some = words[at : at + 20_000]
                a, b = [learnt[w] for w in some], [seen[w] for w in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(a, pa.int64()), pa.array([x + y for x, y in zip(a, b, strict=True)], pa.int64())], ["word", "c", "c_all"])
            seen.clear()
            learnt.clear()

        for b in batches:
            for text, train in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for segment in segments((text.as_py() or "").encode()):
                    (learnt if train else seen).update(words_of(segment))
                    if len(seen) + len(learnt) > HELD_WORDS:
                        yield from batches_of()
        yield from batches_of()

    parts = docs.select("text", "train").mapInArrow(run, "word binary, c long, c_all long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def fit_pieces(words: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> tuple[list[bytes], np.ndarray, float]:
    """Piece log probabilities by expectation maximisation over all distinct training words.

    What reaches the driver is one number for each piece of the fixed vocabulary.
    """
    pieces, weights = load_pieces(vocabulary)
    lattice = Lattice(pieces)
    lattice.start(weights)
    spark = words.sparkSession
    train = words.where("c > 0").select("word")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, lattice.logp, lattice.log_end))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Lattice(sent.value[0])
            own.set(*sent.value[1:])
            total, ends = np.zeros(len(own.pieces)), 0.0
            for b in batches:
                for at in range(0, b.num_rows, 8192):
                    some = [w[k : k + LONG_WORD] for w in b.column(0).slice(at, 8192).to_pylist() for k in range(0, max(1, len(w)), LONG_WORD)]
                    for places in batched(some):
                        _, used, n = own.forward([some[i] for i in places], np.ones(len(places)))
                        total += used
                        ends += n
            kept = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[kept, -1]), pa.array(np.r_[total[kept], ends])], ["piece", "used"])

        got = train.mapInArrow(run, "piece long, used double").groupBy("piece").agg(F.sum("used").alias("used")).toArrow()
        used, ends = np.zeros(len(pieces)), 0.0
        for p, u in zip(got["piece"].to_pylist(), got["used"].to_pylist(), strict=True):
            if p < 0:
                ends = u
            else:
                used[p] = u
        lattice.fit(used, ends)
        sent.unpersist()
    return pieces, lattice.logp, lattice.log_end


def discounts(n: list[int], types: int) -> tuple[np.ndarray, float]:
    """(discount by min(count, 3), freed counts), from the numbers of words that occur once to four times."""
    d = np.zeros(4)
    for c in (1, 2, 3):
        good = c - (c + 1) * n[c] / n[c - 1] if n[c - 1] and n[c] else 0.5
        d[c] = min(max(good, 0.1), c - 0.1)
    return d, float(d[1] * n[0] + d[2] * n[1] + d[3] * (types - n[0] - n[1]))


def score_documents(docs: DataFrame, vocabulary: str, train: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a SQL condition on ``doc_id`` that marks rows to learn from.  Scores are log10
    probabilities of the lower-cased words, each followed by the rest, then the end.
    """
    spark = docs.sparkSession
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("train", F.expr(train))
    counted = stash(count_words(src), "counts")
    sums = counted.agg(F.sum("c").alias("n"), F.sum(F.expr("int(c > 0)")).alias("v"), *(F.sum(F.expr(f"int(c = {k})")).alias(f"n{k}") for k in range(1, 5))).first()
    ends = src.where("train").count()
    n, types = (sums["n"] or 0) + ends, sums["v"] or 0
    v = types + (1 if ends else 0)
    discount, freed = discounts([sums[f"n{k}"] or 0 for k in range(1, 5)], types)
    model = fit_pieces(counted, vocabulary, rounds)
    sent = spark.sparkContext.broadcast(model)

    def logs(c: np.ndarray, marginal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        rest = math.log(freed / n) if n and freed else 0.0
        seen = np.where(c > 0, np.log(np.maximum(c - discount[np.minimum(c, 3).astype(int)], 1e-300) / max(n, 1)), -np.inf)
        return base, np.logaddexp(seen, rest + marginal) / math.log(10)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(sent.value[0])
        lattice.set(*sent.value[1:])
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                some = b.slice(at, 8192)
                base, logp = logs(some.column(1).to_numpy().astype(float), lattice.score(some.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(base), pa.array(logp)], ["word", "c", "c_all", "base", "logp"])

    words = stash(counted.mapInArrow(weigh, "word binary, c long, c_all long, base double, logp double"), "words")
    step = F.floor(F.log2("c_all") * 8)
    held, least = 0, 1 << 20
    for r in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # a few hundred steps
        held += r["count"]
        if held > HOT_WORDS:
            break
        least = r["step"]
    hot = words.where(step >= least).toArrow()
    table = spark.sparkContext.broadcast((hot["word"].to_pylist(), hot["c"].to_numpy(), hot["base"].to_numpy(), hot["logp"].to_numpy()))
    end_base = math.log10(((ends + 0.5) / (n + 0.5 * (v + 1)))) if n + v else math.log10(0.5 / 0.5)
    end_logp = math.log10(ends / n) if ends else 0.0

    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, base, logp = table.value
        place = {w: i for i, w in enumerate(names)}
        known = c > 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                out: list[list] = [[] for _ in range(9)]
                for k, text in enumerate(some.column(3)):
                    inside: Counter = Counter()
                    for segment in segments((text.as_py() or "").encode()):
                        inside.update(words_of(segment))
                    at_, n_, cold = [], [], []
                    for w, m in inside.items():
                        i = place.get(w)
                        if i is None:
                            cold.append((w, m))
                        else:
                            at_.append(i)
                            n_.append(m)
                    i, m = np.array(at_, np.int64), np.array(n_, np.int64)
                    n_tokens = int(m.sum()) + sum(x for _, x in cold) + 1
                    rows = [(None, None, n_tokens, int(m[known[i]].sum()) + (1 if ends else 0), float(m @ base[i]) + end_base, float(m @ logp[i]) + end_logp)]
                    rows += [(w, x, None, None, None, None) for w, x in cold]
                    for col, values in zip(out[3:], zip(*rows, strict=True), strict=True):
                        col += values
                    out[0] += [k] * len(rows)
                take = pa.array(out[0], pa.int64())
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([some.column(0).take(take), some.column(1).take(take), some.column(2).take(take), *(pa.array(x, t) for x, t in zip(out[3:], kinds, strict=True))], ["doc_id", "row_key", "train", "word", "m", "n_tokens", "n_known", "base", "logp"])

    keyed = src.select("doc_id", F.xxhash64("text").alias("row_key"), "train", "text")
    parts = stash(keyed.mapInArrow(run, f"doc_id {kind}, row_key long, train boolean, word binary, m long, n_tokens long, n_known long, base double, logp double"), "parts")
    rare = parts.where("word is not null").select("doc_id", "row_key", "train", "word", "m").join(words.select("word", "c", "base", "logp"), "word")
    rare = rare.select("doc_id", "row_key", "train", F.lit(0).alias("rows"), F.lit(0).cast("long").alias("n_tokens"), F.expr("if(c > 0, m, 0L)").alias("n_known"), (F.col("m") * F.col("base")).alias("base"), (F.col("m") * F.col("logp")).alias("logp"))
    own = parts.where("word is null").select("doc_id", "row_key", "train", F.lit(1).alias("rows"), "n_tokens", "n_known", "base", "logp")
    sums = own.union(rare).groupBy("doc_id", "row_key", "train").agg(*(F.sum(c).alias(c) for c in ("rows", "n_tokens", "n_known", "base", "logp")))
    one = sums.select("doc_id", "train", *(F.expr(f"{c} div rows").alias(c) for c in ("n_tokens", "n_known")), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"), (F.col("logp") / F.col("rows")).alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("_copy"))
    return one.drop("_copy")
