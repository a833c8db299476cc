r"""Spelling variants: a trie self-join with active-node sets over a prefix-partitioned vocabulary.

Words are near if one inserted, deleted or replaced code point makes one the other.  The words that
share a prefix are a part of the trie; in it, level by level, the pairs of nodes within distance one
are kept (the active nodes of each node, once for both) and handed down: the children of a node are a
pair by replacement, a child and its parent a pair by insertion, and a pair lives on where both nodes
have a child of the same code point.  Where both nodes end a word, the pair is near.  All parts of a
batch go down together in numpy.

An edit in the front of a word would make pairs of nearly all short prefixes, so two tries are used: the
one of the words finds the pairs whose common prefix has at least half of the shorter word's code points
(rounded down), the one of the reversed words the others.  Each pair has one node where it parts (its
longest common prefix), so each is found once.

Parts are bounded: the words under a prefix of more than ``GROUP`` words are dealt to the prefixes one
code point longer, as often as needed.  Pairs that part at such a frequent node lie in different parts;
what follows the edit must be equal, so one shuffle on (node, what follows) brings exactly them together.
Such a meeting has at most one word for each code point of the alphabet and one more, and all are near.

Neither pairs nor neighbour lists leave a task: a task emits, for each word, how many near words it found
and the best of them.

Defined cases: null texts have no words, a null document id counts as the text 'null' (in a hash), repeated
rows count each; runs of any length are taken whole; a replaced run of one code point becomes the empty
word, which is none; among near words of equal counts the smallest in code-point order is the form; an
empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash
from .grouping import runs

#: Letters of a word: fixed by the operator's contract.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: A trie's part has at most so many words.
GROUP = 1_024
#: One in so many (document, word) is misspelt by rule, to have something to find.
NOISE = 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTIAL = "word string, near long, most long, best string"


def count_words(documents: DataFrame, min_length: int = 6, min_count: int = 5, noise: int | None = NOISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of runs of letters, A-Z in lower case, with at least so many code points and occurrences.

    With ``noise``, a run whose crc32 with its document's id is divisible by it loses one code point.
    """
    run = F.col("run")
    words = documents.select(F.col(id_col).cast("string").alias("id"), F.translate(F.col(text_col), _UPPER, _LOWER).alias("text"))
    words = words.select("id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run")).where(F.char_length(run) >= min_length)
    word: Column = run
    if noise:
        h = F.crc32(F.concat(F.coalesce("id", F.lit("null")), F.lit(":"), run).cast("binary"))
        at = F.pmod(h, F.char_length(run).cast("long")).cast("int")
        cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
        word = F.when(F.pmod(h, F.lit(noise)) == 0, cut).otherwise(run)
    return words.select(word.alias("word")).where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class _Level:
    """Nodes of one depth: (parent, code point) in order, and the word that ends at each, or -1."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray, n_parents: int):
        self.keys, self.ends = keys, ends
        self.first = np.searchsorted(keys >> 32, np.arange(n_parents + 1))  # the children of each parent

    def __len__(self) -> int:
        return len(self.keys)

    def child(self, parents: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The child of each parent by a code point, or -1."""
        want = (parents << 32) | points
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, at, -1) if len(self.keys) else np.full(len(want), -1)


def _spread(first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``nodes``, child) for all children of each."""
    n = first[nodes + 1] - first[nodes]
    place = np.repeat(np.arange(len(nodes)), n)
    return place, np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[nodes], n)


def trie_pairs(words: list[str], root: np.ndarray, depth: np.ndarray, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of near words in distinct ``words`` of which those with equal ``root`` share their first ``depth`` code points.

    ``depth`` has one value for each root.  Forward, the pairs that share at least half of the shorter word's
    code points as their prefix; with ``reverse``, where words are given reversed, the pairs that don't.
    """
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    length = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(length) - length
    word = np.arange(len(words))
    node, base = root.astype(np.int64), depth.astype(np.int64)
    n_roots = len(base)
    ends = np.full(n_roots, -1)
    done = length == base[node]
    ends[node[done]] = word[done]
    above = _Level(np.arange(n_roots, dtype=np.int64) << 32, ends, n_roots)
    top = np.arange(n_roots)  # the root of each node
    out_a: list[np.ndarray] = []
    out_b: list[np.ndarray] = []
    empty = np.zeros(0, np.int64)
    # By replacement: two nodes of this level. By insertion: a node of this level, one of the level above, a point that may not follow.
    rep_a, rep_b, rep_at = empty, empty, empty
    ins_a, ins_b, ins_at, ins_not = empty, empty, empty, empty
    rel = 0
    while True:
        alive = length[word] > base[root[word]] + rel
        word, node = word[alive], node[alive]
        if len(word) and not (len(rep_a) or len(ins_a)):  # nodes with one word below make no pair any more
            many = np.bincount(node, minlength=len(above))[node] > 1
            many |= above.ends[node] >= 0
            word, node = word[many], node[many]
        if not len(word):
            break
        points = flat[start[word] + base[root[word]] + rel]
        keys, node_below = np.unique((node << 32) | points, return_inverse=True)
        rel += 1
        ends = np.full(len(keys), -1)
        done = length[word] == base[root[word]] + rel
        ends[node_below[done]] = word[done]
        below = _Level(keys, ends, len(above))
        parent, point = keys >> 32, keys & 0xFFFFFFFF
        parted = base[top[parent]] + rel - 1  # code points of the parent
        # Pairs that are handed down.
        place, a = _spread(below.first, rep_a)
        b = below.child(rep_b[place], point[a])
        ok = b >= 0
        new_rep = [(a[ok], b[ok], rep_at[place][ok])]
        place, a = _spread(below.first, ins_a)
        b = above.child(ins_b[place], point[a]) if len(ins_a) else empty
        ok = (b >= 0) & (point[a] != ins_not[place])
        new_ins = [(a[ok], b[ok], ins_at[place][ok], np.full(int(ok.sum()), -1))]
        # Fresh ones: each two children of a node, each child and its node.
        siblings = below.first[parent + 1] - np.arange(len(keys)) - 1
        a = np.repeat(np.arange(len(keys)), siblings)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(siblings) - siblings, siblings)
        new_rep.append((a, b, parted[a]))
        new_ins.append((np.arange(len(keys)), parent, parted, point))
        rep_a, rep_b, rep_at = (np.concatenate(x) for x in zip(*new_rep, strict=True))
        ins_a, ins_b, ins_at, ins_not = (np.concatenate(x) for x in zip(*new_ins, strict=True))
        # Those that no shorter word's length can make this trie's any more go.
        deep = base[top[parent]] + rel
        keep = deep[rep_a] <= (2 * rep_at if reverse else 2 * rep_at + 1)
        rep_a, rep_b, rep_at = rep_a[keep], rep_b[keep], rep_at[keep]
        keep = deep[ins_a] - 1 <= (2 * ins_at - 2 if reverse else 2 * ins_at + 1)
        ins_a, ins_b, ins_at, ins_not = ins_a[keep], ins_b[keep], ins_at[keep], ins_not[keep]
        hit = (below.ends[rep_a] >= 0) & (below.ends[rep_b] >= 0)
        out_a.append(below.ends[rep_a[hit]])
        out_b.append(below.ends[rep_b[hit]])
        hit = (below.ends[ins_a] >= 0) & (above.ends[ins_b] >= 0)
        longer, shorter, at = below.ends[ins_a[hit]], above.ends[ins_b[hit]], ins_at[hit]
        if reverse and len(longer):
            mine = np.array([front(words[x], len(words[y]), p) < len(words[y]) // 2 for x, y, p in zip(longer.tolist(), shorter.tolist(), at.tolist(), strict=True)], bool)
            longer, shorter = longer[mine], shorter[mine]
        out_a.append(longer)
        out_b.append(shorter)
        node, top, above = node_below, top[parent], below
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def front(longer: str, m: int, at: int) -> int:
    """Common prefix of two words of which the longer has one code point more at ``at`` when both are read from the back.

    The code point may stand in a run of equal ones; ``at`` is the run's place furthest from the back.
    """
    same = at
    while same and longer[same - 1] == longer[at]:
        same -= 1
    return m - at + (at - same)


def partials(words: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """For each word of a pair: how many near words, and the count and word of the best."""
    me, other = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(words), np.int64)  # by count downwards, then by code points
    rank[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
    order = np.lexsort((rank[other], me))
    mine, first, near = np.unique(me[order], return_index=True, return_counts=True)
    best = other[order][first]
    take = lambda at: pa.array([words[i] for i in at.tolist()], pa.string())
    return pa.RecordBatch.from_arrays([take(mine), pa.array(near, pa.int64()), pa.array(n[best], pa.int64()), take(best)], ["word", "near", "most", "best"])


def _down_the_trie(parts: DataFrame, reverse: bool) -> DataFrame:
    """Near words within the parts of a trie: rows of (prefix, key, word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (prefix, key, word, n), bounds in runs(batches, 1):
            root = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            depth = np.array([len(prefix[i]) for i in bounds[:-1].tolist()], np.int64)
            a, b = trie_pairs(key, root, depth, reverse)
            if len(a):
                yield partials(word, np.asarray(n), a, b)

    return parts.select("prefix", "key", "word", "n").repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, _PARTIAL)


def _at_frequent_nodes(meetings: DataFrame, reverse: bool) -> DataFrame:
    """Near words that part at a frequent node: rows of (node, rest, point, word, n) whose rests are equal; point is null for the word without the edit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node, rest, point, word, n), bounds in runs(batches, 2):
            found_a: list[int] = []
            found_b: list[int] = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                p, r = node[lo], rest[lo]
                size = len(p) + len(r)
                edited = [i for i in range(lo, hi) if point[i] is not None]
                common = len(r) if reverse else len(p)
                if (common < (size + 1) // 2) == reverse:
                    found_a += [x for k, x in enumerate(edited) for _ in edited[k + 1 :]]
                    found_b += [y for k in range(len(edited)) for y in edited[k + 1 :]]
                for k in (i for i in range(lo, hi) if point[i] is None):
                    for x in edited:
                        if r[:1] == point[x]:
                            continue
                        common = len(r) + len(p) - len(p.rstrip(point[x])) if reverse else len(p)
                        if (common < size // 2) == reverse:
                            found_a.append(x)
                            found_b.append(k)
            if found_a:
                yield partials(word, np.asarray(n), np.array(found_a), np.array(found_b))

    held = meetings.select("node", "rest", "point", "word", "n")
    return held.repartition("node", "rest").sortWithinPartitions("node", "rest").mapInArrow(run, _PARTIAL)


def near_words(words: DataFrame, min_length: int = 6) -> DataFrame:
    """Per word of (word, n) that has near ones: word, near (how many), most and best (count and word of the best).

    Words are distinct and have at least ``min_length`` code points, from 2 on.
    """
    found = []
    for reverse in (False, True):
        depth = max(1, min_length // 2)
        state = words.select((F.reverse("word") if reverse else F.col("word")).alias("key"), "word", "n")
        while True:
            prefix, size = F.substring("key", 1, depth), F.char_length("key")
            frequent = stash(state.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("words")).where(F.col("words") > GROUP).select("prefix", F.lit(True).alias("frequent")), "frequent")
            if frequent.isEmpty():
                found.append(_down_the_trie(state.withColumn("prefix", prefix), reverse))
                break
            both = stash(state.withColumn("prefix", prefix).join(frequent, "prefix", "left"), "trie")
            found.append(_down_the_trie(both.where("frequent is null"), reverse))
            state = both.where("frequent").select("key", "word", "n")
            rest = lambda at: F.substring(F.col("key"), F.lit(at), size)
            edited = state.where(size > depth).select(prefix.alias("node"), rest(depth + 2).alias("rest"), F.substring("key", depth + 1, 1).alias("point"), "word", "n")
            plain = state.select(prefix.alias("node"), rest(depth + 1).alias("rest"), F.lit(None).cast("string").alias("point"), "word", "n")
            # Nodes too near to one end for this trie are left to the other one.
            mine = F.char_length("rest") < F.floor(F.char_length("word") / 2) if reverse else F.char_length("node") >= F.floor((F.char_length("word") - 1) / 2)
            found.append(_at_frequent_nodes(edited.union(plain).where(mine), reverse))
            depth += 1
            state = state.where(F.char_length("key") >= depth)
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    best = F.min(F.struct((-F.col("most")).alias("less"), F.col("best").alias("word"))).alias("b")
    return every.groupBy("word").agg(F.sum("near").alias("near"), best).select("word", "near", (-F.col("b.less")).alias("most"), F.col("b.word").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """(word, root) for the rows of (word, form): the last word of each chain of forms; chains have no cycle.

    Each round doubles the steps taken, so chains of n steps take about log2(n) rounds.
    """
    now, before = stash(links.select("word", F.col("form").alias("root")), "roots"), -1
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stash(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = step.where("moved").count()
        if not moved:
            return step.select("word", "root")
        if moved == before:
            raise ValueError("the forms have a cycle")
        now, before = step.select("word", "root"), moved


def spelling_variants(documents: DataFrame, min_length: int = 6, min_count: int = 5, factor: int = 5, noise: int | None = NOISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, form (its commonest near word if that has ``factor`` times its count), root, n, n_near, form_n."""
    if factor < 2:
        raise ValueError("a form is commoner than its word: factor is 2 at least")
    words = stash(count_words(documents, min_length, min_count, noise, id_col, text_col), "words")
    near = words.join(near_words(words, min_length), "word", "left")
    formed = F.col("most") >= factor * F.col("n")
    near = stash(near.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("most")).alias("form_n")), "near")
    roots = follow(near.where("form is not null").select("word", "form"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
