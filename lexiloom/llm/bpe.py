"""Byte-level BPE encoding and decoding by speculation and verification.

For every distinct word a greedy longest match proposes tokens.  A proposal is the BPE result if
each of its tokens is what BPE makes of that token's bytes and no adjacent pair would have merged
across its border; all pairs of a batch are tested together in numpy.  Only words with a failing
test undergo exact merging.

Defined cases: a null text is an empty one (no token); special tokens in a text become their ids;
an empty table gives no row; repeated rows and null ids are encoded like any other; very long texts
are read in slices that end where white space begins; other columns are ignored, and one named like
a result (``n_tokens``, ``ids``, ``decoded``) gives way to it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .caches import IdCache, hold, in_groups

#: Characters encoded at a time, so that long texts need little memory.
SLICE = 1 << 20
#: Words of at most so many bytes are merged without a heap.
SHORT, NO_MERGE = 48, (1 << 60, -1)
#: Fixed value: the splitting pattern of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space in this pattern is Unicode's White_Space property.
PATTERN = PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
#: White space beyond ASCII; where a text holds any, words of the pattern take the place of chunks.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BORDER = re.compile("(?<=[^ \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])[ \t\n\r\x0b\x0c]")
_CHUNK = re.compile(b"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, by the public rule:
    printable Latin-1 characters stand for themselves, the others for U+0100 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class BpeCodec:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.size = size
        self.bytes_of: list[bytes] = [b""] * size
        for s, i in vocab.items():
            if i not in self.special.values():
                self.bytes_of[i] = to_bytes(s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.ids = {b: i for i, b in enumerate(self.bytes_of) if b and i not in set(self.special.values())}
        self.longest = max(map(len, self.ids))
        self.byte_id = [self.ids.get(bytes([b]), -1) for b in range(256)]
        self.left, self.right = np.arange(size), np.arange(size)
        self.born = np.full(size, -1, np.int64)  # rank of the merge that makes a token; -1: none
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks = [], []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (self.ids[to_bytes(x)] for x in (m.split(" ") if isinstance(m, str) else m))
            c = self.ids[self.bytes_of[a] + self.bytes_of[b]]
            if (a, b) not in self.merges:
                self.merges[a, b] = (rank, c)
                keys.append(a * size + b)
                ranks.append(rank)
                if self.born[c] < 0:
                    self.left[c], self.right[c], self.born[c] = a, b, rank
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.sound = np.zeros(size, np.int8)  # 1: BPE gives back this token alone; -1: it doesn't
        self.pairs: dict[int, bool] = {}
        self.split = regex.compile(PATTERN)
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache = IdCache(self.ids_of)
        self.proposed = self.merged = 0

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, ids = [], 0, len(word), self.ids
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                if (i := ids.get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
            else:
                return []
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: always the earliest learned merge, the leftmost first, over a linked list."""
        merges = self.merges
        token = [self.byte_id[b] for b in word]
        n = len(token)
        if n <= SHORT:  # few pairs: look at all of them each time
            rank = [merges.get(p, NO_MERGE) for p in zip(token, token[1:])]
            while rank and (best := min(rank))[0] < NO_MERGE[0]:
                i = rank.index(best)
                token[i : i + 2] = [best[1]]
                del rank[i]
                if i:
                    rank[i - 1] = merges.get((token[i - 1], token[i]), NO_MERGE)
                if i < len(rank):
                    rank[i] = merges.get((token[i], token[i + 1]), NO_MERGE)
            return token
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        alive = [True] * n
        heap = [(m[0], i, token[i], token[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((token[i], token[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or token[i] != a or j >= n or token[j] != b:
                continue
            token[i], alive[j], after[i] = c, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := self.merges.get((token[x], token[y]))):
                    heapq.heappush(heap, (m[0], x, token[x], token[y], m[1]))
        return [t for t, live in zip(token, alive, strict=True) if live]

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For token pairs: does BPE leave the border between them?

        Undo the merges next to the border, the latest first; the pair that then meets there must
        not have an earlier merge of its own.  Of two equal merges the left one came first.
        """
        x, y = x.copy(), y.copy()
        fine, todo = np.ones(len(x), bool), np.arange(len(x))
        limit = np.full(len(x), np.iinfo(np.int64).max)
        while len(todo):
            key = x[todo] * self.size + y[todo]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            joins = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit[todo])
            fine[todo[joins]] = False
            todo = todo[~joins & ((self.born[x[todo]] >= 0) | (self.born[y[todo]] >= 0))]
            by_left = self.born[x[todo]] > self.born[y[todo]]
            one, two = todo[by_left], todo[~by_left]
            limit[one], limit[two] = self.born[x[one]], self.born[y[two]] + 1
            x[one], y[two] = self.right[x[one]], self.left[y[two]]
        return fine

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        proposals = [self.greedy(w) for w in words]
        for t in {t for p in proposals for t in p if not self.sound[t]}:
            self.sound[t] = 1 if self.merge(self.bytes_of[t]) == [t] else -1
        lengths = np.fromiter(map(len, proposals), np.int64, len(words))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        bad = lengths == 0
        bad[owner[self.sound[flat] < 0]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        if len(inner):
            keys, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            bad[owner[inner[~self.compatible(keys // self.size, keys % self.size)[back]]]] = True
        self.proposed += len(words)
        for i in np.flatnonzero(bad).tolist():
            self.merged += 1
            proposals[i] = self.merge(words[i])
        return proposals

    def ids_of(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of each chunk, which may hold several words of the splitting pattern."""
        parts = [self.split.findall(c.decode()) for c in chunks]
        words = list({w for p in parts for w in p})
        ids = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
        return [np.array([i for w in p for i in ids[w]], np.uint32) for p in parts]

    def _chunks(self, text: str) -> Iterator[list[bytes]]:
        """The chunks of a text without special tokens, a slice at a time."""
        wide = _WIDE.search(text)
        at = 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):  # cut where white space begins: no word crosses that
                m = _BORDER.search(text, end)
                end = m.start() if m else len(text)
            yield [w.encode() for w in self.split.findall(text, at, end)] if wide else _CHUNK.findall(text[at:end].encode())
            at = end

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        out: list[bytes] = []
        for part in self.special_split.split(text or "") if self.special_split else [text or ""]:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out += [self.cache.encode_groups([chunks])[0] for chunks in self._chunks(part)]
        return b"".join(out)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of each text; short texts are looked up together."""
        out: list[bytes] = []
        for group in in_groups(texts):
            alone = [bool(t and (len(t) > SLICE or (self.special_split and self.special_split.search(t)))) for t in group]
            rest = iter(self.cache.encode_groups([[c for part in self._chunks(t or "") for c in part] for t, one in zip(group, alone, strict=True) if not one]))
            out += [self.encode(t) if one else next(rest) for t, one in zip(group, alone, strict=True)]
        return out

    def decode(self, ids: bytes) -> str:
        table, all_ids = self.bytes_of, np.frombuffer(ids, "<u4")
        parts = [b"".join([table[i] for i in all_ids[at : at + SLICE].tolist()]) for at in range(0, len(all_ids), SLICE)]
        return b"".join(parts).decode("utf-8", "replace")


_CODECS: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit), one row per row."""
    keep = tuple(k for k in keep if k not in ("n_tokens", "ids"))
    src = docs.select(*keep, docs[text_col].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        hold("bpe", c.cache.clear)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                ids = c.encode_all(some.column(some.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [*keep, "n_tokens", "ids"])

    return src.mapInArrow(run, T.StructType([*src.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]))


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text that its ``ids`` stand for."""
    encoded = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                texts = [c.decode(x or b"") for x in some.column(some.schema.get_field_index("ids")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], [*some.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
