"""Packing of documents into token windows by best-fit decreasing.

Each task tokenises its own documents and packs them, so nothing is shuffled: overlong documents
are first cut into full windows, then the remainders, longest first, each go to the open window
with the least room that still holds them.  A segment tree over remaining capacities finds it.

Defined cases: a null or empty text is a document of the closing id alone; a null or repeated
``doc_id`` is packed like any other; very long texts are encoded in segments; pieces of equal length
keep the order in which they came, and of windows with equal room the one opened or filled last is
taken; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .caches import IdCache, hold, in_groups
from .common import segments

WINDOW = 2048
EOS_ID = 1
#: A task packs this many tokens or pieces at a time; windows with room left wait for the next lot.
LOT_TOKENS, LOT_PIECES = 4_000_000, 400_000

SCHEMA = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Counts of open windows by remaining capacity, with a search for the tightest fit."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(self.base)]

    def add(self, room: int, window_id: int) -> None:
        self.open[room].append(window_id)
        at = self.base + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the least room >= need, or None."""
        count, at = self.count, self.base + need
        while not count[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.base:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.base
        window_id = self.open[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, window_id


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window of each item, its offset there, room left in each window); items are at most a window."""
    n = len(lengths)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    tree, room_left = CapacityTree(window), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            room, w = window, len(room_left)
            room_left.append(window)
        else:
            room, w = found
        where[i], offset[i] = w, window - room
        room_left[w] = room - need
        if room > need:
            tree.add(room - need, w)
    return where, offset, np.array(room_left, np.int64)


class WordEncoder:
    """Ids of whole texts through a cache of words between ASCII white space.

    The vocabulary's normaliser and splitter never join characters across white space, so the ids
    of a text are those of its words, one after another.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.single_word]
        self.between = special[0] if special else None
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        normalizer = json.loads(self.tokenizer.to_str())["normalizer"] or {}
        self.folds_case = any(n["type"] == "Lowercase" for n in normalizer.get("normalizers", [normalizer]) if n)
        self.cache = IdCache(self.ids_of)

    def ids_of(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word.  All go through the tokenizer as one text, with a special token between
        them, which it never joins with its neighbours; words that hold that token go by themselves."""
        texts = [w.decode() for w in words]
        if self.between and not any(self.between[0] in t for t in texts):
            ids = np.array(self.tokenizer.encode_batch_fast([self.between[0].join(texts)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.between[1])
            if len(cuts) == len(words) - 1:
                return [ids[lo:hi] for lo, hi in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)]
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, text: bytes) -> list[bytes]:
        """Words between white space; with A-Z in lower case where the vocabulary makes no difference."""
        low = text.lower() if self.folds_case else text
        return (text if low is not text and any(s in low for s in self.special) else low).split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        for group in in_groups(texts):
            if len(group) == 1:
                out.append(b"".join(self.cache.encode_groups([self.words(s)])[0] for s in segments((group[0] or "").encode())))
            else:
                out += self.cache.encode_groups([self.words((t or "").encode()) for t in group])
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class _Lot:
    """Pieces that wait for a window, as flat arrays: their place, document and ids."""

    def __init__(self, id_type: pa.DataType):
        self.id_type, self.held, self.rows = id_type, [], 0
        self.clear()

    def clear(self) -> None:
        self.doc_ids: list[pa.Array] = []
        self.late: list = []
        self.start, self.length, self.total, self.ids = array("q"), array("q"), array("q"), bytearray()

    def add(self, doc_id, start: int, length: int, ids: bytes, total: int) -> None:
        self.late.append(doc_id)
        if len(self.late) >= 4096:
            self._settle()
        self.start.append(start)
        self.length.append(length)
        self.total.append(total)
        self.ids += ids

    def _settle(self) -> None:
        self.doc_ids.append(pa.array(self.late, self.id_type))
        self.late = []

    @property
    def tokens(self) -> int:
        return len(self.ids) // 4

    def full(self) -> bool:
        return self.tokens >= LOT_TOKENS or len(self.length) >= LOT_PIECES

    def table(self) -> pa.Table:
        """(doc_id, start, length, ids, doc_tokens) in the order they came; the lot is empty then."""
        self._settle()
        length = np.frombuffer(self.length, np.int64)
        cuts = np.r_[0, np.cumsum(4 * length)].astype(np.int32)
        ids = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(cuts), pa.py_buffer(bytes(self.ids))])
        doc_id = pa.chunked_array(self.doc_ids, self.id_type).combine_chunks()
        columns = [doc_id, pa.array(np.frombuffer(self.start, np.int64)), pa.array(length), ids, pa.array(np.frombuffer(self.total, np.int64))]
        out = pa.Table.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens"])
        self.clear()
        return out

    def put_back(self, rows: pa.Table) -> None:
        for b in rows.to_batches(4096):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                self.add(*row)


def _pack(batches: Iterator[pa.RecordBatch], path: str, window: int, eos: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    enc, closing = encoder(path), np.array([eos], "<u4").tobytes()
    hold("packing", enc.cache.clear)
    first = TaskContext.get().partitionId() << 36
    made = 0
    lot = _Lot(id_type)

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal made
        pieces = lot.table()
        if not pieces.num_rows:
            return
        where, offset, room = best_fit_decreasing(pieces["length"].to_numpy(), window)
        waits = room > window // 64
        if last or int((window - room[waits]).sum()) > LOT_TOKENS // 2 or int(waits[where].sum()) > LOT_PIECES // 2:
            waits[:] = False
        number = np.cumsum(~waits) - 1 + made + first
        made += int((~waits).sum())
        stay = waits[where]
        lot.put_back(pieces.filter(pa.array(stay)))
        done = pieces.append_column("sequence_id", pa.array(number[where])).append_column("offset", pa.array(offset))
        yield from done.filter(pa.array(~stay)).to_batches(4096)

    for b in batches:
        for at in range(0, b.num_rows, 256):
            some = b.slice(at, 256)
            whole = _Lot(id_type)
            for doc_id, tokens in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                tokens += closing
                n = len(tokens) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    into = whole if length == window else lot
                    into.add(doc_id, start, length, tokens[4 * start : 4 * (start + length)], n)
            full = whole.table()
            if full.num_rows:
                number = np.arange(made, made + full.num_rows) + first
                made += full.num_rows
                yield from full.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(np.zeros(full.num_rows, np.int64))).to_batches(4096)
            if lot.full():
                yield from flush(False)
    yield from flush(True)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, eos: int = EOS_ID) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit token ids; ``sequence_id`` is unique over all tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = src.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    return src.mapInArrow(lambda it: _pack(it, tokenizer_path, window, eos, arrow), SCHEMA.format(id=kind.simpleString()))
