"""Caches of Python workers, which outlive tasks: bounded in bytes, one operator's at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

#: What an entry takes beside its key's and value's own bytes: two objects and a place in a dict.
ENTRY_BYTES = 180
#: Longer keys are computed each time.
LONGEST_KEY = 128
#: Places of the table that remembers which keys were met before.
_MET = 1 << 20
_CHUNK = 4096

_HELD: dict[str, Callable[[], None]] = {}


def hold(name: str, clear: Callable[[], None]) -> None:
    """Keep this operator's cache in the worker, empty those of others and give their memory back."""
    others = [n for n in _HELD if n != name]
    for n in others:
        _HELD.pop(n)()
    if others:
        give_back()
    _HELD[name] = clear


def give_back() -> None:
    """Return freed memory to the system, which other workers on the machine need."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class BoundedCache:
    """Values of distinct keys, computed many at a time, within about ``budget`` bytes.

    Most words of a large corpus occur once, so a key stays only when it is met in a second batch;
    when the budget is spent, the older half goes.  Keys that don't stay are held for one batch.
    """

    def __init__(self, make: Callable[[list], Iterable], budget: int, size: Callable[[object], int] = lambda value: 32):
        self.make, self.budget, self.size = make, budget, size
        self.clear()

    def clear(self) -> None:
        self.held: dict = {}
        self.passing: list = []
        self.met = bytearray(_MET)
        self.marks = self.used = 0

    def values(self, keys: set) -> dict:
        """A mapping that holds all ``keys`` until the next call."""
        for k in self.passing:
            del self.held[k]
        self.passing = []
        if self.used > self.budget:
            self.held = dict(islice(self.held.items(), len(self.held) // 2, None))
            self.used = sum(self._bytes(k, v) for k, v in self.held.items())
        if self.marks > _MET // 2:
            self.met, self.marks = bytearray(_MET), 0
        held, met = self.held, self.met
        fresh = list(keys.difference(held))
        for at in range(0, len(fresh), _CHUNK):
            some = fresh[at : at + _CHUNK]
            for k, v in zip(some, self.make(some), strict=True):
                held[k] = v
                place = hash(k) & (_MET - 1)
                if not met[place]:
                    met[place] = 1
                    self.marks += 1
                    self.passing.append(k)
                elif len(k) > LONGEST_KEY:
                    self.passing.append(k)
                else:
                    self.used += self._bytes(k, v)
        return held

    def _bytes(self, key, value) -> int:
        return ENTRY_BYTES + len(key) + self.size(value)


class IdCache:
    """Token ids of byte strings in flat arrays, found by 128-bit hashes, all keys of a call together.

    About ``25 * slots + 4 * most_ids`` bytes hold three entries for every four slots; a table that
    is full keeps the entries that were met again.  Keys of over ``LONGEST_KEY`` bytes are computed
    each time.
    """

    def __init__(self, make: Callable[[list[bytes]], list[np.ndarray]], slots: int = 1 << 20, most_ids: int = 6 << 20):
        self.make, self.slots, self.most_ids = make, slots, most_ids
        self.clear()

    def clear(self) -> None:
        self.entries = self.used = 0
        self.start = np.zeros(0, np.int32)  # made when first needed, so that an idle worker holds none
        self.ids = np.zeros(0, np.uint32)

    def _begin(self) -> None:
        self.entries = self.used = 0
        self.low, self.high = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.start, self.count = np.full(self.slots, -1, np.int32), np.zeros(self.slots, np.int32)
        self.met = np.zeros(self.slots, bool)
        self.ids = np.zeros(1 << 16, np.uint32)

    def _thin(self) -> None:
        """Keep the entries met again since they came or were last kept, if these are few enough."""
        live = np.flatnonzero(self.met)
        h, n = np.stack([self.low[live], self.high[live]], 1), self.count[live].astype(np.int64)
        ids = self._gather(self.start[live].astype(np.int64), n)
        self._begin()
        if len(live) <= self.slots * 3 // 8 and len(ids) <= self.most_ids // 2:
            self._insert(h, np.split(ids, np.cumsum(n)[:-1]) if len(live) else [])

    def _gather(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.ids[np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)]

    def _store(self, values: list[np.ndarray]) -> np.ndarray:
        """Where each value begins, once they are written behind the used ids."""
        n = np.fromiter(map(len, values), np.int64, len(values))
        end = self.used + int(n.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(end + end // 2 - self.used, np.uint32)])
        if values:
            self.ids[self.used : end] = np.concatenate(values)
        return self.used + np.cumsum(n) - n

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where there is none."""
        out, place, todo = np.full(len(h), -1, np.int64), (h[:, 0] & np.uint64(self.slots - 1)).astype(np.int64), np.arange(len(h))
        while len(todo):
            at = place[todo]
            same = (self.low[at] == h[todo, 0]) & (self.high[at] == h[todo, 1]) & (self.start[at] >= 0)
            out[todo[same]] = at[same]
            todo = todo[~same & (self.start[at] >= 0)]
            place[todo] = (place[todo] + 1) & (self.slots - 1)
        return out

    def _insert(self, h: np.ndarray, values: list[np.ndarray]) -> None:
        start, n = self._store(values), np.fromiter(map(len, values), np.int32, len(values))
        self.used += int(n.sum())
        self.entries += len(values)
        place, todo = (h[:, 0] & np.uint64(self.slots - 1)).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = todo[self.start[place[todo]] < 0]
            at, first = np.unique(place[free], return_index=True)
            won = free[first]
            self.low[at], self.high[at], self.start[at], self.count[at] = h[won, 0], h[won, 1], start[won], n[won]
            left = np.ones(len(h), bool)
            left[won] = False
            todo = todo[left[todo]]
            place[todo] = (place[todo] + 1) & (self.slots - 1)

    def lookup(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all keys, one after another; how many each has)."""
        from xxhash import xxh3_128_digest

        most = self.slots * 3 // 4
        if not len(self.start):
            self._begin()
        elif self.entries + len(keys) > most or self.used > self.most_ids:
            self._thin()
        h = np.frombuffer(b"".join(map(xxh3_128_digest, keys)), "<u8").reshape(len(keys), 2)
        slot = self._find(h)
        self.met[slot[slot >= 0]] = True
        miss = np.flatnonzero(slot < 0)
        fresh = {keys[i]: i for i in miss.tolist()}
        short = [k for k in fresh if len(k) <= LONGEST_KEY][: max(0, most - self.entries)]
        for at in range(0, len(short), _CHUNK):
            some = short[at : at + _CHUNK]
            self._insert(h[[fresh[k] for k in some]], self.make(some))
        slot[miss] = self._find(h[miss])
        start, n = self.start[slot].astype(np.int64), self.count[slot].astype(np.int64)
        if len(short) < len(fresh):  # the others are written behind the table's ids for this call alone
            rest = list(fresh.keys() - set(short))
            values = self.make(rest)
            began = dict(zip(rest, zip(self._store(values).tolist(), map(len, values), strict=True), strict=True))
            for i in np.flatnonzero(slot < 0).tolist():
                start[i], n[i] = began[keys[i]]
        return self._gather(start, n), n

    def encode_groups(self, groups: list[list[bytes]]) -> list[bytes]:
        """Little-endian ids of each group of keys."""
        distinct = list(set().union(*groups))
        ids, n = self.lookup(distinct)
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
        known = dict(zip(distinct, [raw[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)], strict=True)).__getitem__
        return [b"".join(map(known, g)) for g in groups]


def in_groups(texts: list, most_rows: int = 256, most_bytes: int = 1 << 20) -> Iterator[list]:
    """Consecutive texts in groups of so many rows and about so many characters at most."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t or "")
        if len(group) >= most_rows or held >= most_bytes:
            yield group
            group, held = [], 0
    if group:
        yield group
