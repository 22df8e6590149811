"""Vectorised work on the UTF-8 bytes of many texts at once.

Arrow hands a string column to Python as one byte buffer and offsets.  The
functions here cut it into blocks of whole texts and hash any number of byte
spans of a block with a few numpy passes, so no Python loop runs over bytes or
words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 256 << 10
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the texts in them) for blocks of about ``limit`` bytes; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Hasher:
    """Hashes of byte spans by doubling: the name of a string of 2k bytes is made of those of its halves.

    That is how prefix doubling names strings, with a 64-bit hash of the pair
    in place of its rank.  The step that joins two names is not linear, so, unlike
    with polynomials, no family of texts (Thue-Morse words) has equal hashes.
    """

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, _MASK, 256, np.uint64, endpoint=True)
        self.factor = np.uint64(_BASE ^ (seed << 8))

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The name of two neighbours, by theirs."""
        x = a * self.factor
        x += b
        x ^= x >> np.uint64(32)
        return x

    def levels(self, values: np.ndarray) -> Iterator[np.ndarray]:
        """Names of the strings of 1, 2, 4, ... values at each place that has so many."""
        size = 1
        while True:
            yield values
            if len(values) <= size:
                return
            values = self.join(values[:-size], values[size:])
            size *= 2

    def at_level(self, level: np.ndarray, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of spans of 2**k to 2**(k+1) values: two strings of 2**k cover one, overlapping."""
        return mix(self.join(level[start], level[end - (1 << k)]) + (end - start).astype(np.uint64) * _GOLD)

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each span of ``values`` (of ``table``); equal content has equal hashes wherever it stands."""
        out = np.zeros(len(start), np.uint64)
        if not len(start):
            return out
        size = np.frexp((end - start).astype(np.float64))[1] - 1
        most = int(size.max())
        for k, level in enumerate(self.levels(values)):
            at = np.flatnonzero(size == k)
            if len(at):
                out[at] = self.at_level(level, k, start[at], end[at])
            if k >= most:
                break
        return out


def mix(h: np.ndarray) -> np.ndarray:
    """The final mixing steps of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] numbers), then from start[1] on, and so forth."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total)


class IdCache:
    """Byte strings to lists of ids, in open addressing by hash; emptied when full.

    The bytes are kept and compared, so two strings with one hash have two entries.
    """

    def __init__(self, capacity: int = 1_000_000, capacity_bytes: int = 64 << 20):
        self.capacity, self.capacity_bytes = capacity, capacity_bytes
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self._table(1 << 16)
        self.start = np.zeros(1 << 15, np.int64)
        self.length = np.zeros(1 << 15, np.int64)
        self.pool = np.zeros(1 << 17, np.uint32)
        self.pooled = 0
        self.key_start = np.zeros(1 << 15, np.int64)
        self.key_length = np.zeros(1 << 15, np.int64)
        self.key_pool = np.zeros(1 << 18, np.uint8)
        #: A number for each byte of each string, if ``learn`` gives them.
        self.row_pool = np.zeros(1 << 18, np.int32)
        self.key_pooled = 0

    def _table(self, n: int) -> None:
        self.keys, self.slots = np.zeros(n, np.uint64), np.full(n, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry numbers by hash, -1 where missing. Hashes of 0 count as 1."""
        h = np.maximum(h, np.uint64(1))
        mask = np.uint64(len(self.keys) - 1)
        at = (h & mask).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.slots[at], -1)
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            at[left] = (at[left] + 1) & int(mask)
            key = self.keys[at[left]]
            hit = key == h[left]
            out[left[hit]] = self.slots[at[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = h[free]
            placed = self.keys[at] == h
            self.slots[at[placed]] = entry[placed]
            h, entry, at = h[~placed], entry[~placed], (at[~placed] + 1) & mask

    def add(self, h: np.ndarray, keys: list[bytes], ids: np.ndarray, length: np.ndarray, rows: np.ndarray | None = None) -> None:
        """New distinct hashes with their strings, ids (one list after the other) and rows."""
        raw = np.frombuffer(b"".join(keys), np.uint8)
        key_length = np.array([len(k) for k in keys], np.int64)
        n, m, b = self.size + len(h), self.pooled + len(ids), self.key_pooled + len(raw)
        for name, least in (("start", n), ("length", n), ("key_start", n), ("key_length", n), ("pool", m), ("key_pool", b), ("row_pool", b if rows is not None else 0)):
            own = getattr(self, name)
            while least > len(own):
                own = np.concatenate([own, np.zeros_like(own)])
            setattr(self, name, own)
        self.start[self.size : n] = self.pooled + np.cumsum(length) - length
        self.length[self.size : n] = length
        self.pool[self.pooled : m] = ids
        self.key_start[self.size : n] = self.key_pooled + np.cumsum(key_length) - key_length
        self.key_length[self.size : n] = key_length
        self.key_pool[self.key_pooled : b] = raw
        if rows is not None:
            self.row_pool[self.key_pooled : b] = rows
        h = np.maximum(h, np.uint64(1))
        if 2 * n > len(self.keys):
            old = self.keys != 0
            keys_, slots = self.keys[old], self.slots[old]
            self._table(1 << int(4 * n).bit_length())
            self._place(keys_, slots)
        self._place(h, np.arange(self.size, n, dtype=np.int32))
        self.size, self.pooled, self.key_pooled = n, m, b

    def same(self, entry: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the strings of the entries are the spans of ``data``."""
        ok = self.key_length[entry] == end - start
        at = np.flatnonzero(ok)
        if len(at):
            size = (end - start)[at]
            equal = data[ragged(start[at], size)] == self.key_pool[ragged(self.key_start[entry[at]], size)]
            if not equal.all():
                first = np.cumsum(size) - size
                ok[at] = np.logical_and.reduceat(equal, first)
        return ok

    def entries(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, learn) -> np.ndarray:
        """An entry for each (not empty) span; ``learn`` takes new strings and gives their ids, the number of them and maybe rows."""
        out = np.full(len(h), -1, np.int64)
        todo, cleared = np.arange(len(h)), False
        own = np.maximum(h, np.uint64(1))
        h = own.copy()
        while len(todo):
            found = self.find(h[todo])
            missing = np.flatnonzero(found < 0)
            if len(missing):
                new, first = np.unique(h[todo[missing]], return_index=True)
                at = todo[missing[first]]
                if self.size and not cleared and (self.size + len(new) > self.capacity or self.key_pooled + int((end - start)[at].sum()) > self.capacity_bytes):
                    # Entries found so far go as well.
                    self.clear()
                    todo, cleared, h = np.arange(len(h)), True, own.copy()
                    continue
                raw = [data[a:b].tobytes() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
                self.add(new, raw, *learn(raw))
                found[missing] = self.find(h[todo[missing]])
            ok = self.same(found, data, start[todo], end[todo])
            out[todo[ok]] = found[ok]
            todo = todo[~ok]
            # Another string has this hash: look at the next one in a row of hashes.
            h[todo] = np.maximum(mix(h[todo] + _GOLD), np.uint64(1))
        return out
