"""Ragged numpy arrays over Arrow text columns: the in-task workhorse of the text operators.

Texts stay in one flat buffer with row offsets; words are spans of that buffer, hashed by prefix sums, so the
cost per character is a few array operations and no Python string is built per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters handled at once; a longer single text is handled alone.
CHUNK_CHARS = 1 << 20
_ODD1 = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
#: Bytes of a word of the hash that are kept, by number of bytes left in the span.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Values folded one after another; longer runs are folded as a tree of such groups.
_FOLD = 16


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, shift, xor)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    x ^= x >> np.uint64(33)
    return x


def hash_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run [start, end) of 64-bit ``values``: a tree of groups of values, each folded by multiply
    and mix, the length of the run mixed in. It is no polynomial, so no pattern of symbols collides by its form."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    size = np.asarray(ends - starts).astype(np.int64)
    start = np.asarray(starts).astype(np.int64)
    length, level = size, np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    while True:
        groups = np.maximum(1, -(-size // _FOLD))
        owner = np.repeat(np.arange(len(size)), groups)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(groups) - groups, groups)
        at = start[owner] + within * _FOLD
        left = np.minimum(size[owner] - within * _FOLD, _FOLD)
        level = mix64(np.array([level]) + _ODD1)[0]
        out = np.full(len(owner), level, dtype=np.uint64)
        for k in range(int(left.max())):
            on = np.flatnonzero(left > k) if k else np.flatnonzero(left > 0)
            out[on] = mix64(out[on] * _ODD1 + values[at[on] + k].astype(np.uint64) + np.uint64(1))
        if len(out) == len(size):
            return mix64(out ^ (length.astype(np.uint64) * _MIX2))
        values, start, size = out, np.cumsum(groups) - groups, groups


def hash_spans(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span [start, end) of bytes; equal spans hash alike wherever they stand. ``seed`` gives
    another, independent one. Spans of up to 64 bytes are folded eight bytes at a time, longer ones as a tree."""
    starts, ends = np.asarray(starts), np.asarray(ends)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    padded = np.r_[np.ascontiguousarray(flat), np.zeros(8, dtype=np.uint8)]
    eights = np.ndarray((len(flat) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from every place on
    size = (ends - starts).astype(np.int64)
    begin = mix64(np.array([seed & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64) + _MIX2)[0]
    out = mix64((eights[starts] & _KEEP[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _ODD1) ^ begin)
    on = np.flatnonzero((size > 8) & (size <= 64))
    k = 8
    while len(on):
        out[on] = mix64(out[on] * _ODD1 + (eights[starts[on] + k] & _KEEP[np.minimum(size[on] - k, 8)]))
        k += 8
        on = on[size[on] > k]
    long = np.flatnonzero(size > 64)
    if len(long):
        n = -(-size[long] // 8)
        owner = np.repeat(np.arange(len(long)), n)
        step = 8 * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
        blocks = eights[starts[long][owner] + step] & _KEEP[np.minimum(size[long][owner] - step, 8)]
        out[long] = mix64(out[long] + hash_runs(blocks, np.cumsum(n) - n, np.cumsum(n), seed))
    return out


def equal_spans(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, o_starts: np.ndarray, o_ends: np.ndarray) -> np.ndarray:
    """Whether the spans hold the same bytes, pair by pair."""
    size = ends - starts
    same = size == o_ends - o_starts
    views = [np.ndarray((len(x) + 1,), dtype="<u8", buffer=np.r_[np.ascontiguousarray(x), np.zeros(8, dtype=np.uint8)], strides=(1,)) for x in (flat, other)]
    on, k = np.flatnonzero(same & (size > 0)), 0
    while len(on) > 64 or (len(on) and k < 256):
        keep = _KEEP[np.minimum(size[on] - k, 8)]
        good = (views[0][starts[on] + k] & keep) == (views[1][o_starts[on] + k] & keep)
        same[on[~good]] = False
        k += 8
        on = on[good]
        on = on[size[on] > k]
    for i in on.tolist():  # few long spans are left
        same[i] = np.array_equal(flat[starts[i] + k : ends[i]], other[o_starts[i] + k : o_ends[i]])
    return same


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return flat, offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes together (one row at least)."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        until = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        until = min(max(until, row + 1), rows)
        yield row, until
        row = until


#: The bytes that str.split() and SQL's white space share.
WHITE = (9, 10, 11, 12, 13, 32)


def is_white(flat: np.ndarray) -> np.ndarray:
    return (flat == 32) | ((flat - np.uint8(9)) < 5)


def word_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words, that is, of the runs of bytes that are not ASCII white space."""
    if not len(flat):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~is_white(flat)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[firsts] = inside[firsts]  # a row's first byte begins a word even after a word of the row before
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stop[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, owners(starts, offsets)


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each of the sorted ``starts`` lies in; searching the few bounds among the starts is the cheap way."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def lower_ascii(flat: np.ndarray) -> np.ndarray:
    return np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint8)


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Indices at which a new run of equal keys begins."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges start, start + 1, ... of the given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    out = np.ones(total, dtype=np.int64)
    full = lengths > 0
    starts, lengths = starts[full], lengths[full]
    at = np.cumsum(lengths)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


class HashMap64:
    """Open addressing from 64-bit keys to row numbers, inserted and looked up a whole array at a time."""

    def __init__(self, expected: int):
        self.bits = max(4, int(expected * 3).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.rows = np.full(1 << self.bits, -1, dtype=np.int64)
        self.size = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo, slot, wrap = np.arange(len(keys)), self._slot(keys), (1 << self.bits) - 1
        while len(todo):
            rows = self.rows[slot]
            hit = (rows >= 0) & (self.keys[slot] == keys[todo])
            out[todo[hit]] = rows[hit]
            on = (rows >= 0) & ~hit
            todo, slot = todo[on], (slot[on] + 1) & wrap
        return out

    def put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Insert distinct keys that are not in the map; it grows when it is half full."""
        if (self.size + len(keys)) * 2 > len(self.keys):
            used = self.rows >= 0
            old_keys, old_rows = self.keys[used], self.rows[used]
            self.__init__(max(self.size + len(keys), 1))
            self._fill(old_keys, old_rows)
        self._fill(keys, rows)

    def _fill(self, keys: np.ndarray, rows: np.ndarray) -> None:
        todo, slot, wrap = np.arange(len(keys)), self._slot(keys), (1 << self.bits) - 1
        while len(todo):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = rows[todo[free]]  # the last writer of a slot wins; the others go on
            self.keys[slot[free]] = keys[todo[free]]
            on = self.rows[slot] != rows[todo]
            todo, slot = todo[on], (slot[on] + 1) & wrap
        self.size += len(keys)
