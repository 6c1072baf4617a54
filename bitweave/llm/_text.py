"""Vectorised word and window hashing over Arrow string columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  A word's hash is
a Rabin-Karp polynomial over its bytes (mod 2**64, byte values drawn from a
fixed random table), finished with a 64-bit mixer; a window's hash is the same
polynomial over word hashes.  Everything is numpy over the column's own buffers:
no Python object per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_WIN = 0xD6E8FEB86659FD93 | 1
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
STRETCH = 1 << 20
_powers = {"up": np.ones(1, dtype=_U), "down": np.ones(1, dtype=_U)}


#: What operators keep in a worker from one task to the next, by operator.
kept: dict[str, dict] = {}


def make_room(own: str = "") -> None:
    """Empties what other operators have kept in this worker; tasks of several operators share workers."""
    full = [cache for name, cache in kept.items() if name != own and cache]
    for cache in full:
        cache.clear()
    if full:
        give_back()


def trimmed(run):
    """A function over one group of rows (or two, side by side), after which a worker gives its free memory back to the system."""

    def one(table: pa.Table) -> pa.Table:
        make_room()
        try:
            return run(table)
        finally:
            give_back()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        make_room()
        try:
            return run(left, right)
        finally:
            give_back()

    return one if run.__code__.co_argcount == 1 else two


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps its free memory


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit depends on every other."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, 1 << 16), _BASE if kind == "up" else _INV, dtype=_U)
        step[0] = 1
        have = _powers[kind] = np.cumprod(step, dtype=_U)
    return have[:n]


def column_bytes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of each row, which rows are null) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
        if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
            column = column.cast(pa.string())
    n = len(column)
    nulls = np.asarray(column.is_null()) if column.null_count else np.zeros(n, dtype=bool)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), nulls
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0], nulls


class Words:
    """The words of several texts: ``start`` and ``end`` (bytes), ``row`` (which text), ``hash``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.raw = _LOWER[raw] if lower else raw
        self.offsets = offsets
        n = len(raw)
        ink = ~_SPACE[raw]
        first = ink.copy()
        if n:
            first[1:] &= ~ink[:-1]
            begins = offsets[:-1][np.diff(offsets) > 0]
            first[begins] = ink[begins]
            last = ink.copy()
            last[:-1] &= ~ink[1:]
            ends = offsets[1:][np.diff(offsets) > 0] - 1
            last[ends] = ink[ends]
            self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.count = np.bincount(self.row, minlength=len(offsets) - 1).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)]).astype(np.int64)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """The words' hashes, a stretch of about ``STRETCH`` bytes at a time, so that a long text needs no arrays of its own length."""
        n, out, at = len(self.start), np.empty(len(self.start), dtype=_U), 0
        while at < n:
            begin = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.end, begin + STRETCH, side="right")))
            if to == at + 1:
                out[at] = self._one_hash(begin, int(self.end[at]))
            else:
                values = _TABLE[self.raw[begin : self.end[to - 1]]]
                values *= _power("up", len(values))
                sums = np.empty(len(values) + 1, dtype=_U)
                sums[0] = 0
                np.cumsum(values, out=sums[1:])
                start = self.start[at:to] - begin
                out[at:to] = (sums[self.end[at:to] - begin] - sums[start]) * _power("down", len(values))[start]
            at = to
        return mix(out + (self.end - self.start).astype(_U) * _U(0xA0761D6478BD642F))

    def _one_hash(self, begin: int, end: int) -> int:
        total = 0
        for at in range(begin, end, STRETCH):
            values = _TABLE[self.raw[at : min(end, at + STRETCH)]]
            total += int((values * _power("up", len(values))).sum(dtype=_U)) * pow(_BASE, at - begin, 1 << 64)
        return total % (1 << 64)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of ``size`` words inside one text."""
        n = len(self.start) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        h = self.hash[:n].copy()
        for k in range(1, size):
            h *= _U(_WIN)
            h += self.hash[k : k + n]
        inside = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        return inside, mix(h[inside])


def slices(raw: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose texts hold about ``limit`` bytes; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def words_of(column, lower: bool = False, limit: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """(a, b, words of the rows [a, b)) over a whole column, about a MB at a time."""
    raw, offsets, _ = column_bytes(column)
    for a, b in slices(raw, offsets, limit):
        yield a, b, Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
