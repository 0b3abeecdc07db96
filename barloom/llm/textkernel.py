"""Words and their hashes over Arrow text columns, in NumPy, for use inside tasks.

A text column is read as one byte buffer with offsets. Separators are ASCII bytes, so
cutting UTF-8 there is safe. Hashes are polynomials modulo 2^64 over per-byte random
values, finished by a bit mixer; the hash of any run of words follows from prefix sums.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
#: Separators of terms: ASCII other than letters and digits.
NON_TERM = np.zeros(256, bool)
NON_TERM[:128] = True
NON_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Two independent polynomials: bases for bytes and for words, and seeds of the bytes' values.
_BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_VALUE_SEEDS = (0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB)
_BYTE_BASE = _BYTE_BASES[0]
_SEGMENT = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = np.asarray(x, dtype=U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUES = tuple(mix64(np.arange(1, 257, dtype=U64) * U64(seed)) for seed in _VALUE_SEEDS)


class _Powers:
    """base^i and base^-i modulo 2^64, as far as asked for."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1024)
            made = []
            for b in (self.base, pow(self.base, -1, 1 << 64)):
                x = np.full(size, b, U64)
                x[0] = 1
                made.append(np.multiply.accumulate(x))
            self.up, self.down = made
        return self.up, self.down


_BYTES, _WORDS = (tuple(map(_Powers, bases)) for bases in (_BYTE_BASES, _WORD_BASES))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes (one longer text alone): first row, end row, bytes, offsets."""
    data, at = text_bytes(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
    pa.default_memory_pool().release_unused()


def edges(data: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs without separators of a block's rows."""
    n = len(data)
    inside = ~separators[data]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        before[at[at < n]] = False
        after[at[at > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None, nth: int = 0) -> np.ndarray:
    """Hashes of the byte spans, which are in order and do not overlap, by polynomial ``nth``.

    Over segments of about a quarter of a megabyte that end between two spans; a longer span is a segment of its own.
    """
    out = np.empty(len(start), U64)
    first = 0
    value = _BYTE_VALUES[nth] if fold is None else _BYTE_VALUES[nth][fold]
    while first < len(start):
        lo = start[first]
        last = max(first + 1, int(np.searchsorted(end, lo + _SEGMENT, side="right")))
        hi = end[last - 1]
        up, down = _BYTES[nth](hi - lo + 1)
        sums = np.empty(hi - lo + 1, U64)
        sums[0] = 0
        np.cumsum(value[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = start[first:last] - lo, end[first:last] - lo
        out[first:last] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64)
        first = last
    return mix64(out)


class Tokens:
    """Words of a block: byte ``start`` and ``end``, ``ptr`` (first word of each row, n + 1), ``hash``."""

    def __init__(self, data: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACE, lower: bool = False):
        self.start, self.end = edges(data, at, separators)
        self.ptr = np.searchsorted(self.start, at)
        self._data, self._fold = data, LOWER if lower else None
        self._hashes: dict[int, np.ndarray] = {}
        self._sums: dict[int, np.ndarray] = {}

    def hashes(self, nth: int) -> np.ndarray:
        if nth not in self._hashes:
            self._hashes[nth] = span_hash(self._data, self.start, self.end, self._fold, nth)
        return self._hashes[nth]

    @property
    def hash(self) -> np.ndarray:
        return self.hashes(0)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def run_hash(self, first: np.ndarray, last: np.ndarray, nth: int = 0) -> np.ndarray:
        """Hash of the words first..last-1 of each pair; equal runs of equal length have equal hashes.

        ``nth`` 0 and 1 are independent: other values of the bytes and other bases.
        """
        n = len(self.start)
        up, down = _WORDS[nth](n + 1)
        if nth not in self._sums:
            sums = np.empty(n + 1, U64)
            sums[0] = 0
            np.cumsum(self.hashes(nth) * up[:n], out=sums[1:])
            self._sums[nth] = sums
        sums = self._sums[nth]
        h = (sums[last] - sums[first]) * down[first]
        return mix64(h + (last - first).astype(U64) * U64(_BYTE_BASES[nth]))

    def windows(self, k: int) -> np.ndarray:
        """First words of all windows of k words that lie in one row."""
        if not len(self.start):
            return np.zeros(0, np.int64)
        ends = np.repeat(self.ptr[1:], np.diff(self.ptr))
        at = np.arange(len(self.start))
        return at[at + k <= ends]


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between successive offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


class Rolling:
    """Hashes of any byte spans of a buffer, which may overlap; ``nth`` 0 and 1 are independent."""

    def __init__(self, data: np.ndarray, nth: int = 0):
        up, self._down = _BYTES[nth](len(data) + 1)
        self._sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE_VALUES[nth][data] * up[: len(data)], out=self._sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of the spans of k bytes at every place that has them."""
        n = max(0, len(self._sums) - k)
        return mix64((self._sums[k:] - self._sums[: len(self._sums) - k]) * self._down[:n]) if n else np.zeros(0, U64)
