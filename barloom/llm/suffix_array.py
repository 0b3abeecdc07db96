"""Suffix arrays by induced sorting, and permuted common prefixes, with NumPy.

Suffixes are S (smaller than the next one) or L; an S suffix after an L one is leftmost
smaller. A sorted order of the latter induces the order of all: one pass over the symbols
upward places the L suffixes, one downward the S suffixes. A symbol's bucket is handled at
once: what smaller symbols have put there, then the suffixes further left in the same run
of the symbol, round by round. Each suffix is placed once per pass, so inducing is linear.

The leftmost-smaller substrings are sorted by the same two passes and named; if names
repeat, the string of names is sorted by recursion. Buckets of that string can be thin (few
suffixes per name); there the recursion ends and the suffixes of names are ranked by
doubling, because a step per bucket would cost more than it sorts.
"""

from __future__ import annotations

import numpy as np

from .textkernel import Rolling

#: Suffixes per symbol from which buckets are worth a step each.
THICK = 128
#: Every so many places the common prefix is computed from nothing.
STRIDE = 32


def _repeated(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(round, row) of rows that stay for ``times`` rounds, in order of rounds, then rows."""
    row = np.repeat(np.arange(len(rows)), times)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + 1
    order = np.argsort(nth, kind="stable")
    return nth[order], row[order]


class _Text:
    """Runs, types and buckets of a string of integers below ``size``."""

    def __init__(self, t: np.ndarray, size: int):
        n = len(t)
        self.t, self.n = t, n
        ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
        starts = np.append(0, ends[:-1] + 1)
        rising = np.append(t[ends[:-1]] < t[ends[:-1] + 1], False)
        length = ends - starts + 1
        self.run = np.repeat(starts.astype(np.int32), length)
        self.small = np.repeat(rising, length)
        self.leftmost = starts[1:][rising[1:] & ~rising[:-1]].astype(np.int32)
        count = np.bincount(t, minlength=size)
        self.end = np.cumsum(count)
        self.start = self.end - count
        self.larger = count - np.bincount(t[self.small], minlength=size)
        self.symbols = np.flatnonzero(count)

    def _put(self, out: np.ndarray, q: np.ndarray, place: np.ndarray, step: int) -> None:
        """Suffixes q in this order to the next places of their buckets."""
        if not len(q):
            return
        c = self.t[q]
        order = np.argsort(c, kind="stable")
        c = c[order]
        first = np.append(0, np.flatnonzero(c[1:] != c[:-1]) + 1)
        size = np.diff(np.append(first, len(c)))
        nth = np.arange(len(c)) - np.repeat(first, size)
        out[np.repeat(place[c[first]], size) + step * nth] = q[order]
        place[c[first]] += step * size

    def _run_on(self, out: np.ndarray, p: np.ndarray, c: int, place: np.ndarray, step: int) -> None:
        """The suffixes left of p in their runs follow p in the same bucket."""
        times = p - self.run[p]
        if times.any():
            nth, row = _repeated(p, times)
            at = place[c] + step * np.arange(len(nth))
            out[at] = p[row] - nth
            place[c] += step * len(nth)

    def induced(self, leftmost: np.ndarray) -> np.ndarray:
        """All suffixes in order, from the leftmost-smaller ones in order."""
        t, out = self.t, np.empty(self.n, np.int32)
        place = self.start.copy()
        first = np.searchsorted(t[leftmost], np.arange(len(place) + 1))
        self._put(out, np.array([self.n - 1], np.int32), place, 1)  # before the end of the string
        for c in self.symbols.tolist():
            lo = int(self.start[c])
            if self.larger[c]:
                self._run_on(out, out[lo : place[c]], c, place, 1)
            p = np.concatenate([out[lo : place[c]], leftmost[first[c] : first[c + 1]]])
            q = p[p > 0] - 1
            self._put(out, q[t[q] > c], place, 1)
        place = self.end - 1
        for c in self.symbols[::-1].tolist():
            hi = int(self.end[c])
            self._run_on(out, out[place[c] + 1 : hi][::-1], c, place, -1)
            p = out[self.start[c] : hi][::-1]
            q = p[p > 0] - 1
            self._put(out, q[t[q] < c], place, -1)
        return out


def _names(t: np.ndarray, order: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Of leftmost-smaller substrings in order: ranks, the same for equal ones."""
    after = np.empty(int(leftmost[-1]) + 1, np.int32)
    after[leftmost[:-1]] = leftmost[1:] + 1
    after[leftmost[-1]] = len(t)
    end = after[order]
    if t.dtype == np.uint8:
        hashes = Rolling(t).spans(order, end)
    else:
        hashes = Rolling(np.ascontiguousarray(t, "<u4").view(np.uint8)).spans(order.astype(np.int64) * 4, end.astype(np.int64) * 4)
    size = end - order
    size[order == leftmost[-1]] = 0  # it ends with the string, as no other does
    return np.cumsum(np.append(False, (hashes[1:] != hashes[:-1]) | (size[1:] != size[:-1])))


def _doubled(r: np.ndarray) -> np.ndarray:
    """Suffix array by doubling the length by which suffixes are ranked; settled ones drop out."""
    n, h = len(r), 1
    out = np.argsort(r, kind="stable")
    opens = np.append(True, r[out][1:] != r[out][:-1])
    first = np.flatnonzero(opens)
    rank = np.empty(n, np.int64)
    rank[out] = np.repeat(first, np.diff(np.append(first, n)))
    slots = np.arange(n)
    while True:
        alone = opens & np.append(opens[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return out.astype(np.int32)
        own = out[slots]
        ahead = own + h
        key = rank[own] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(key)
        own, key = own[order], key[order]
        out[slots] = own
        opens = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(opens)
        rank[own] = np.repeat(slots[first], np.diff(np.append(first, len(slots))))
        h *= 2


def suffix_array(t: np.ndarray, size: int = 256) -> np.ndarray:
    """The starts of the suffixes of t, integers below ``size``, in order; a suffix is less than its continuations."""
    if len(t) < 2:
        return np.arange(len(t), dtype=np.int32)
    text = _Text(t, size)
    leftmost = text.leftmost
    if len(leftmost) > 1:
        rough = text.induced(leftmost[np.argsort(t[leftmost], kind="stable")])
        mark = np.zeros(len(t), bool)
        mark[leftmost] = True
        order = rough[mark[rough]]
        name = _names(t, order, leftmost)
        if name[-1] + 1 < len(order):
            of = np.empty(len(t), np.int32)
            of[order] = name
            reduced, names = of[leftmost], int(name[-1]) + 1
            below = suffix_array(reduced, names) if len(reduced) >= THICK * names else _doubled(reduced)
            order = leftmost[below]
        leftmost = order
    return text.induced(leftmost)


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Per place of the bytes t, the length of the common prefix with the suffix before it in ``order``, up to ``most``.

    In order of places a length is at least the one before less one. So every ``STRIDE``-th
    place is compared from the start, eight bytes at a time, and those between from there on.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.append(t, np.zeros(16, np.uint8))
    words = np.ndarray((n + 8,), "<u8", padded.data, 0, (1,))
    out = np.zeros(n, np.int32)

    def extend(at: np.ndarray, most: int) -> None:
        at = at[(before[at] >= 0) & (out[at] < most)]
        while len(at):
            p, q = at + out[at], before[at] + out[at]
            room = np.minimum(n - np.maximum(p, q), 8)
            differ = words[np.minimum(p, n)] ^ words[np.minimum(q, n)]
            same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
            same = np.minimum(same, room)
            out[at] += same.astype(np.int32)
            at = at[(same == 8) & (out[at] < most)]

    extend(np.arange(0, n, STRIDE), most + STRIDE)
    every = np.arange(n)
    known = out[every - every % STRIDE] - every % STRIDE
    np.maximum(out, known, out=out)
    extend(every[every % STRIDE != 0], most)
    return np.minimum(out, most)
