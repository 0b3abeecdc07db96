"""Three-wise binary fuse filters (Graf and Lemire, 2022) over 64-bit keys.

A filter is static: built once for a set of keys, it says "maybe" for each of them and
for about one in 65,536 others, at about 18 bits a key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .textkernel import U64, mix64


@dataclass(frozen=True)
class FuseFilter:
    seed: int
    segment: int
    segments: int
    prints: bytes

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        if not self.prints:
            return np.zeros(len(keys), bool)
        h = mix64(keys.view(U64) + U64(self.seed))
        table = np.frombuffer(self.prints, np.uint16)
        a, b, c = _slots(h, self.segment, self.segments)
        return (table[a] ^ table[b] ^ table[c]) == _print(h)


def _print(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> U64(32))).astype(np.uint16)


def _slots(h: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A key's slots lie in three successive segments."""
    mask = U64(segment - 1)
    a = ((h >> U64(32)) * U64(segment * segments)) >> U64(32)
    b = (a + U64(segment)) ^ ((h >> U64(18)) & mask)
    c = (a + U64(2 * segment)) ^ (h & mask)
    return a.astype(np.int64), b.astype(np.int64), c.astype(np.int64)


def build(keys: np.ndarray) -> FuseFilter:
    """Repeated keys count once."""
    keys = np.unique(keys.view(U64))
    n = len(keys)
    if not n:
        return FuseFilter(0, 0, 0, b"")
    segment = min(1 << 18, 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(room / segment) - 2)
    for seed in range(1, 1000):
        h = mix64(keys + U64(seed))
        slots = np.stack(_slots(h, segment, segments))
        order = _peel(slots, segment * (segments + 2))
        if order is None:
            continue
        table = np.zeros(segment * (segments + 2), np.uint16)
        prints = _print(h)
        for key, slot in reversed(order):  # keys of one round share no free slot
            a, b, c = slots[:, key]
            table[slot] = prints[key] ^ table[a] ^ table[b] ^ table[c] ^ table[slot]
        return FuseFilter(seed, segment, segments, table.tobytes())
    raise RuntimeError("no seed gives a filter")


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of keys that alone hold a slot; None if some keys never do."""
    n = slots.shape[1]
    count = np.bincount(slots.ravel(), minlength=size)
    held = np.zeros(size, np.int64)
    ids = np.arange(n)
    for row in slots:
        np.bitwise_xor.at(held, row, ids)
    rounds, done, ready = [], 0, np.flatnonzero(count == 1)
    while len(ready):
        key, at = np.unique(held[ready], return_index=True)
        rounds.append((key, ready[at]))
        done += len(key)
        touched = slots[:, key].ravel()
        np.subtract.at(count, touched, 1)
        np.bitwise_xor.at(held, touched, np.tile(key, 3))
        touched = np.unique(touched)
        ready = touched[count[touched] == 1]
    return rounds if done == n else None
