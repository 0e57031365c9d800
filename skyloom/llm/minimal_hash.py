"""A minimal perfect hash of 128-bit keys over numpy arrays: level by level, keys that meet no other key take their bit.

A level is a bit array twice as long as the keys that are left. A key alone at its place sets the bit there; the others go to
the next level. A key's slot is the number of bits set before its own, over all levels, so n keys have the slots 0 to n - 1.
Keys that were never put in get some slot too, or none (-1): whoever looks up compares the key that is stored at the slot.
"""

from __future__ import annotations

import numpy as np

ROOM = 2
#: Odd multipliers that mix bits well.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(32)


def mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit mix of two arrays of 64 bits each; the order of the two matters."""
    with np.errstate(over="ignore"):
        x = (a ^ (b * _A)) * _B
        x ^= x >> _SHIFT
        x = (x + b) * _A
        return x ^ (x >> _SHIFT)


class MinimalHash:
    """bits: for each level a bool array; before: how many bits are set ahead of each place, over all levels."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, n = [], 0
        for bits in levels:
            counts = np.cumsum(bits, dtype=np.int32)
            self.before.append(counts - 1 + n)
            n += int(counts[-1]) if len(counts) else 0
        self.size = n

    @staticmethod
    def of(k1: np.ndarray, k2: np.ndarray) -> MinimalHash:
        """k1 and k2 are the halves (uint64) of different keys."""
        levels: list[np.ndarray] = []
        while len(k1):
            m = ROOM * len(k1) + 1
            at = MinimalHash._places(k1, k2, len(levels), m)
            bits = np.bincount(at, minlength=m) == 1
            levels.append(bits)
            left = ~bits[at]
            k1, k2 = k1[left], k2[left]
            if len(levels) > 200:
                raise ValueError("keys must differ")
        return MinimalHash(levels)

    @staticmethod
    def _places(k1: np.ndarray, k2: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mixed(mixed(k1, np.uint64(level)), k2) % np.uint64(m)).astype(np.int64)

    def slots(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        out = np.full(len(k1), -1, np.int64)
        left = np.arange(len(k1))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = self._places(k1[left], k2[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.before[level][at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int32)
        return sizes.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @staticmethod
    def from_bytes(raw: bytes) -> MinimalHash:
        n = int(np.frombuffer(raw, np.int32, 1)[0])
        sizes = np.frombuffer(raw, np.int32, n, 4).tolist()
        levels, at = [], 4 * (n + 1)
        for m in sizes:
            packed = (m + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, packed, at), count=m).astype(bool))
            at += packed
        return MinimalHash(levels)
