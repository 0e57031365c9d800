"""Sets of hashed five-word shingles, minwise signatures and one-permutation sketches of texts."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
#: Coordinates of a signature, and bins of a sketch.
COORDINATES = 32
BINS = 256
#: Pairs whose sketches agree on fewer bins than so many standard deviations below what is expected aren't candidates.
SLACK = 5.5
_RNG = np.random.default_rng(20)
_MIX = _RNG.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``width`` words; a shorter text is one run; no words, no runs.

    Words are what lies between ASCII blanks once A-Z are lower-cased (bytes.lower and bytes.split do just that).
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
    n = len(h) - width + 1
    x = h[:n] * _MIX[0]
    for k in range(1, width):
        x = _scramble(x) + h[k : k + n] * _MIX[k % WIDTH]
    return np.unique(_scramble(x))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise values (sets x COORDINATES) of non-empty sets."""
    if not sets:
        return np.zeros((0, COORDINATES), np.uint64)
    x = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    return np.stack([np.minimum.reduceat(_scramble(x * f + a), starts) for f, a in zip(_FACTORS, _ADDENDS, strict=True)], axis=1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """uint8 (sets x BINS): hashes fall into bins by their highest bits, and a byte of each bin's least one stays; 0 if it has none."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    out = np.zeros((len(sets), BINS), np.uint8)
    for row, s in zip(out, sets, strict=True):
        at = np.searchsorted(s, edges)
        filled = np.diff(at, append=len(s)) > 0
        row[filled] = (s[at[filled]] % np.uint64(255)).astype(np.uint8) + 1
    return out


def agreement(sk: np.ndarray, filled: np.ndarray, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bins agree between sketch i and the others, and how many are filled in either. filled: ``bits(sk)``."""
    either = np.bitwise_count(filled[others] | filled[i]).sum(1, dtype=np.int64)
    same = np.count_nonzero(sk[others] == sk[i], axis=1)
    return same - (BINS - either), either


def bits(sk: np.ndarray) -> np.ndarray:
    return np.packbits(sk != 0, axis=1).view(np.uint64)


def may_reach(same: np.ndarray, either: np.ndarray, similarity: float) -> np.ndarray:
    """Whether so many agreeing bins are within SLACK of what a pair of that similarity shows."""
    return same >= similarity * either - SLACK * np.sqrt(similarity * (1 - similarity) * either)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, exactly."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
