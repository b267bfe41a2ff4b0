"""Rolling hashes over arrays of bytes or code points, for whole batches of texts at once.

Equal sequences always get equal hashes. Unequal ones collide with a chance near 2**-64; operators
that must be exact compare the sequences themselves afterwards.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
GRAM_BASE = np.uint64(0xD1342543DE82EF95)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any span of a sequence in constant time."""

    def __init__(self, symbols: np.ndarray):
        power, self.inverse = _powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h ^ (end - start).astype(np.uint64))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of words[i:i+k] for each i with k words left."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= GRAM_BASE
        out += words[j : j + n]
    return mix(out)


def edges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    step = np.diff(np.concatenate(([False], mask, [False])).view(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
