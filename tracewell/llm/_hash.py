"""Vectorised 64-bit hashing of words and byte strings with numpy."""

from __future__ import annotations

import functools

import numpy as np

#: Odd multiplier of the polynomial hash modulo 2**64, and its inverse.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, BASE), np.full(n, INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(BASE**i, BASE**-i) for i < n."""
    up, down = _powers(max(21, int(n).bit_length()))
    return up[:n], down[:n]


class Rolling:
    """Hashes of any byte ranges of ``data``: equal ranges have equal hashes wherever they lie."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def word_spans(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each document) of maximal runs of bytes with ``inside[byte]``; no run crosses a document."""
    mask = inside[data]
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[ends] = True
    left = mask.copy()
    left[1:] &= ~mask[:-1] | first[1:n]
    right = mask.copy()
    right[:-1] &= ~mask[1:] | first[1:n]
    starts = np.flatnonzero(left)
    return starts, np.flatnonzero(right) + 1, np.searchsorted(starts, ends)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def ngram(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` word hashes, by their first word."""
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = mix(out) + words[i : len(words) - n + 1 + i]
    return mix(out + np.uint64(n))
