"""Prefix polynomial hashes over byte buffers, as numpy arrays modulo 2**64.

Bytes are first mapped to random odd 64-bit numbers, so that the sums behave like random ones also
for texts of few different bytes.
"""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
#: Bytes that one pass over a buffer takes at most.
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """hash(i, j) of bytes i..j-1 = sum of symbol[b] * base**(position - i), by differences of prefix sums."""

    def __init__(self, seed: int):
        self.symbol = mix(np.arange(seed * 256, seed * 256 + 256, dtype=U)) | U(1)
        base = int(mix(np.array([seed + 77_777], dtype=U))[0]) & ~7 | 5
        self.bases = base, pow(base, -1, 1 << 64)
        self.grow(PIECE)

    def grow(self, size: int) -> None:
        self.power, self.inverse = (self._powers(b, size) for b in self.bases)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size + 1, base, dtype=U)
        out[0] = 1
        return np.cumprod(out, out=out)

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        if len(buf) >= len(self.power):
            self.grow(2 * len(buf))
        out = np.zeros(len(buf) + 1, dtype=U)
        np.cumsum(self.symbol[buf] * self.power[: len(buf)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.inverse[start]


@functools.cache
def rolling(seed: int) -> Rolling:
    return Rolling(seed)


def common_extension(r: Rolling, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common extension of the suffixes at a and b, at most ``most``: binary search on hashes."""
    lo, hi = np.zeros_like(most), most.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        x, y = a[open_], b[open_]
        mid = (lo[open_] + hi[open_] + 1) >> 1
        same = r.of(prefix, x, x + mid) == r.of(prefix, y, y + mid)
        lo[open_[same]] = mid[same]
        hi[open_[~same]] = mid[~same] - 1
