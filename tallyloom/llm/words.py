"""Words and hashed word windows of whole texts, a batch of rows at a time in numpy.

A word is a longest run of bytes other than space and \\x09-\\x0D. No UTF-8 sequence holds such a
byte inside, so bytes and code points give the same words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tallyloom.llm.base import utf8

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def _table(seed: int) -> np.ndarray:
    return mix(np.arange(256, dtype=U) + U(seed * 1000 + 17), seed + 5)


@lru_cache(maxsize=2)
def _powers(size: int, base: int) -> np.ndarray:
    p = np.full(size + 1, U(base))
    p[0] = 1
    return np.cumprod(p)


def powers(n: int, base: int) -> np.ndarray:
    return _powers(1 << max(16, int(n).bit_length()), base)


@dataclass
class Words:
    """Words of a run of rows: ``start``/``end`` in ``data``; row r owns words ``row[r]:row[r+1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row)

    def owner(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.row) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word: a polynomial over random byte values, then mixed."""
        forth, back = powers(len(self.data), BASE), powers(len(self.data), pow(BASE, -1, 2**64))
        run = np.zeros(len(self.data) + 1, U)
        np.cumsum(_table(seed)[self.data] * forth[: len(self.data)], out=run[1:])
        return mix((run[self.end] - run[self.start]) * back[self.start] + U(1) * (self.end - self.start).astype(U), seed)


def words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = utf8(column)
    if lower:
        data = LOWER[data]
    word = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], word[:-1]]) if len(data) else word
    after = np.concatenate([word[1:], [False]]) if len(data) else word
    start = np.flatnonzero(word & (~before | first[:-1]))
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values, ascending."""
    x = np.sort(x)
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def join(left: np.ndarray, right: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of two adjoining windows."""
    return mix(left * U(0xD6E8FEB86659FD93) + mix(right, 7) * U(0xA0761D6478BD642F), seed)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive words at each place of the flat word array (rows not heeded)."""
    if size == 1 or len(h) < size:
        return h if size == 1 else h[:0]
    half = windows(h, size // 2)
    out = join(half[: len(h) - size + size % 2 + 1], half[size // 2 :][: len(h) - size + size % 2 + 1])
    if size % 2:
        n = len(h) - size + 1
        out = join(out[:n], h[size - 1 :][:n], 3)
    return out


def window_rows(row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window of ``size`` words lies inside one row, and the windows' row offsets."""
    counts = np.maximum(np.diff(row) - size + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts) + np.repeat(row[:-1], counts)
    return at, offsets
