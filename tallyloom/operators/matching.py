"""Exact matching-block lengths of many sequence pairs at once, in numpy.

The rule: find the longest run of equal units in both sequences (the first in the left one, then in the right one),
go on left and right of it, and add up. In a right side of ``FEW`` units or more, units that make up more than a
hundredth of it start no run, but lengthen one.

All open blocks of all pairs of a batch advance together. The longest common run of a block is found by bisection on its
length: runs of the tried length are prefix-hash differences, and a block has one if a hash of its left side is among
those of its right side. So a round costs a sort of the open units for each bisection step, where a plain matcher
compares each unit with all its like. Runs found are compared unit by unit before they count.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
FEW = 200
MOST_UNITS = 1_000_000
"""Units that are worked on together; one pair at least."""


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(U) + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Side:
    """One side of all pairs, end to end, with hashes of all its runs."""

    def __init__(self, units: np.ndarray, rare: np.ndarray):
        n = len(units)
        powers = np.full(n + 1, U(BASE))
        powers[0] = 1
        self.back = np.full(n + 1, U(pow(BASE, -1, 2**64)))
        self.back[0] = 1
        self.back = np.cumprod(self.back)
        self.sum = np.concatenate([np.zeros(1, U), np.cumsum(mix(units) * np.cumprod(powers)[:n], dtype=U)])
        self.units, self.common = units, np.concatenate([[0], np.cumsum(~rare)])

    def hashes(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sum[at + size] - self.sum[at]) * self.back[at]

    def runs(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(block, place, hash)`` of all runs of rare units of the given size in each block's range."""
        counts = np.maximum(high - low - size + 1, 0)
        block = np.repeat(np.arange(len(low)), counts)
        at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + low[block]
        whole = self.common[at + size[block]] == self.common[at]
        block, at = block[whole], at[whole]
        return block, at, mix(self.hashes(at, size[block])) + block.astype(U) * U(0xD6E8FEB86659FD93)


def _met(a: Side, b: Side, blocks: tuple[np.ndarray, ...], size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the left side that are among the right side's, and all runs of the right side."""
    alo, ahi, blo, bhi = blocks
    left, right = a.runs(alo, ahi, size), b.runs(blo, bhi, size)
    there = np.isin(left[2], right[2])
    return tuple(x[there] for x in left) + right


def _longest(a: Side, b: Side, blocks: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in either side and length of each block's longest common run of rare units; length 0 at its start if none."""
    alo, ahi, blo, bhi = blocks
    low, high = np.zeros(len(alo), np.int64), np.minimum(ahi - alo, bhi - blo) + 1
    while len(open_ := np.flatnonzero(high - low > 1)):
        # blocks mostly share short runs only: lengths double until one fails, then halve
        size = np.where(high[open_] > 2 * low[open_] + 2, 2 * low[open_] + 1, (low[open_] + high[open_]) // 2)
        found = np.zeros(len(open_), bool)
        found[_met(a, b, tuple(x[open_] for x in blocks), size)[0]] = True
        low[open_[found]], high[open_[~found]] = size[found], size[~found]
    i, j = alo.copy(), blo.copy()
    some = np.flatnonzero(low)
    if len(some):
        block, at, key, other_block, other_at, other_key = _met(a, b, tuple(x[some] for x in blocks), low[some])
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        i[some[block[first]]] = at[first]
        by = np.argsort(other_key, kind="stable")  # equal keys stay in order of place
        j[some[block[first]]] = other_at[by][np.searchsorted(other_key[by], key[first])]
    return i, j, low


def _alike(a: Side, b: Side, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many units from ``i`` and ``j`` on (or before them, for a step of -1) are equal, up to ``most``."""
    low, high = np.zeros(len(i), np.int64), most + 1
    while len(open_ := np.flatnonzero(high - low > 1)):
        size = np.where(high[open_] > 2 * low[open_] + 2, 2 * low[open_] + 1, (low[open_] + high[open_]) // 2)
        x, y = (i[open_], j[open_]) if step > 0 else (i[open_] - size, j[open_] - size)
        same = a.hashes(x, size) == b.hashes(y, size)
        low[open_[same]], high[open_[~same]] = size[same], size[~same]
    return low


def _common_of(right: list[np.ndarray]) -> list[np.ndarray]:
    """The units of each right side that start no run."""
    out = []
    for x in right:
        values, counts = np.unique(x, return_counts=True) if len(x) >= FEW else (x[:0], x[:0])
        out.append(values[counts > len(x) // 100 + 1])
    return out


def _matched(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    common = _common_of(right)
    rare = [[~np.isin(x, c) for x, c in zip(side, common, strict=True)] for side in (left, right)]
    a, b = (Side(np.concatenate(side), np.concatenate(ok)) for side, ok in zip((left, right), rare, strict=True))
    aend, bend = (np.cumsum([len(x) for x in side]) for side in (left, right))
    pair = np.arange(len(left))
    blocks = aend - [len(x) for x in left], aend, bend - [len(x) for x in right], bend
    total, doubtful = np.zeros(len(left), np.int64), np.zeros(len(left), bool)
    while len(pair):
        alo, ahi, blo, bhi = blocks
        i, j, k = _longest(a, b, blocks)
        before = _alike(a, b, i, j, np.minimum(i - alo, j - blo) * (k > 0), -1)
        i, j, k = i - before, j - before, k + before
        k = k + _alike(a, b, i + k, j + k, np.minimum(ahi - i - k, bhi - j - k), 1)
        at = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        wrong = a.units[np.repeat(i, k) + at] != b.units[np.repeat(j, k) + at]
        doubtful[np.repeat(pair, k)[wrong]] = True
        np.add.at(total, pair, k)
        some = k > 0
        parts = (alo[some], i[some], blo[some], j[some]), ((i + k)[some], ahi[some], (j + k)[some], bhi[some])
        blocks = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        pair = np.concatenate([pair[some], pair[some]])
        go = (blocks[1] > blocks[0]) & (blocks[3] > blocks[2])
        blocks, pair = tuple(x[go] for x in blocks), pair[go]
    for n in np.flatnonzero(doubtful).tolist():  # two runs of one hash
        total[n] = sum(m.size for m in SequenceMatcher(None, left[n].tolist(), right[n].tolist()).get_matching_blocks())
    return total


def matched(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Units in matching blocks of each pair of integer sequences."""
    out = np.zeros(len(left), np.int64)
    group: list[int] = []
    size = 0
    for n in range(len(left) + 1):
        more = len(left[n]) + len(right[n]) if n < len(left) else 0
        if group and (n == len(left) or size + more > MOST_UNITS):
            out[group] = _matched([left[m] for m in group], [right[m] for m in group])
            group, size = [], 0
        if n < len(left):
            if len(left[n]) == len(right[n]) and (left[n] == right[n]).all():
                out[n] = len(left[n])
            elif len(left[n]) and len(right[n]):
                group.append(n)
                size += more
    return out


def ratios(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Twice the matched units over all units; 1.0 for two empty sequences."""
    size = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], np.int64)
    return np.where(size > 0, 2.0 * matched(left, right) / np.maximum(size, 1), 1.0)
