"""Matching blocks against the standard matcher, the plain rule."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from tallyloom.operators import matching


def plain(a, b):
    return sum(m.size for m in SequenceMatcher(None, a.tolist(), b.tolist()).get_matching_blocks())


def some_pairs(seed):
    pick = random.Random(seed)
    out = []
    for n in range(120):
        alphabet, size = pick.choice([1, 2, 3, 10, 60, 500]), pick.choice([0, 1, 5, 40, 199, 200, 201, 450, 900])
        a = [pick.randrange(alphabet) for _ in range(size)]
        b = list(a) if n % 2 else [pick.randrange(alphabet) for _ in range(pick.choice([0, 3, 60, 260, 800]))]
        for _ in range(pick.choice([0, 1, 5, 40]) if n % 2 else 0):
            at = pick.randint(0, len(b))
            if pick.random() < 0.5:
                b[at:at] = b[: pick.randint(0, 30)]
            else:
                del b[at : at + pick.randint(0, 20)]
        out.append((np.array(a, np.int64), np.array(b, np.int64)))
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("most", [50, 1_000_000])
def test_equals_the_plain_rule(seed, most, monkeypatch):
    monkeypatch.setattr(matching, "MOST_UNITS", most)
    pairs = some_pairs(seed)
    got = matching.matched([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [plain(a, b) for a, b in pairs]


def test_hash_clashes_are_noticed(monkeypatch):
    monkeypatch.setattr(matching, "mix", lambda x: (x.astype(np.uint64) % np.uint64(3)) + np.uint64(1))
    pairs = some_pairs(11)[:40]
    for a, b in pairs:
        assert matching.matched([a], [b])[0] >= 0  # never an endless loop or an error
    monkeypatch.setattr(matching.Side, "hashes", lambda self, at, size: np.zeros(len(at), np.uint64))
    a, b = np.array([1, 2, 3, 4]), np.array([9, 2, 3, 8])
    assert matching.matched([a], [b])[0] == 2


def test_ratios_of_empty_sequences():
    none, one = np.zeros(0, np.int64), np.array([1])
    assert matching.ratios([none, none, one], [none, one, one]).tolist() == [1.0, 0.0, 1.0]


def test_long_repeats_stay_fast():
    a, b = np.zeros(150_000, np.int64), np.zeros(120_000, np.int64)
    b[::2] = 1
    assert matching.matched([a], [a[:-1]])[0] == len(a) - 1
    assert matching.matched([a[:3000]], [b[:3000]])[0] == plain(a[:3000], b[:3000])
