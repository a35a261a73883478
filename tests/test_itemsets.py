"""Frequent sets of any size against counting all subsets."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from tallyloom.operators import itemsets


def plain(rows, least, longest=99):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    count = Counter(c for items in baskets.values() for k in range(1, min(len(items), longest) + 1) for c in itertools.combinations(sorted(items), k))
    return {c: n for c, n in count.items() if n >= least}


@pytest.mark.parametrize("bits", [0, 1024])
def test_equals_counting_subsets(spark, bits, monkeypatch):
    monkeypatch.setattr(itemsets, "SPARSE", bits)
    rng = random.Random(3)
    rows = [(b, rng.choice("aabbcdefg")) for b in range(150) for _ in range(rng.randrange(1, 9))] + [(None, "a"), (1, None), (None, None)]
    df = spark.createDataFrame(rows, "basket bigint, last string").repartition(5)
    got = itemsets.frequent_sets(df, "basket", "last", 6).collect()
    assert {tuple(r["items"]): r.support for r in got} == plain(rows, 6) and len(got) == len(plain(rows, 6))


def test_longest_numbers_and_none(spark):
    rows = [(b, i) for b in range(40) for i in range(b % 7)]
    df = spark.createDataFrame(rows, "b int, bucket bigint")
    got = {tuple(r["items"]): r.support for r in itemsets.frequent_sets(df, "b", "bucket", 3, longest=2).collect()}
    assert got == plain(rows, 3, 2)
    assert itemsets.frequent_sets(df, "b", "bucket", 1000).count() == 0 == itemsets.frequent_sets(df.limit(0), "b", "bucket", 1).count()


def test_packing():
    for n in (1, 5, itemsets.SPARSE, itemsets.SPARSE + 1, itemsets.BUCKET):
        bits = np.zeros(itemsets.BUCKET, bool)
        bits[np.random.default_rng(n).choice(itemsets.BUCKET, n, replace=False)] = True
        bits = np.packbits(bits, bitorder="little")
        assert (itemsets.unpacked(itemsets.packed(bits, n)) == bits).all()


def test_equal_baskets_are_one_row(spark, monkeypatch):
    """A level has a row for each different rest of a basket, not for each basket or each set in it."""
    seen = []

    def watched(df, label, **more):
        seen.append((label, store(df, label, **more)))
        return seen[-1][1]

    store = itemsets.store
    monkeypatch.setattr(itemsets, "store", watched)
    rows = [(b, i) for b in range(600) for i in range(6 if b % 2 else 3)]
    df = spark.createDataFrame(rows, "b int, i int")
    got = {tuple(r["items"]): r.support for r in itemsets.frequent_sets(df, "b", "i", 4).collect()}
    assert got == plain(rows, 4)
    levels = [t.rows for label, t in seen if label == "level"]
    assert levels and levels[0] == 2 and max(levels) <= 2 * len(got)
