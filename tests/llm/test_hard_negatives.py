"""Hard negatives against plain integer arithmetic, and the query against SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import hard_negatives as hn
from tallyloom.llm import plans

SCHEMA = "vec_id long, embedding array<double>, label int, key string, x int, uid int, a int, score double"


def plain(rows, low=50, high=95, positives=5, negatives=3):
    good = [(k, [math.floor(256 * x) for x in v], y) for k, v, y in rows
            if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    first = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for n, (k, v, y) in enumerate(good):
        if k is None or k % 50:
            continue
        scored = [(sum(p * q for p, q in zip(v, w, strict=False)), j, z) for m, (j, w, z) in enumerate(good) if m != n]
        for s, j, _ in sorted([r for r in scored if r[2] == y], key=first)[:positives]:
            fit = sorted([r for r in scored if r[2] != y and low * s <= 100 * r[0] <= high * s], key=first)[:negatives]
            out += [(k, j, rank, r[1], s, r[0]) for rank, r in enumerate(fit, 1)]
    return sorted(out, key=repr)


def got(spark, rows, parts=4):
    df = spark.createDataFrame([(k, v, y, "k", 1, 2, 3, 0.5) for k, v, y in rows], SCHEMA).repartition(parts)
    found = hn.mine(df, "vec_id", "embedding", "label", F.col("vec_id") % 50 == 0)
    return sorted([tuple(r) for r in found.collect()], key=repr)


@pytest.mark.parametrize("bound", [3, 70_000, hn.EXACT // 2 - 1, hn.EXACT - 1, 2**45, 2**61])
@pytest.mark.parametrize("dimensions", [1, 64, 1500])
def test_scores_are_exact(bound, dimensions):
    ps = hn.primes(dimensions, bound)
    assert math.prod(ps) > 2 * bound + 1
    pick = random.Random(bound)
    side = max(1, math.isqrt(bound // dimensions))
    x, y = (np.array([[pick.randint(-side, side) if bound >= dimensions else 0 for _ in range(dimensions)] for _ in range(6)], np.int32) for _ in range(2))
    want = x.astype(object) @ y.astype(object).T
    have = hn.scores([hn.residues(x, p) for p in ps], [hn.residues(y, p) for p in ps], ps, bound)
    assert (have.astype(object) == want).all()
    assert have.dtype == (np.float32 if 2 * bound < hn.EXACT else np.int64)


def vectors(n, size, seed, scale=1.0):
    pick = random.Random(seed)
    return [(i, [pick.gauss(0, scale) + (i % 4 == d) * scale for d in range(size)], i % 4) for i in range(n)]


@pytest.mark.parametrize("scale", [0.02, 1.0, 300.0, 1e5])
def test_equals_plain_arithmetic(spark, scale, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 300)
    rows = vectors(420, 7, 5, scale)
    rows += [(1000, None, 1), (1001, [1.0, None], 1), (1050, [float("nan")], 1), (1100, [float("inf")], 2), (1150, [1.0] * 7, None), (None, [scale] * 7, 0),
             (None, [scale] * 7, 1), (1200, [], 3), (1250, [scale], 0), (50, rows[50][1], 2), (100, rows[100][1], 0), (100, rows[100][1], 0)]
    rows += [(2000 + i, [scale] * 7, i % 2) for i in range(300)]  # a large group of equal vectors
    assert got(spark, rows) == plain(rows)


def test_no_rows_and_no_anchors(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert got(spark, [(0, [1.0], 0)]) == []


def test_too_long_a_vector_is_refused(spark):
    with pytest.raises(Exception, match="too long"):
        got(spark, [(0, [1e30], 0), (1, [1.0], 0)])


def test_query_equals_sql(spark):
    where = "/root/testdata/sf0.001"
    found = sorted(map(tuple, plans.op11_hard_negatives(spark, where).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{where}/embeddings.parquet'")
    assert found and found == sorted(con.execute(hn.SQL).fetchall())
