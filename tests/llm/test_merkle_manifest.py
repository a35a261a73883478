"""Merkle proofs against a plain tree, and the query against SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import merkle_manifest as mm
from tallyloom.llm import plans

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, path array<int>, tree string, key string, hash int, total long"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def sides_of(levels, at, fan):
    out = []
    for level in levels[:-1]:
        run = level[at // fan * fan : at // fan * fan + fan]
        out.append(("".join(run[: at % fan]), "".join(run[at % fan + 1 :])))
        at //= fan
    return out


def plain(rows, fan):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    lower = {n: levels_of([x[2] for x in sorted(trees[n], key=lambda x: x[:3])], fan) for n in names}
    upper = levels_of([lower[n][-1][0] for n in names], fan)
    out = []
    for k, n in enumerate(names):
        for at, (_, _, leaf, row) in enumerate(sorted(trees[n], key=lambda x: x[:3])):
            sides = sides_of(lower[n], at, fan) + sides_of(upper, k, fan)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            h = leaf_of((*row[:3], row[3] + 1 if hit and row[3] is not None else row[3], row[4]))
            for a, b in sides:
                h = digest(a, h, b)
            root = upper[-1][0]
            out.append((row[0], leaf, lower[n][-1][0], root, digest(*[x for s in sides for x in s]), h, h == root))
    return sorted(out, key=repr)


def got(spark, rows, fan=2, levels=2):
    docs = spark.createDataFrame([(*r, [1], "x", "y", 3, 4) for r in rows], SCHEMA)
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    out = mm.manifest(docs, FIELDS, "doc_id", "lang", {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, fan, levels)
    return sorted([tuple(r) for r in out.drop("path").collect()], key=repr)


@pytest.mark.parametrize("fan,levels", [(2, 2), (3, 2), (2, 10)])
def test_equals_a_plain_tree(spark, fan, levels):
    rows = [(i, None if i % 5 == 0 else f"s{i % 3}", "en" if i % 3 else "de", i if i % 4 else None, "é中" * (i % 7)) for i in range(-3, 40)]
    rows += [(7, "s", "en", 1, "twice"), (7, "s", "en", 1, "twice"), (None, None, None, None, None), (None, "a", "en", 0, ""),
             (100, "x", "", 3, "no lang"), (101, "x", "é", 3, "long " * 30_000), (102, "x", "é", None, None)]
    assert got(spark, rows, fan, levels) == plain(rows, fan)


def test_one_row_and_none(spark):
    row = [(14, "s", None, 5, "t")]
    assert got(spark, row) == plain(row, 2)
    assert got(spark, []) == []


def test_many_blocks_of_one_tree(spark):
    rows = [(i, "s", "en", i, str(i)) for i in range(300)]
    assert got(spark, rows, 2, 3) == plain(rows, 2)


def test_query_equals_sql(spark, tmp_path):
    where = "/root/testdata/sf0.001"
    found = sorted(map(tuple, plans.op13_merkle_manifest(spark, where).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet'")
    assert found == sorted(con.execute(mm.SQL).fetchall())
    assert {r[-1] for r in found} == {True, False}
