"""Strong components and path probes against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import paths


def reach(edges, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def graphs(seed):
    pick = random.Random(seed)
    n = 40
    edges = {(pick.randrange(n), pick.randrange(n)) for _ in range([30, 55, 90][seed % 3])}
    edges |= {(i, i + 1) for i in range(100, 106)} | {(200, 201), (201, 202), (202, 200), (202, 100), (106, 300), (300, 300)}
    return sorted(edges)


@pytest.mark.parametrize("seed", [1])
def test_components_and_probes(spark, seed, monkeypatch):
    monkeypatch.setattr(paths, "HUBS", 2)  # so that some probes are left to the search
    edges = graphs(seed)
    df = spark.createDataFrame(edges + edges[:3] + [(None, 1), (1, None)], "u bigint, v bigint")
    ids = sorted({x for e in edges for x in e})
    to = {x: reach(edges, x) for x in ids}
    want = {x: min(y for y in to[x] if x in to[y]) for x in ids}
    assert {r.id: r.comp for r in paths.strong_components(df).collect()} == want
    probes = [(a, b) for a in ids for b in ids if (a + b) % 2 == seed % 2] + [(None, 1), (1, None), (None, None), (999, 999), (999, 1), (1, 999)]
    asked = spark.createDataFrame([*probes, probes[0]], "a bigint, b bigint").withColumn("note", F.lit("x"))
    rows = paths.connected(df, asked, "a", "b").collect()
    assert rows[0].asDict().keys() == {"a", "b", "note", "found"} and len(rows) == len(probes) + 1
    for r in rows:
        assert r.found == (r.b in to.get(r.a, {r.a}) and r.a is not None and r.b is not None), (r.a, r.b)


def test_labels_never_refuse_a_way(spark):
    edges = [(a, b) for a, b in graphs(4) if a < b]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    ids = df.select(F.col("u").alias("id")).union(df.select("v")).distinct()
    label = F.struct(*[f"{s}{x}{k}" for s in "da" for x in "lh" for k in range(paths.SEEDS)]).alias("label")
    back = df.select(F.col("v").alias("u"), F.col("u").alias("v"))
    labels = paths._labels(back, ids, "d").join(paths._labels(df, ids, "a"), "id").select("id", label)
    both = labels.select(F.col("id").alias("s"), F.col("label").alias("sl")).crossJoin(labels.select(F.col("id").alias("g"), F.col("label").alias("gl")))
    open_ = {(r.s, r.g) for r in both.filter(paths._may_reach("sl", "gl")).collect()}
    vertices = sorted({x for e in edges for x in e})
    ways = {(a, b) for a in vertices for b in reach(edges, a)}
    assert ways <= open_ and len(open_ - ways) <= 0.25 * (len(vertices) ** 2 - len(ways))


def test_text_ids_and_no_edges(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "u string, v string")
    asked = spark.createDataFrame([("a", "c"), ("c", "a"), ("z", "z")], "s string, g string")
    assert {(r.s, r.g): r.found for r in paths.connected(df, asked, "s", "g").collect()} == {("a", "c"): True, ("c", "a"): False, ("z", "z"): True}
    assert {(r.s, r.g): r.found for r in paths.connected(df.limit(0), asked, "s", "g").collect()} == {("a", "c"): False, ("c", "a"): False, ("z", "z"): True}
