"""Graph operators against plain algorithms on small random graphs and fixed scenarios."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import graph as gr

INF = float("inf")


def random_edges(seed, n=14, m=26, low=1, high=20):
    rng = random.Random(seed)
    return {(rng.randrange(n), rng.randrange(n)): rng.randrange(low, high) for _ in range(m)}


def frame(spark, edges, kind="bigint"):
    return spark.createDataFrame([(u, v, w) for (u, v), w in edges.items()], f"u {kind}, v {kind}, w bigint")


def distances(edges):
    ids = {x for e in edges for x in e}
    d = {(a, b): 0 if a == b else INF for a in ids for b in ids}
    for (u, v), w in edges.items():
        d[u, v] = min(d[u, v], w)
    for k in ids:
        for a in ids:
            for b in ids:
                d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return d


@pytest.mark.parametrize("seed", [1, 2])
def test_reachability_and_distances(spark, seed):
    edges = random_edges(seed)
    d = distances(edges)
    df = frame(spark, edges)
    ids = sorted({x for e in edges for x in e})
    sources = spark.createDataFrame([(i,) for i in ids], "source bigint")
    hit = {(r.source, r.target) for r in gr.reachable(df, sources).collect()}
    assert hit == {k for k, v in d.items() if v < INF}
    probes = spark.createDataFrame([(a, b) for a in ids[:5] for b in ids], "a bigint, b bigint")
    found = {(r.a, r.b): r.found for r in gr.path_exists(df, probes, "a", "b").collect()}
    assert found == {(a, b): d[a, b] < INF for a in ids[:5] for b in ids}
    pairs = {(r.u, r.v): r.dist for r in gr.all_pairs(df).collect()}
    assert pairs == {k: v for k, v in d.items() if v < INF}
    single = {r.v: r.dist for r in gr.shortest_from(df, ids[0]).collect()}
    assert single == {b: None if d[ids[0], b] == INF else d[ids[0], b] for b in ids}
    for goal in ids[:4]:
        row = gr.shortest_pair(df, ids[0], goal).select(gr.or_infinity(F.col("dist")).alias("x")).first()
        assert row.x == d[ids[0], goal]


def test_negative_edges(spark):
    # fixed values with known distances
    graph = {("A", "B"): 3, ("A", "C"): 3, ("A", "F"): 5, ("C", "B"): -2, ("C", "D"): 7, ("C", "E"): 4,
             ("D", "E"): -5, ("E", "F"): -1, ("X", "A"): 1}
    got = {r.v: r.dist for r in gr.shortest_from(frame(spark, graph, "string"), "A").collect()}
    assert got == {"A": 0, "B": 1, "C": 3, "D": 10, "E": 5, "F": 4, "X": None}
    loop = frame(spark, {(1, 2): 1, (2, 3): -2, (3, 1): -1})
    with pytest.raises(ValueError):
        gr.shortest_from(loop, 1)
    with pytest.raises(ValueError):
        gr.all_pairs(loop)


def test_unconnected_and_single_vertices(spark):
    df = frame(spark, {(1, 2): 4, (3, 3): 2})
    assert gr.shortest_pair(df, 1, 3).first().dist is None
    assert gr.shortest_pair(df, 9, 9).first().dist == 0
    assert {(r.u, r.v): r.dist for r in gr.all_pairs(df).collect()} == {(1, 1): 0, (1, 2): 4, (2, 2): 0, (3, 3): 0}


def test_topological_levels(spark):
    # fixed values: a golden graph, with a cycle and a repeated edge added
    edges = [(5, 11), (7, 11), (7, 8), (3, 8), (3, 10), (11, 2), (11, 9), (11, 10), (8, 9), (20, 21), (21, 20), (21, 22), (5, 11)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    extra = spark.createDataFrame([(99,), (5,)], "id bigint")
    got = {r.id: r.level for r in gr.topological_levels(df, extra).collect()}
    assert got == {5: 0, 7: 0, 3: 0, 99: 0, 11: 1, 8: 1, 10: 2, 2: 2, 9: 2}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_topological_levels_of_deep_graphs(spark, seed):
    """Long chains that branch and meet, cycles of plain chain vertices, and what lies behind a cycle."""
    rng = random.Random(seed)
    edges = {(i, i + 1) for i in range(300) if i % 70 != 69} | {(rng.randrange(0, 140), rng.randrange(141, 300)) for _ in range(6)}
    edges |= {(500 + i, 500 + (i + 1) % 9) for i in range(9)} | {(600, 600), (700, 701), (701, 700), (701, 702), (702, 703), (703, 704)}
    edges |= {(800 + i, 900 + i % 3) for i in range(12)} | {(900, 901), (901, 902)}
    into, level = {}, {}
    for u, v in edges:
        into.setdefault(v, set()).add(u)
        into.setdefault(u, set())
    while ready := [v for v, us in into.items() if v not in level and us <= level.keys()]:
        level |= {v: max((level[u] + 1 for u in into[v]), default=0) for v in ready}
    df = spark.createDataFrame([*edges, *list(edges)[:5], (None, 3), (4, None)], "u bigint, v bigint")
    got = gr.topological_levels(df, spark.createDataFrame([(None,), (5000,)], "id bigint")).collect()
    assert len(got) == len(level) + 1 and {r.id: r.level for r in got} == level | {5000: 0}


def kruskal(edges):
    root, kept = {}, set()

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for (u, v), w in sorted(edges.items(), key=lambda e: (e[1], e[0])):
        if find(u) != find(v):
            root[find(u)] = find(v)
            kept.add((u, v, w))
    return kept


@pytest.mark.parametrize("edges", [  # the first three are fixed values
    {(1, 2): 10, (2, 3): 15, (3, 4): 10, (1, 4): 10},
    {(1, 2): 6, (1, 3): 1, (2, 4): 2},
    {(1, 2): 3, (4, 5): 1, (5, 5): 0, (2, 1): 2},
    random_edges(11, 40, 90, 1, 6), random_edges(12, 60, 70),
])
def test_spanning_forest(spark, edges):
    got = {(r.u, r.v, r.w) for r in gr.spanning_forest(frame(spark, edges)).collect()}
    want = kruskal(edges)
    assert sum(w for *_, w in got) == sum(w for *_, w in want) and len(got) == len(want)
    assert got == want


def test_chains(spark):
    chain = {i: i + 1 for i in range(1, 30)} | {30: None, 50: 51, 51: 52, 52: 50, 60: 51, 70: None, 80: 80}
    df = spark.createDataFrame(list(chain.items()), "id bigint, succ bigint")
    endless = {50, 51, 52, 60, 80}
    assert {r.id: r.cyclic for r in gr.cyclic(df).collect()} == {i: i in endless for i in chain}
    straight = df.filter(~F.col("id").isin(*endless))
    back = gr.reverse_chain(straight)
    assert {r.id: r.succ for r in back.collect()} == {i: i - 1 if i != 1 and i != 70 else None for i in chain if i not in endless}
    twice = {r.id: r.succ for r in gr.reverse_chain(back).collect()}
    assert twice == {i: s for i, s in chain.items() if i not in endless}
    ranks = {r.id: (r.tail, r.rank) for r in gr.chain_ranks(straight).collect()}
    assert ranks == {i: (30, 30 - i) for i in range(1, 31)} | {70: (70, 0)}
    with pytest.raises(ValueError):
        gr.chain_ranks(df)
    loose = spark.createDataFrame([(1, 2), (2, 99), (3, None)], "id bigint, succ bigint")
    assert {r.id: (r.tail, r.rank) for r in gr.chain_ranks(loose).collect()} == {1: (2, 1), 2: (2, 0), 3: (3, 0)}
    assert {r.id: r.cyclic for r in gr.cyclic(loose).collect()} == {1: False, 2: False, 3: False}
    nothing = df.limit(0)
    assert gr.cyclic(nothing).count() == gr.reverse_chain(nothing).count() == 0


def test_empty_graphs(spark):
    edges = spark.createDataFrame([], "u bigint, v bigint, w bigint")
    none = spark.createDataFrame([], "source bigint")
    one = spark.createDataFrame([(5,)], "source bigint")
    assert gr.reachable(edges, none).count() == 0
    assert [tuple(r) for r in gr.reachable(edges, one).collect()] == [(5, 5, 0)]
    assert [tuple(r) for r in gr.shortest_from(edges, 5).collect()] == [(5, 0)]
    assert gr.all_pairs(edges).count() == 0
    assert gr.topological_levels(edges).count() == 0
    assert gr.spanning_forest(edges).count() == 0
    assert gr.chain_ranks(spark.createDataFrame([], "id bigint, succ bigint")).count() == 0


def test_long_chains_are_spliced(spark, monkeypatch):
    """Most inner vertices are taken out before pointers are doubled; levels, cycles and forks stay right."""
    monkeypatch.setattr(gr, "SPLICED", 60)
    doubled, heads = [], gr._chain_heads
    monkeypatch.setattr(gr, "_chain_heads", lambda edges: doubled.append(edges.rows) or heads(edges))
    chain = [(i, i + 1) for i in range(200, 300)]
    fork = [(300, 1000), (1000, 1001), (1001, 400), (300, 400), (400, 401)]
    cycle = [(2000, 2001), (2001, 2002), (2002, 2000), (2100, 2100), (2001, 2200), (2200, 2201)]
    got = gr.topological_levels(spark.createDataFrame([*chain, *fork, *cycle], "u bigint, v bigint")).collect()
    want = {i: i - 200 for i in range(200, 301)} | {1000: 101, 1001: 102, 400: 103, 401: 104}
    assert len(got) == len(want) and {r.id: r.level for r in got} == want
    assert doubled[0] <= 60 < len(chain)
    names = spark.createDataFrame([(f"{u:05d}", f"{v:05d}") for u, v in [*chain, *fork]], "u string, v string")
    assert {int(r.id): r.level for r in gr.topological_levels(names).collect()} == want


def test_large_edge_tables_are_dealt_by_their_rows(spark, monkeypatch):
    """A task holds a bounded number of rows, whatever the session's number of partitions; distances stay right."""
    from tallyloom.sources import store

    monkeypatch.setattr(store, "TASK_ROWS", 10)
    monkeypatch.setattr(gr, "BROADCAST_ROWS", 3)
    edges = spark.range(200).selectExpr("id % 100 u", "(id * 7 + 1) % 100 v", "id % 5 + 1 w")
    assert store.dealt(edges, 200, "u", "v").rdd.getNumPartitions() == 20
    assert store.dealt(edges, 30, "u").rdd.getNumPartitions() == edges.rdd.getNumPartitions()
    plain = {r.v: r.dist for r in gr.shortest_from(edges, 0).collect()}
    assert {r.v: r.dist for r in gr.shortest_from(edges, 0, size=200).collect()} == plain
    assert gr.shortest_pair(edges, 0, 8, size=200).first().dist == plain[8]
