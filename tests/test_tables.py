"""Sources, sinks, aggregates, selection, nested data and work lists."""

import itertools
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators import aggregates as ag
from tallyloom.operators import nested as ne
from tallyloom.operators import selection as se
from tallyloom.operators import worklist as wl
from tallyloom.sources import store as st
from tallyloom.sources import tables as tb


def test_text_files(spark, tmp_path):
    (tmp_path / "one.py").write_text("line 1\nline 2\n")
    (tmp_path / "one_test.py").write_text("skip")
    (tmp_path / "note.txt").write_text("skip")
    got = tb.read_texts(spark, str(tmp_path), ".py", "_test.py").collect()
    assert [(r.key, r.text) for r in got] == [("one", "line 1\nline 2\n")]
    out = str(tmp_path / "out")
    tb.write_texts(spark.createDataFrame([("a",), ("b",)], "x string"), "x", out)
    tb.write_texts(spark.createDataFrame([("c",)], "x string"), "x", out)
    assert [r.value for r in spark.read.text(out).collect()] == ["c"]


def test_json_records(spark, tmp_path):
    good = {"success": True, "analysis": "fine", "score": {"overall": 0.5}}
    (tmp_path / "gcd_record.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "bad_record.json").write_text("{ not json")
    schema = T.StructType.fromDDL("success boolean, analysis string, error string, score struct<overall: double>")
    rows = tb.read_records(spark, str(tmp_path), schema, "_record.json").collect()
    assert [(r.key, r.success, r.analysis, r.error, r.score.overall) for r in rows] == [("gcd", True, "fine", None, 0.5)]
    out = str(tmp_path / "written")
    tb.write_records(spark.createDataFrame([(1, "a"), (2, "b")], "i int, k string"), out, ["k"])
    assert {(r.i, r.k) for r in spark.read.json(out).collect()} == {(1, "a"), (2, "b")}


def test_case_lines(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text('[[17, 0], 17]\n[127, 7]\n[[[1, [2]]], [1, 2]]\n\nnot json\n["a", "b"]\n')
    got = tb.read_cases(spark, str(path)).select(
        F.to_json("args").alias("a"), F.to_json("expected").alias("e")).collect()
    assert [(r.a, r.e) for r in got] == [("[17,0]", "17"), ("[127]", "7"), ("[[1,[2]]]", "[1,2]"), ('["a"]', '"b"')]


def test_store(spark):
    kept = st.store(spark.range(10), "t", evens=F.count_if(F.col("id") % 2 == 0))
    assert (kept.rows, kept.seen, kept.df.count()) == (10, {"evens": 5}, 10)
    assert kept.path.startswith(st.shared_dir(spark))
    kept.drop()
    other = st.store(spark.range(3), "t")
    assert other.path.startswith(st.work_dir(spark)) and other.df.count() == 3
    assert st.store(spark.range(0), "t").rows == 0


# --- aggregates ----------------------------------------------------------------------------------------

def test_histogram_and_counting_sort(spark):
    rng = random.Random(1)
    values = [rng.choice([0, 1, 1, 1, 1, 4, 7]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    counts = Counter(values)
    assert {r.bucket: r.n for r in ag.histogram(df, "v", 9).collect()} == {b: counts[b] for b in range(9)}
    got = sorted((r.pos, r.value) for r in ag.counting_sort(df, "v", 9, block=17).collect())
    assert got == list(enumerate(sorted(values)))


def test_granularity(spark):
    rng = random.Random(2)
    rows = [(k, str(k % 2), rng.choice([0, 6, 9, 12, -15]) * (k + 1)) for k in range(9) for _ in range(60)] + [(99, "0", 0)]
    df = spark.createDataFrame(rows, "k bigint, s string, x bigint").repartition(6)
    want = {}
    for k, s, x in rows:
        want[k, s] = math.gcd(want.get((k, s), 0), x)
    assert {(r.k, r.s): r.gcd for r in ag.granularity(df, ["k", "s"], F.col("x")).collect()} == want


def test_granularity_of_null_keys_and_values(spark):
    rows = [(None, 4), (None, 6), (None, None), (2**60 + 1, 10), (2**60, 15), (2**60, 25), (5, None)]
    df = spark.createDataFrame(rows, "k bigint, x bigint").repartition(4)
    got = [(r.k, r.gcd) for r in ag.granularity(df, ["k"], F.col("x")).collect()]
    assert sorted(got, key=str) == sorted([(None, 2), (2**60 + 1, 10), (2**60, 5)], key=str)


@pytest.mark.parametrize("odd", [None, -3.0, 1.9, 64.0])
def test_a_value_without_a_bucket_raises(spark, odd):
    df = spark.createDataFrame([(1.0,), (odd,)], "v double")
    with pytest.raises(ValueError):
        ag.counting_sort(df, "v", 64)


def test_buckets_reach_the_largest_value(spark):
    df = spark.createDataFrame([(1.0,), (64.0,), (1.0,)], "v double")
    assert sorted((r.pos, r.value) for r in ag.counting_sort(df, "v").collect()) == [(0, 1), (1, 1), (2, 64)]
    assert ag.histogram(df, "v").count() == 65 and ag.histogram(df.limit(0), "v").count() == 0


def test_cube_covers_every_subset(spark):
    rows = [("x", 1, "p", 2), ("x", 2, "q", 3), ("y", 1, "p", 4), ("x", 1, "p", 5)]
    df = spark.createDataFrame(rows, "a string, b int, c string, m int")
    got = Counter((r.grouping, r.a, r.b, r.c, r.total, r.n) for r in ag.cube_sum(df, ["a", "b", "c"], F.col("m"), "total").collect())
    want = Counter()
    for mask in itertools.product([0, 1], repeat=3):
        sums, sizes = Counter(), Counter()
        for *dims, m in rows:
            key = tuple(None if hide else d for hide, d in zip(mask, dims))
            sums[key] += m
            sizes[key] += 1
        grouping = mask[0] * 4 + mask[1] * 2 + mask[2]
        want.update((grouping, *key, sums[key], sizes[key]) for key in sums)
    assert got == want


@pytest.mark.parametrize("k", [1, 2, 3])
def test_combinations(spark, k):
    df = spark.createDataFrame([(list("abcd"),), (["a"],), ([],)], "x array<string>")
    got = [[tuple(c) for c in r.c] for r in df.select(ag.combinations(F.col("x"), k).alias("c")).collect()]
    assert got == [list(itertools.combinations(x, k)) for x in ("abcd", "a", "")]
    assert spark.range(1).select(ag.combinations(F.array(F.lit("a")), 0).alias("c")).first().c == [[]]


def test_frequent_combinations(spark):
    rng = random.Random(3)
    rows = [(b, rng.choice("aabbcdef")) for b in range(60) for _ in range(rng.randrange(1, 7))]
    baskets = {}
    for b, i in rows:
        baskets.setdefault(b, set()).add(i)
    df = spark.createDataFrame(rows, "b bigint, i string")
    for k, support in [(2, 5), (3, 2), (4, 2)]:
        count = Counter(c for items in baskets.values() for c in itertools.combinations(sorted(items), k))
        got = {tuple(r["items"]): r.support for r in ag.frequent_combinations(df, "b", "i", k, support).collect()}
        assert got == {c: n for c, n in count.items() if n >= support}


def test_radix_bitmap_and_cover(spark):
    # fixed values: numbers, bases and their digits
    df = spark.createDataFrame([(8227, 18), (73, 8), (16, 19), (31, 16), (41, 2), (0, 7), (8237, 34)], "n bigint, b int")
    codes = {}
    for base in {18, 8, 19, 16, 2, 7, 34}:
        codes |= {(r.n, base): r.c for r in df.filter(F.col("b") == base).select("n", ag.radix(F.col("n"), base).alias("c")).collect()}
    assert codes == {(8227, 18): "1771", (73, 8): "111", (16, 19): "G", (31, 16): "1F", (41, 2): "101001", (0, 7): "", (8237, 34): "749"}
    kinds = spark.createDataFrame([(1, "a"), (1, "c"), (1, "a"), (2, "b"), (3, "zz")], "u int, k string")
    got = {r.u: (r.bitmap, r.kinds) for r in ag.kind_bitmap(kinds, ["u"], "k", ["a", "b", "c"]).collect()}
    assert got == {1: (5, 2), 2: (2, 1), 3: (0, 0)}
    assert [r.u for r in ag.covering_groups(kinds, ["u"], "k", ["a", "c"]).collect()] == [1]
    need = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "u int, k string")
    assert [r.u for r in ag.covering_pairs(kinds, need, ["u"], "k").collect()] == [1]


def test_best_attempt(spark):
    df = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False), (2, 2, False), (3, 1, True), (3, 2, True)],
                               "k int, attempt int, ok boolean")
    got = ag.best_attempt(df, ["k"], F.col("ok"), ["attempt"], ["attempt"]).collect()
    assert {r.k: (r.attempt, r.succeeded) for r in got} == {1: (1, True), 2: (2, False), 3: (2, True)}


def test_summary_guards_empty_input(spark):
    empty = spark.range(0).withColumn("ok", F.lit(True))
    assert ag.success_summary(empty, [], F.col("ok")).first().success_rate == 0.0


# --- selection -----------------------------------------------------------------------------------------

def knapsack(capacity, items):
    best = {0: 0}
    for w, v in items:
        for used, value in list(best.items()):
            if used + w <= capacity:
                best[used + w] = max(best.get(used + w, 0), value + v)
    return max(best.values())


def test_selection_edge_cases(spark):
    rows = [("zero", 5, 0, 7), ("zero", 5, 3, 5), (None, 5, 3, 3), (None, 5, 2, 4), (None, 5, 9, 9), ("neg", 5, -1, 9), ("neg", 5, None, 9),
            ("neg", 5, 1, None), ("worthless", 5, 0, 0), ("only", 5, 0, 2), ("tight", 0, 0, 4), ("tight", 0, 1, 4)]
    df = spark.createDataFrame(rows, "name string, cap bigint, w bigint, v bigint").repartition(3)
    got = {r.name: r.best_value for r in se.best_under_capacity(df, ["name"], F.col("w"), F.col("v"), F.col("cap")).collect()}
    assert got == {"zero": 12, None: 7, "neg": 0, "worthless": 0, "only": 2, "tight": 4}


def test_best_under_capacity(spark):
    rng = random.Random(4)
    cases = {  # the first few are fixed values
        "a": (100, [(60, 10), (50, 8), (20, 4), (20, 4), (8, 3), (3, 2)]),
        "b": (40, [(30, 10), (50, 5), (10, 20), (40, 25)]),
        "c": (26, [(12, 24), (7, 13), (11, 23), (8, 15), (9, 16)]),
        "none": (5, [(6, 100)]),
        "ties": (12, [(3, 5)] * 9 + [(4, 7)] * 5),
        "wide": (2500, [(rng.randrange(1, 2), rng.randrange(1, 9)) for _ in range(2600)]),
    }
    for n in range(12):
        cases[f"r{n}"] = (rng.randrange(5, 80), [(rng.randrange(1, 30), rng.randrange(1, 50)) for _ in range(25)])
    rows = [(name, cap, w, v) for name, (cap, items) in cases.items() for w, v in items]
    df = spark.createDataFrame(rows, "name string, cap bigint, w bigint, v bigint").repartition(5)
    wide = df.withColumns({"_g": F.lit(7), "_w": F.lit("x"), "_cap": F.lit(None), "_k0": F.lit(1)})  # names used inside
    got = {r.name: r.best_value for r in se.best_under_capacity(wide, ["name"], F.col("w"), F.col("v"), F.col("cap")).collect()}
    assert got == {name: knapsack(*case) for name, case in cases.items() if name != "none"} | {"none": 0}


# --- nested data ---------------------------------------------------------------------------------------

def test_flatten_any_depth(spark):
    cases = ["[1, [], [2, 3], [[4]], 5]", "[[], [], []]", "[[[[[\"x\"]]]], null]", "[]", "[1]"]
    df = spark.createDataFrame(list(enumerate(cases)), "i bigint, t string").select("i", F.parse_json("t").alias("v"))
    rows = ne.flatten_variant(df, ["i"], "v").select("i", "path", F.to_json("leaf").alias("x")).collect()
    flat = {}
    for r in sorted(rows, key=lambda r: (r.i, r.path)):
        flat.setdefault(r.i, []).append(r.x)
    assert flat == {0: ["1", "2", "3", "4", "5"], 2: ['"x"', "null"], 4: ["1"]}


def test_empty_inputs(spark):
    trees = spark.createDataFrame([], "i bigint, t string").select("i", F.parse_json("t").alias("v"))
    assert ne.flatten_variant(trees, ["i"], "v").count() == 0
    items = spark.createDataFrame([], "k string, w bigint, v bigint")
    assert se.best_under_capacity(items, ["k"], F.col("w"), F.col("v"), F.lit(5)).count() == 0
    assert ag.granularity(items, ["k"], F.col("w")).count() == 0
    assert ag.frequent_combinations(items, "k", "w", 2, 1).count() == 0
    assert {r.n for r in ag.histogram(items, "w", 3).collect()} == {0}
    assert ag.counting_sort(items, "w", 3).count() == 0


def test_apply_capturing(spark):
    df = spark.createDataFrame([("4",), ("x",), (None,)], "s string")
    got = ne.apply_capturing(df, lambda s: int(s) * 2, ["s"], T.LongType()).collect()
    assert [r.value for r in got] == [8, None, None]
    assert got[0].error is None and got[1].error.startswith("ValueError") and got[2].error.startswith("TypeError")


# --- work lists ----------------------------------------------------------------------------------------

def test_pending_and_ready(spark):
    inputs = spark.createDataFrame([(i,) for i in range(6)], "k int")
    done = spark.createDataFrame([(0,), (9,)], "k int")
    assert {r.k for r in wl.pending(inputs, done, ["k"]).collect()} == {1, 2, 3, 4, 5}
    records = spark.createDataFrame([(1, "up", True), (2, "up", False), (3, "up", True), (3, "down", True), (4, "down", True)],
                                    "k int, stage string, ok boolean")
    up, down = (F.col("stage") == "up") & F.col("ok"), F.col("stage") == "down"
    assert {r.k for r in wl.ready(inputs, records, "k", up, down).collect()} == {1}
    context = spark.createDataFrame([(1, "note"), (2, None)], "k int, note string")
    got = {r.k: (r.note, r.available) for r in wl.with_context(inputs.filter("k < 4"), context, ["k"]).collect()}
    assert got == {0: (None, False), 1: ("note", True), 2: (None, True), 3: (None, False)}


def test_reconcile(spark):
    expected = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 1.0)], "k int, expected double")
    actual = spark.createDataFrame([(1, 2.05), (2, 2.2), (4, 1.0)], "k int, actual double")
    cases = wl.reconcile(expected, actual, "k", 0.1)
    assert {r.k: r.status for r in cases.collect()} == {1: "PASS", 2: "FAIL", 3: "ERROR", 4: "UNEXPECTED"}
    broken = spark.createDataFrame([(1, None, "TIMEOUT: 5s"), (2, None, "boom"), (3, 1.0, None)],
                                   "k int, actual double, problem string")
    states = wl.reconcile(expected, broken, "k", 0.1, "problem").collect()
    assert {r.k: r.status for r in states} == {1: "TIMEOUT", 2: "ERROR", 3: "PASS"}
    rates = wl.pass_rates(cases, [], F.col("status") == "PASS", F.col("status") != "ERROR").first()
    assert (rates.found, rates.tested, rates.skipped, rates.passed, rates.all_passed) == (4, 3, 1, 1, False)


def test_frequent_combinations_of_wide_sets(spark):
    rows = [(b, i) for b in range(3) for i in range(b, 260)]
    df = spark.createDataFrame(rows, "b bigint, i bigint").repartition(3)
    found = ag.frequent_combinations(df, "b", "i", 2, 3)
    assert found.count() == 258 * 257 // 2 and found.filter("support <> 3").count() == 0
