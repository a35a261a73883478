"""Running aggregates on the chunked way must equal the plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ordered as od
from tallyloom.operators.scan import OrderedGroups, previous, row_count, running_max, running_min, running_sum


def skewed(seed, n=600, keys=7):
    """Rows (k, t, id, x) where one key holds more than half of them; t has ties."""
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.55 else rng.randrange(1, keys), rng.randrange(n // 4), i, rng.randrange(-9, 10))
            for i in range(n)]


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(scope="module")
def rows():
    return skewed(1)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k bigint, t bigint, id bigint, x bigint").repartition(5)


LIMITS = [20, 100, 10_000]


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("descending", [False, True])
def test_running(table, rows, limit, descending):
    seq = OrderedGroups.of(table, ["k"], ["t", "id"], descending, max_rows=limit)
    assert (seq.hot is None) == (limit == 10_000)
    seq = seq.with_running(s=running_sum("x"), n=row_count(), p=previous("id"))
    seq = seq.with_running(lo=running_min("s"), hi=running_max("s"))
    got = {r.id: (r.s, r.n, r.p, r.lo, r.hi) for r in seq.rows().collect()}
    want = {}
    for part in groups(rows).values():
        total, prev, sums = 0, None, []
        for n, (_, _, i, x) in enumerate(reversed(part) if descending else part, 1):
            total += x
            sums.append(total)
            want[i] = (total, n, prev, min(sums), max(sums))
            prev = i
    assert got == want


@pytest.mark.parametrize("limit", LIMITS)
def test_rank_of_the_whole_table(table, rows, limit):
    got = {r.id: r.rn for r in od.numbered(table, [], ["x", "id"], max_rows=limit).collect()}
    assert got == {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[3], r[2])), 1)}


@pytest.mark.parametrize("limit", LIMITS)
def test_clamped_level_and_best_segment(table, rows, limit):
    got = {r.id: r.level for r in od.clamped_level(table, ["k"], ["t", "id"], F.col("x"), max_rows=limit).collect()}
    want, best = {}, {}
    for k, part in groups(rows).items():
        level = 0
        for _, _, i, x in part:
            level = max(0, level + x)
            want[i] = level
            best[k] = max(best.get(k, 0), level)
    assert got == want
    segments = od.best_segment(table, ["k"], ["t", "id"], F.col("x"), max_rows=limit).collect()
    assert {r.k: r.best for r in segments} == best


@pytest.mark.parametrize("limit", LIMITS)
def test_trailing_count(table, rows, limit):
    counted = od.trailing_count(table, ["k"], "t", "id", 10, max_rows=limit)
    assert counted.columns == ["k", "t", "id", "x", "in_window"]
    want = {}
    for part in groups(rows).values():
        window = []
        for _, t, i, _ in part:
            window = [u for u in window if t - u <= 10] + [t]
            want[i] = len(window)
    assert {r.id: r.in_window for r in counted.collect()} == want


@pytest.mark.parametrize("limit", LIMITS)
def test_neighbours_batches_and_displacement(table, rows, limit):
    linked = od.with_next(table, ["k"], ["t", "id"], max_rows=limit, succ="id")
    batched = od.batch_number(table, ["k"], ["t", "id"], 9, max_rows=limit)
    moved = od.displacement(table, ["k"], ["id"], ["t", "id"], 4, max_rows=limit)
    succ, batch, far = {}, {}, {}
    for part in groups(rows).values():
        came = {r[2]: n for n, r in enumerate(sorted(part, key=lambda r: r[2]))}
        for n, r in enumerate(part):
            succ[r[2]] = part[n + 1][2] if n + 1 < len(part) else None
            batch[r[2]] = n // 9
            far[r[2]] = (abs(came[r[2]] - n), abs(came[r[2]] - n) <= 4)
    assert {r.id: r.succ for r in linked.collect()} == succ
    assert {r.id: r.batch for r in batched.collect()} == batch
    assert {r.id: (r.moved, r.within_k) for r in moved.collect()} == far


@pytest.mark.parametrize("limit", LIMITS)
def test_positions(table, rows, limit):
    kinds = table.withColumn("kind", F.when(F.col("x") > 6, "a").when(F.col("x") > 3, "b").otherwise("c"))
    got = od.first_position(kinds, ["k"], ["t", "id"], "kind", ["a", "b", "z"], max_rows=limit).collect()
    want = {}
    for k, part in groups(rows).items():
        names = ["a" if r[3] > 6 else "b" if r[3] > 3 else "c" for r in part]
        for name in ["a", "b", "z"]:
            want[k, name] = names.index(name) if name in names else -1
    assert {(r.k, r.kind): r.pos for r in got} == want
    spans = od.equal_range(table, ["k"], "x", max_rows=min(limit, 5)).collect()
    for r in spans:
        ordered = sorted(v[3] for v in rows if v[0] == r.k)
        assert ordered[r.first_pos] == ordered[r.last_pos] == r.x
        assert r.last_pos - r.first_pos + 1 == ordered.count(r.x)


@pytest.mark.parametrize("limit", [3, 20, 10_000])
@pytest.mark.parametrize("k", [0, 17, 333])
def test_kth_smallest(table, rows, limit, k):
    wide = table.withColumn("v", F.col("x") * 1000.5 + F.col("t") % 7)
    got = {r.k: r.kth for r in od.kth_smallest(wide, ["k"], "v", k, max_rows=limit).collect()}
    parts = {}
    for key, t, _, x in rows:
        parts.setdefault(key, []).append(x * 1000.5 + t % 7)
    assert got == {key: sorted(p)[k] for key, p in parts.items() if len(p) > k}


def test_kth_smallest_of_the_whole_table(table, rows):
    got = od.kth_smallest(table, [], "x", 50, max_rows=10).collect()
    assert [r.kth for r in got] == [sorted(r[3] for r in rows)[50]]


def lis(values):
    best = []
    for i, v in enumerate(values):
        best.append(1 + max((b for b, u in zip(best, values[:i]) if u < v), default=0))
    return max(best, default=0)


@pytest.mark.parametrize("limit", [15, 60, 10_000])  # all keys oversized, one of them, none
@pytest.mark.parametrize("seed", [3, 4])
def test_longest_increasing(spark, limit, seed):
    rng = random.Random(seed)
    data = [(k, t, i, x if k else 3 * t + rng.randrange(200)) for k, t, i, x in skewed(seed, 400, 5)]
    table = spark.createDataFrame(data, "k bigint, t bigint, id bigint, x bigint").repartition(3)
    got = {r.k: r.length for r in od.longest_increasing(table, ["k"], ["t", "id"], "x", max_rows=limit).collect()}
    assert got == {k: lis([r[3] for r in part]) for k, part in groups(data).items()}


def test_sequences_with_known_answers(spark):
    """Small fixed sequences, all in one job per operator."""
    cases = [[10, 20, 11, 32, 22, 48, 43], [4, 2, 1], [3], [-1, 0, 2], [7, 10, 9, 2, 3, 8, 1], [5, 1, 3, 4, 7]]
    table = spark.createDataFrame(
        [(c, p, v) for c, vs in enumerate(cases) for p, v in enumerate(vs)], "c bigint, pos bigint, v bigint")
    got = {r.c: r.length for r in od.longest_increasing(table, ["c"], ["pos"], "v").collect()}
    assert [got[c] for c in range(len(cases))] == [4, 1, 1, 3, 3, 4]
    best = {r.c: r.best for r in od.best_segment(table, ["c"], ["pos"], F.col("v") - 9).collect()}
    assert [best[c] for c in range(len(cases))] == [123, 0, 0, 0, 1, 0]


def test_balance(spark):
    texts = ["((()()))()", ")()(", "((", "", "()"]
    steps = [(c, p, 1 if x == "(" else -1) for c, t in enumerate(texts) for p, x in enumerate(t)]
    table = spark.createDataFrame(steps, "c bigint, pos bigint, step bigint")
    got = {r.c: r.balanced for r in od.balance(table, ["c"], ["pos"], F.col("step"), max_rows=3).collect()}
    assert got == {0: True, 1: False, 2: False, 4: True}
    arrays = spark.createDataFrame([(c, [1 if x == "(" else -1 for x in t]) for c, t in enumerate(texts)],
                                   "c bigint, steps array<int>")
    in_row = {r.c: r.b for r in arrays.select("c", od.array_balance(F.col("steps")).alias("b")).collect()}
    assert in_row == {**got, 3: True}


def test_backoff(spark):
    got = spark.range(7).select(od.backoff(F.col("id"), 4.0, 30.0).alias("d")).collect()
    assert [r.d for r in got] == [4.0, 8.0, 16.0, 30.0, 30.0, 30.0, 30.0]


def test_longest_increasing_of_several_oversized_keys(spark):
    """Keys on grids of different sizes finish in different rounds."""
    rng = random.Random(8)
    data = [(k, t, k * 1000 + t, rng.randrange(60) + t // 2) for k, n in enumerate((160, 90, 40, 15, 3)) for t in range(n)]
    table = spark.createDataFrame(data, "k bigint, t bigint, id bigint, x bigint").repartition(3)
    got = {r.k: r.length for r in od.longest_increasing(table, ["k"], ["t", "id"], "x", max_rows=6).collect()}
    assert got == {k: lis([r[3] for r in part]) for k, part in groups(data).items()}


@pytest.fixture(scope="module")
def holes(spark):
    """NULL keys (the largest group), NULL values and ties."""
    rng = random.Random(11)
    rows = [(rng.choice([None, None, None, 1, 2]), rng.randrange(60), i, rng.choice([None, -3, 0, 1, 1, 2, 5, 9])) for i in range(300)]
    return rows, spark.createDataFrame(rows, "k bigint, t bigint, id bigint, x bigint").repartition(4)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r[3])
    return out


@pytest.mark.parametrize("limit", [5, 90, 10_000])
def test_null_keys_and_values(holes, limit):
    rows, table = holes
    values = {k: [v for v in vs if v is not None] for k, vs in by_key(rows).items()}
    lengths = od.longest_increasing(table, ["k"], ["t", "id"], "x", max_rows=limit).collect()
    assert {r.k: r.length for r in lengths} == {k: lis(vs) for k, vs in values.items()} and len(lengths) == 3
    kth = od.kth_smallest(table, ["k"], "x", 20, max_rows=limit).collect()
    assert {r.k: r.kth for r in kth} == {k: sorted(vs)[20] for k, vs in values.items()} and len(kth) == 3


def test_all_limits_give_the_same_rows_with_null_keys(holes):
    _, table = holes
    ways = {
        "level": lambda n: od.clamped_level(table, ["k"], ["t", "id"], F.coalesce("x", F.lit(0)), max_rows=n),
        "segment": lambda n: od.best_segment(table, ["k"], ["t", "id"], F.col("x"), max_rows=n),
        "balance": lambda n: od.balance(table, ["k"], ["t", "id"], F.col("x"), max_rows=n),
        "trailing": lambda n: od.trailing_count(table, ["k"], "t", "id", 4, max_rows=n),
        "numbered": lambda n: od.numbered(table, ["k"], ["x", "id"], max_rows=n),
        "next": lambda n: od.with_next(table, ["k"], ["t", "id"], max_rows=n, succ="x"),
        "batch": lambda n: od.batch_number(table, ["k"], ["t", "id"], 7, max_rows=n),
        "moved": lambda n: od.displacement(table, ["k"], ["id"], ["x", "id"], 3, max_rows=n),
        "range": lambda n: od.equal_range(table, ["k"], "x", max_rows=n),
    }
    for name, way in ways.items():
        results = [sorted(map(str, way(n).collect())) for n in (5, 10_000)]
        assert results[0] == results[1], name


@pytest.mark.parametrize("limit", [2, 10_000])
def test_kth_is_exact_for_large_numbers(spark, limit):
    table = spark.createDataFrame([(2**53 + 3,), (2**53 + 1,), (2**53 + 2,), (2**53 + 1,)], "x bigint")
    for k, want in enumerate([1, 1, 2, 3]):
        assert [r.kth for r in od.kth_smallest(table, [], "x", k, max_rows=limit).collect()] == [2**53 + want]
