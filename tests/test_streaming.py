"""Streams over several files and runs must equal their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.streaming import jobs

SCHEMA = "id bigint, ts timestamp_ntz, k bigint, x bigint"


def rows(n, seed=1):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(i, start + dt.timedelta(minutes=3 * i), 0 if rng.random() < 0.6 else rng.randrange(1, 4), rng.choice([-1, 1, 2]))
            for i in range(n)]


def put(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/t")


def test_new_files_are_picked_up_once(spark, tmp_path):
    data = rows(40)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    put(spark, tmp_path, data[:15])
    for part in ([], data[15:30], [], data[30:]):
        if part:
            put(spark, tmp_path, part)
        jobs.append_files(jobs.read_files(spark, str(tmp_path), "t"), out, progress)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(40))


def test_levels_carry_over_batches(spark, tmp_path):
    data = rows(120)
    state, want = {}, {}
    for i, _, k, x in data:
        state[k] = want[i] = max(0, state.get(k, 0) + x)
    for lo in range(0, 120, 30):
        put(spark, tmp_path, data[lo:lo + 30])
        stream = jobs.read_files(spark, str(tmp_path), "t", maxFilesPerTrigger="1")
        out = jobs.stream_levels(stream, "k", "ts", "id", F.col("x"), str(tmp_path / "levels"))
    got = spark.read.parquet(out).collect()
    assert {r.id: r.level for r in got} == want and not any(r.late for r in got)
    assert {r.id: r.ts.replace(tzinfo=None) for r in got} == {d[0]: d[1] for d in data}
    put(spark, tmp_path, [(500, data[0][1], 0, 9), (501, data[-1][1] + dt.timedelta(1), 0, 1), (502, data[0][1], None, 2)])
    jobs.stream_levels(stream, "k", "ts", "id", F.col("x"), str(tmp_path / "levels"))
    more = {r.id: (r.k, r.level, r.late) for r in spark.read.parquet(out).collect() if r.id >= 500}
    assert more == {500: (0, None, True), 501: (0, state[0] + 1, False), 502: (None, 2, False)}


def test_reorder_over_batches(spark, tmp_path):
    rng = random.Random(2)
    data = [(i, ts, None if k == 3 else k, x) for i, ts, k, x in rows(90)]
    late = []  # blocks of four, shuffled: nothing is more than three places late
    for lo in range(0, 90, 4):
        block = data[lo:lo + 4]
        rng.shuffle(block)
        late += block
    for lo in range(0, 90, 30):
        put(spark, tmp_path, late[lo:lo + 30])
        stream = jobs.read_files(spark, str(tmp_path), "t").select("k", "ts", "id")
        out = jobs.stream_reorder(stream, "k", ["ts", "id"], 4, str(tmp_path / "reorder"), flush=lo > 0)
        if lo == 0:
            assert out.count() < 30  # some rows are still held back
    out = jobs.stream_reorder(stream, "k", ["ts", "id"], 4, str(tmp_path / "reorder"))  # no new rows
    got = {}
    for r in out.orderBy("k", "seq").collect():
        got.setdefault(r.k, []).append((r.seq, r.id))
    want = {}
    for i, _, k, _ in data:
        want.setdefault(k, []).append((len(want.get(k, [])) + 1, i))
    assert got == want


def test_rates_drop_late_rows(spark, tmp_path):
    data = rows(60)
    put(spark, tmp_path, data)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        stream = jobs.read_files(spark, str(tmp_path), "t")
        rates = jobs.sliding_rate(stream, "ts", "k", "60 minutes", "30 minutes", "10 minutes", 5)
        jobs.append_files(rates, out, progress)
        return {(r.k, r.window_start): (r.n, r.limited) for r in spark.read.parquet(out).collect()}

    first = run()
    closed = max(d[1] for d in data) - dt.timedelta(minutes=10)
    want = {}
    for _, ts, k, _ in data:
        base = ts.replace(minute=ts.minute // 30 * 30)
        for start in (base, base - dt.timedelta(minutes=30)):
            if start + dt.timedelta(minutes=60) <= closed:
                want[k, start] = want.get((k, start), 0) + 1
    assert first == {key: (n, n >= 5) for key, n in want.items()}
    put(spark, tmp_path, [(900, data[0][1], 0, 1)])  # far behind the watermark
    assert run() == first


def test_duplicates_within_the_watermark(spark, tmp_path):
    data = rows(30)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for part in (data, data[20:], data[25:]):
        put(spark, tmp_path, part)
        stream = jobs.read_files(spark, str(tmp_path), "t")
        jobs.append_files(jobs.distinct_events(stream, "ts", ["id"], "1 day"), out, progress)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(30))


def test_arrivals_in_order_with_nulls_and_a_bound(spark, tmp_path, monkeypatch):
    from tallyloom.plans import stream_plans

    start = dt.datetime(2024, 1, 1)
    data = [(i, None if i % 10 == 0 else start + dt.timedelta(minutes=i // 50), i % 3, 1) for i in range(1000)]
    table = spark.createDataFrame(data, SCHEMA).repartition(5)
    monkeypatch.setattr(stream_plans, "new_path", lambda _, label: str(tmp_path / label))
    stream = stream_plans.in_order(spark, table, ["ts", "id"], 100)
    files = spark.read.parquet(str(tmp_path / "arrivals" / "rows")).groupBy(F.input_file_name()).count().collect()
    assert sum(r[1] for r in files) == 1000 and max(r[1] for r in files) <= 200
    out = jobs.stream_levels(stream, "k", "ts", "id", F.col("x"), str(tmp_path / "levels"))
    got = spark.read.parquet(out).collect()
    assert len(got) == 1000 and not any(r.late for r in got)
    want, level = {}, {}
    for i, _, k, _ in sorted(data, key=lambda d: (d[1] is not None, d[1] or start, d[0])):
        level[k] = want[i] = level.get(k, 0) + 1
    assert {r.id: r.level for r in got} == want


def test_streams_over_empty_tables(spark, tmp_path):
    from tallyloom.plans import stream_plans

    for name in ("events", "orders"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert stream_plans.stream_error_level(spark, str(tmp_path)).count() == 0
    assert stream_plans.stream_reorder(spark, str(tmp_path)).count() == 0


def test_many_keys_are_worked_on_in_few_groups(spark, tmp_path, monkeypatch):
    """The state has a row for each group of keys, not for each key; keys beside a null one stay exact."""
    monkeypatch.setattr(jobs, "GROUPS", 4)
    big = 2**60 + 1
    data = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), big + i % 300 if i % 7 else None, 1) for i in range(900)]
    for lo in (0, 500):
        put(spark, tmp_path, data[lo:lo + 500])
        stream = jobs.read_files(spark, str(tmp_path), "t")
        levels = jobs.stream_levels(stream, "k", "ts", "id", F.col("x"), str(tmp_path / "levels"))
        rows_ = jobs.stream_reorder(stream, "k", ["ts", "id"], 1, str(tmp_path / "reorder"))
    want, count = {}, {}
    for i, _, k, _ in data:
        count[k] = want[i] = count.get(k, 0) + 1
    keys = {i: k for i, _, k, _ in data}
    got = {r.id: (r.k, r.level) for r in spark.read.parquet(levels).collect()}
    assert got == {i: (keys[i], n) for i, n in want.items()}
    assert {r.id: (r.k, r.seq) for r in rows_.collect()} == got
    for name in ("levels", "reorder"):
        assert spark.read.format("statestore").load(str(tmp_path / name / "progress")).count() <= 4


def test_rates_hold_one_state_a_group(spark, tmp_path, monkeypatch):
    """Windows that overlap twelvefold are not held one by one; null keys are a key, null times are in no window."""
    monkeypatch.setattr(jobs, "GROUPS", 4)
    start = dt.datetime(2024, 1, 1)
    data = [(i, None if i % 11 == 0 else start + dt.timedelta(minutes=i * 3), None if i % 5 == 0 else i % 5, 1) for i in range(200)]
    put(spark, tmp_path, data)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    rates = jobs.sliding_rate(jobs.read_files(spark, str(tmp_path), "t"), "ts", "k", "60 minutes", "5 minutes", "10 minutes", 3)
    jobs.append_files(rates, out, progress)
    got = {(r.k, r.window_start): (r.n, r.limited) for r in spark.read.parquet(out).collect()}
    closed, want = max(d[1] for d in data if d[1]) - dt.timedelta(minutes=10), {}
    for _, ts, k, _ in data:
        if ts:
            base = ts.replace(minute=ts.minute // 5 * 5)
            for at in (base - dt.timedelta(minutes=5 * j) for j in range(12)):
                if at + dt.timedelta(minutes=60) <= closed:
                    want[k, at] = want.get((k, at), 0) + 1
    assert got == {key: (n, n >= 3) for key, n in want.items()}
    assert 0 < spark.read.format("statestore").load(progress).count() <= 4
