"""Table functions from SQL against plain Python."""

import random
from bisect import bisect_left
from math import gcd

import pytest

from tallyloom.functions import tables


def rows(n=400):
    pick = random.Random(4)
    return [(pick.choice([None, 1, 2, 2, 2, 3]), i, pick.choice([None, *range(-30, 60, 6)]), f"t{i % 3}") for i in range(n)]


@pytest.fixture
def data(spark):
    tables.register(spark)
    return spark.createDataFrame([*rows(), (9, 900, None, "x")], "`the key` bigint, o bigint, v bigint, state string").repartition(6)


def test_longest_rise(spark, data):
    got = {tuple(r) for r in spark.sql("SELECT * FROM longest_rise(TABLE(SELECT * FROM {t}), 'the key', 'o', 'v')", t=data).collect()}
    want = {}
    for k, _, v, _ in sorted(rows(), key=lambda r: r[1]):
        if v is not None:
            ends = want.setdefault(k, [])
            at = bisect_left(ends, v)
            ends[at : at + 1] = [v]
    assert got == {(k, len(e)) for k, e in want.items()}


@pytest.mark.parametrize("how", sorted(tables.FOLDS))
def test_folds_in_two_steps(spark, data, how, monkeypatch):
    monkeypatch.setattr(tables, "HELD_KEYS", 2)
    tables.register(spark)
    sql = "SELECT * FROM fold_all(TABLE(SELECT * FROM fold_part(TABLE(SELECT * FROM {t}), 'the key', 'v', '" + how + "')), 'the key', '" + how + "')"
    want = {}
    for k, _, v, _ in rows():
        if v is not None:
            want[k] = (abs(v) if how == "gcd" else v) if k not in want else tables.FOLDS[how](want[k], v)
    assert {r[0]: r.value for r in spark.sql(sql, t=data).collect()} == want
    assert spark.sql(sql, t=data.limit(0)).count() == 0
    assert gcd(0, 5) == 5


def test_wrap_text(spark, data):
    texts = ["", None, "one two three four", "x" * 25, " lead  and  gaps ", "é中 " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in spark.sql("SELECT i, no, piece FROM {d} AS d, LATERAL wrap_text(d.t, 7)", d=df).collect():
        got.setdefault(r.i, []).append((r.no, r.piece))
    assert set(got) == {0, 2, 3, 4, 5} and got[2] == [(0, "one two"), (1, " three"), (2, " four")]
    for i, pieces in got.items():
        assert [n for n, _ in sorted(pieces)] == list(range(len(pieces)))
        assert "".join(p for _, p in sorted(pieces)) == texts[i] and all(len(p) <= 7 for _, p in pieces)


def test_wrong_calls_are_refused(spark, data):
    for call, why in (("longest_rise(TABLE(SELECT * FROM {t}), 'no such', 'o', 'v')", "no column"),
                      ("fold_part(TABLE(SELECT * FROM {t}), 'the key', 'state', 'gcd')", "integer"),
                      ("fold_part(TABLE(SELECT * FROM {t}), 'the key', 'v', 'median')", "no fold")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM {call}", t=data).collect()


@pytest.mark.parametrize("how", sorted(tables.FOLDS))
def test_folds_of_packed_rows(spark, data, how, monkeypatch):
    """Arrays in, arrays out: the same folds with a call for each batch and not for each row."""
    monkeypatch.setattr(tables, "HELD_KEYS", 2)
    tables.register(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        def fold(rows):
            part = spark.sql("SELECT * FROM fold_part(TABLE(SELECT * FROM {t}), 'the key', 'v', '" + how + "')", t=tables.packed(rows))
            states = tables.unpacked(part).repartition(3, "the key").sortWithinPartitions("the key")
            return tables.unpacked(spark.sql("SELECT * FROM fold_all(TABLE(SELECT * FROM {t}), 'the key', '" + how + "')", t=tables.packed(states)))
        want = {}
        for k, _, v, _ in rows():
            if v is not None:
                want[k] = (abs(v) if how == "gcd" else v) if k not in want else tables.FOLDS[how](want[k], v)
        got = fold(data.select("the key", "v")).collect()
        assert {r[0]: r.value for r in got} == want and len(got) == len(want)
        assert fold(data.select("the key", "v").limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_packed_wrongly(spark, data):
    with pytest.raises(Exception, match="packed alike"):
        spark.sql("SELECT * FROM fold_part(TABLE(SELECT o, array(v) AS v FROM {t}), 'o', 'v', 'gcd')", t=data).collect()
    with pytest.raises(Exception, match="integer"):
        spark.sql("SELECT * FROM fold_part(TABLE(SELECT array(o) AS o, array(state) AS v FROM {t}), 'o', 'v', 'gcd')", t=data).collect()
