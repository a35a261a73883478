"""Table functions for SQL: ordered folds, mergeable folds and a row generator.

``register(spark)`` makes them known to a session:

* ``longest_rise(TABLE t, key, order, value)``: the longest strictly increasing subsequence of each key. The call
  itself says how the table is partitioned and sorted, so the engine streams each key's rows through one instance
  that holds the smallest ends only; the rows are never held.
* ``fold_part(TABLE t, key, value, how)`` and ``fold_all(TABLE t, key, how)``: a fold in two steps. The first
  runs where the rows are and hands on one state for each key that it meets; the second merges the states by key. So a
  hot key is folded by all tasks before anything moves. ``how`` is a name in ``FOLDS``. Both take their columns packed
  as well, thousands of rows in one as arrays, and then give arrays: a call from SQL for each row is what costs. ``packed`` makes such rows and ``unpacked`` undoes it.
* ``wrap_text(text, cols)``: the pieces of a text, numbered, for a lateral join.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from math import gcd
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

HELD_KEYS = 100_000
"""States that a task holds; beyond that it hands them on and starts anew."""

FOLDS: dict[str, Callable[[int, int], int]] = {
    "gcd": gcd, "bit_or": lambda a, b: a | b, "bit_and": lambda a, b: a & b, "min": min, "max": max, "sum": lambda a, b: a + b}
"""Associative, commutative folds of 64-bit integers."""


def _named(argument: AnalyzeArgument, what: str) -> str:
    if not argument.isConstantExpression or not isinstance(argument.value, str) or not argument.value:
        raise ValueError(f"{what} must be given as a text")
    return argument.value


def _columns(table: AnalyzeArgument, names: list[str]) -> list[T.StructField]:
    if not table.isTable:
        raise ValueError("the first argument must be a TABLE")
    fields = {f.name: f for f in table.dataType.fields}
    if missing := [n for n in names if n not in fields]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return [fields[n] for n in names]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class LongestRise:
    """``(<key>, length)``; a key with null values only has none, a null key is a key."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        by = [c.strip() for c in _named(order, "order").split(",")]
        first, *_ = _columns(table, [_named(key, "key"), _named(value, "value"), *by])
        return AnalyzeResult(
            T.StructType([first, T.StructField("length", T.LongType())]), partitionBy=[PartitioningColumn(_quoted(key.value))],
            orderBy=[OrderingColumn(_quoted(c)) for c in by], select=[SelectedColumn(_quoted(key.value)), SelectedColumn(_quoted(value.value))])

    def __init__(self) -> None:
        self.key, self.ends = None, []

    def eval(self, row: T.Row, key: str, order: str, value: str) -> None:
        self.key, v = row[0], row[1]
        if v is not None:
            at = bisect_left(self.ends, v)
            self.ends[at : at + 1] = [v]

    def terminate(self) -> Iterator[tuple]:
        if self.ends:
            yield self.key, len(self.ends)


def _is_packed(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.ArrayType)


def _result(first: T.StructField, name: str, arrays: bool) -> T.StructType:
    return T.StructType([first, T.StructField(name, T.ArrayType(T.LongType()) if arrays else T.LongType())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ends = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in batch.columns], batch.schema.names)


def packed(rows: DataFrame) -> DataFrame:
    """The rows of each Arrow batch as one row of arrays, where and in the order they are."""
    schema = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in rows.schema])
    return rows.mapInArrow(_pack, schema)


def unpacked(rows: DataFrame) -> DataFrame:
    """One row for each place of the arrays."""
    return rows.select(F.inline(F.arrays_zip(*[_quoted(c) for c in rows.columns]))).toDF(*rows.columns)


class FoldPart:
    """``(<key>, state)``: the fold of what one task has of each key; null values are skipped.

    A value column of arrays holds packed rows.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, value: AnalyzeArgument, how: AnalyzeArgument) -> AnalyzeResult:
        first, second = _columns(table, [_named(key, "key"), _named(value, "value")])
        if _named(how, "how") not in FOLDS:
            raise ValueError(f"there is no fold {how.value}")
        arrays = _is_packed(second)
        if not isinstance(second.dataType.elementType if arrays else second.dataType, T.IntegralType):
            raise ValueError("the value must be an integer")
        if arrays and not _is_packed(first):
            raise ValueError("keys and values must be packed alike")
        return AnalyzeResult(_result(first, "state", arrays),
                             select=[SelectedColumn(_quoted(key.value)), SelectedColumn(_quoted(value.value))])

    def __init__(self) -> None:
        self.states: dict[Any, int] = {}
        self.arrays = False

    def eval(self, row: T.Row, key: str, value: str, how: str) -> Iterator[tuple]:
        self.arrays = isinstance(row[1], list)
        states, fold = self.states, FOLDS[how]
        for k, v in zip(row[0], row[1], strict=True) if self.arrays else ((row[0], row[1]),):
            if v is None:
                continue
            before = states.get(k)
            if before is None:
                states[k] = abs(v) if how == "gcd" else v
            else:
                states[k] = fold(before, v)
            if len(states) > HELD_KEYS:
                yield from self.terminate()
                states.clear()

    def terminate(self) -> Iterator[tuple]:
        if not self.arrays:
            yield from self.states.items()
        elif self.states:
            yield list(self.states), list(self.states.values())


class FoldAll:
    """``(<key>, value)``: the states of each key, merged.

    Packed states must lie in one partition for each key, next to each other: dealt by the key and sorted by it.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, how: AnalyzeArgument) -> AnalyzeResult:
        first, second = _columns(table, [_named(key, "key"), "state"])
        if _named(how, "how") not in FOLDS:
            raise ValueError(f"there is no fold {how.value}")
        arrays = _is_packed(second)
        return AnalyzeResult(_result(first, "value", arrays), partitionBy=[] if arrays else [PartitioningColumn(_quoted(key.value))],
                             select=[SelectedColumn(_quoted(key.value)), SelectedColumn("state")])

    def __init__(self) -> None:
        self.key, self.state, self.arrays = None, None, False

    def eval(self, row: T.Row, key: str, how: str) -> Iterator[tuple]:
        self.arrays, fold = isinstance(row[1], list), FOLDS[how]
        if not self.arrays:
            self.key = row[0]
            self.state = row[1] if self.state is None else fold(self.state, row[1])
            return
        keys, values = [], []
        for k, v in zip(row[0], row[1], strict=True):
            if self.state is not None and k == self.key:
                self.state = fold(self.state, v)
                continue
            if self.state is not None:
                keys.append(self.key)
                values.append(self.state)
            self.key, self.state = k, v
        if keys:
            yield keys, values

    def terminate(self) -> Iterator[tuple]:
        if self.state is not None:
            yield ([self.key], [self.state]) if self.arrays else (self.key, self.state)


class WrapText:
    """``(no, piece)``: pieces of at most ``cols`` characters that concatenate back to the text.

    A piece ends before the last space that still fits, the first character not counted; without one it is cut at
    ``cols``. An empty text is one empty piece, a null none.
    """

    def eval(self, text: str, cols: int) -> Iterator[tuple]:
        if text is None:
            return
        at, number = 0, 0
        while at < len(text) or not number:
            end = at + cols
            if end < len(text):
                space = text.rfind(" ", at + 1, end + 1)
                end = space if space > 0 else end
            yield number, text[at:end]
            at, number = end, number + 1


def register(spark: SparkSession) -> None:
    spark.udtf.register("longest_rise", F.udtf(LongestRise))
    spark.udtf.register("fold_part", F.udtf(FoldPart))
    spark.udtf.register("fold_all", F.udtf(FoldAll))
    spark.udtf.register("wrap_text", F.udtf(WrapText, returnType="no bigint, piece string"))
