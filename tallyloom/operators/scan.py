"""Running aggregates over ordered groups that stay parallel when one group is huge.

A window ``partitionBy(key).orderBy(...)`` puts a whole group into one task. That is right for most
keys and wrong for a key that holds a third of the table. ``OrderedGroups`` counts the groups first
(one map-side combined aggregate on the key columns). Groups up to ``max_rows`` use the plain window.
Larger ones are range-partitioned on (key, order) into chunks; running aggregates are taken per chunk,
the chunk totals are accumulated over the few chunks of each key, and the carried value is combined
with the chunk-local one. Both ways give the same rows: NULL keys are one group, NULL values are skipped by
the aggregates. Sums are only exact for integers and decimals; sums of doubles may differ in the last
digits, as they are added up in another order.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.store import small, store

MAX_ROWS_SETTING = "spark.tallyloom.maxGroupRows"
MAX_ROWS_DEFAULT = 2_000_000
MAX_CHUNKS = 10_000
"""Chunks per scan; beyond that the chunks grow instead (each is sorted on its own and may spill)."""
CHUNK = "_chunk"


def max_group_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(MAX_ROWS_SETTING, str(MAX_ROWS_DEFAULT)))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


@dataclass(frozen=True)
class Split:
    """Rows of ordinary groups, rows of oversized groups (None if there are none), and their numbers."""

    cold: DataFrame
    hot: DataFrame | None = None
    hot_rows: int = 0
    hot_keys: int = 0


def split_hot(df: DataFrame, keys: list[str], max_rows: int) -> Split:
    """Part the groups of more than ``max_rows`` rows from the others.

    There are at most ``rows / max_rows`` oversized keys, so the table of them is small by design.
    """
    if not keys:
        rows = df.count()
        return Split(df.limit(0), df, rows, 1) if rows > max_rows else Split(df)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    if counts.isEmpty():
        return Split(df)
    hot = store(counts, "hot", total=F.sum("_n"))
    match, table = same_keys(df, hot.df, keys), small(hot.rows, hot.df)
    return Split(df.join(table, match, "left_anti"), df.join(table, match, "left_semi"),
                 int(hot.seen["total"]), hot.rows)


def named_groups(hot: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``hot`` with a number ``name`` for each group in place of its keys, and the table of the numbers.

    For operators that join or compare on the key: a number is never NULL and compares exactly. There
    are at most ``rows / max_rows`` oversized groups, so they are numbered in one task.
    """
    if not keys:
        return hot.withColumn(name, F.lit(1)), hot.sparkSession.range(1).select(F.lit(1).alias(name))
    groups = store(hot.select(*keys).distinct().withColumn(name, F.row_number().over(Window.orderBy(*keys))), "groups")
    numbered = hot.join(small(groups.rows, groups.df), same_keys(hot, groups.df, keys))
    rest = [hot[c] for c in hot.columns if c not in keys]
    return numbered.select(groups.df[name], *rest), groups.df


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``kind`` is sum, min, max or prev (the value of the preceding row)."""

    kind: str
    value: Column

    def over(self, rows: Window) -> Column:
        if self.kind == "prev":
            return F.lag(self.value).over(rows)
        agg = {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](self.value)
        return agg.over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def total(self, order: Column, descending: bool) -> Column:
        """What one chunk hands on."""
        if self.kind == "prev":
            boxed = F.struct(self.value.alias("value"))
            return (F.min_by if descending else F.max_by)(boxed, order)
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](self.value)

    def carried(self, total: str, chunks: Window) -> Column:
        """What a chunk receives from all chunks before it."""
        if self.kind == "prev":
            return F.lag(total).over(chunks)
        agg = {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](total)
        return agg.over(chunks.rowsBetween(Window.unboundedPreceding, -1))

    def joined(self, local: Column, carry: Column, first: Column) -> Column:
        if self.kind == "sum":
            return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
        if self.kind == "prev":
            return F.when(first, carry["value"]).otherwise(local)
        return (F.least if self.kind == "min" else F.greatest)(carry, local)


def running_sum(value: Column | str) -> Running:
    return Running("sum", F.col(value) if isinstance(value, str) else value)


def running_min(value: Column | str) -> Running:
    return Running("min", F.col(value) if isinstance(value, str) else value)


def running_max(value: Column | str) -> Running:
    return Running("max", F.col(value) if isinstance(value, str) else value)


def previous(value: Column | str) -> Running:
    return Running("prev", F.col(value) if isinstance(value, str) else value)


def row_count() -> Running:
    """The 1-based row number."""
    return running_sum(F.lit(1).cast("bigint"))


@dataclass(frozen=True)
class OrderedGroups:
    """Rows grouped by ``keys`` and ordered by ``order``, which must end in a unique column."""

    cold: DataFrame
    hot: DataFrame | None
    keys: list[str]
    order: list[str]
    descending: bool = False
    carry_rows: int = 0
    """Upper bound of (key, chunk) pairs; keys are contiguous over the chunks, so chunks + keys."""

    @staticmethod
    def of(
        df: DataFrame, keys: list[str], order: list[str], descending: bool = False,
        max_rows: int | None = None,
    ) -> OrderedGroups:
        limit = max_rows or max_group_rows(df)
        parts = split_hot(df, keys, limit)
        if parts.hot is None:
            return OrderedGroups(parts.cold, None, keys, order, descending)
        chunks = min(max(2, ceil(2 * parts.hot_rows / limit)), MAX_CHUNKS)
        ranged = parts.hot.repartitionByRange(chunks, *keys, *order)
        hot = store(ranged.withColumn(CHUNK, F.spark_partition_id()), "chunks").df
        return OrderedGroups(parts.cold, hot, keys, order, descending, chunks + parts.hot_keys)

    def _sorted(self, keys: list[str], order: list[str]) -> Window:
        cols = [F.col(c).desc() if self.descending else F.col(c).asc() for c in order]
        return Window.partitionBy(*keys).orderBy(*cols)

    def with_running(self, **specs: Running) -> OrderedGroups:
        """Add one column per running aggregate (inclusive of the row; ``prev`` excludes it)."""
        rows = self._sorted(self.keys, self.order)
        cold = self.cold.withColumns({n: s.over(rows) for n, s in specs.items()})
        if self.hot is None:
            return replace(self, cold=cold)
        scope = [*self.keys, CHUNK]
        position = F.struct(*self.order)
        totals = self.hot.groupBy(*scope).agg(
            *[s.total(position, self.descending).alias(f"_t_{n}") for n, s in specs.items()]
        )
        chunks = self._sorted(self.keys, [CHUNK])
        carries = totals.select(
            *[F.col(k).alias(f"_k_{k}") for k in scope],
            *[s.carried(f"_t_{n}", chunks).alias(f"_c_{n}") for n, s in specs.items()],
        )
        inside = self._sorted(scope, self.order)
        local = self.hot.withColumns(
            {f"_l_{n}": s.over(inside) for n, s in specs.items()}
            | {"_first": F.row_number().over(inside) == 1}
        )
        match = reduce(
            lambda a, b: a & b, [local[k].eqNullSafe(carries[f"_k_{k}"]) for k in scope]
        )
        hot = local.join(small(self.carry_rows, carries), match).select(
            *[local[c] for c in self.hot.columns],
            *[
                s.joined(F.col(f"_l_{n}"), F.col(f"_c_{n}"), F.col("_first")).alias(n)
                for n, s in specs.items()
            ],
        )
        return replace(self, cold=cold, hot=hot)

    def rows(self) -> DataFrame:
        """All rows with the columns added so far."""
        return self.cold if self.hot is None else self.cold.unionByName(self.hot.drop(CHUNK))
