"""Analytics over ordered rows: clamped counters, trailing windows, segments, ranks, subsequences."""

from __future__ import annotations

from bisect import bisect_left
from math import ceil, sqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.scan import (
    OrderedGroups, max_group_rows, named_groups, previous, row_count, running_min, running_sum, split_hot,
)
from tallyloom.sources.store import small, store


def clamped_level(df: DataFrame, keys: list[str], order: list[str], delta: Column, out: str = "level",
                  max_rows: int | None = None) -> DataFrame:
    """Counter that adds ``delta`` per row and never falls below zero, as of each row.

    With running total S the clamped counter is ``S - least(0, running min of S)``.
    """
    seq = OrderedGroups.of(df.withColumn("_delta", delta), keys, order, max_rows=max_rows)
    seq = seq.with_running(_sum=running_sum("_delta")).with_running(_low=running_min("_sum"))
    level = F.col("_sum") - F.least(F.lit(0), F.col("_low"))
    return seq.rows().withColumn(out, level).drop("_delta", "_sum", "_low")


def backoff(level: Column, base: float, ceiling: float) -> Column:
    """Delay that doubles with each level, up to ``ceiling``; ``base`` at level zero."""
    grown = F.least(F.lit(base) * F.pow(F.lit(2.0), level), F.lit(ceiling))
    return F.when(level > 0, grown).otherwise(F.lit(base))


def best_segment(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str = "best",
                 max_rows: int | None = None) -> DataFrame:
    """Largest sum of a contiguous run per key; the empty run counts as zero."""
    levels = clamped_level(df, keys, order, value, "_level", max_rows)
    return levels.groupBy(*keys).agg(F.max("_level").alias(out))


def balance(df: DataFrame, keys: list[str], order: list[str], delta: Column,
            max_rows: int | None = None) -> DataFrame:
    """Per key: does the running depth stay non-negative and end at zero?"""
    seq = OrderedGroups.of(df.withColumn("_delta", delta), keys, order, max_rows=max_rows)
    depth = seq.with_running(_depth=running_sum("_delta")).rows()
    return depth.groupBy(*keys).agg(
        ((F.min("_depth") >= 0) & (F.sum("_delta") == 0)).alias("balanced")
    )


def array_balance(steps: Column) -> Column:
    """``balance`` for an array of steps held in one row."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + x
        return F.struct(depth.alias("depth"), F.least(acc["low"], depth).alias("low"))

    return F.aggregate(steps, start, step, lambda acc: (acc["low"] >= 0) & (acc["depth"] == 0))


def trailing_count(df: DataFrame, keys: list[str], at: str, unique: str, width: int,
                   out: str = "in_window", max_rows: int | None = None) -> DataFrame:
    """Rows of the key seen so far whose ``at`` is at most ``width`` before the current row's.

    Every row arrives at ``at`` and expires just after ``at + width``; the running sum of arrivals
    minus expiries is the count. Rows at the same instant count in the order of ``unique``.
    """
    arrive = df.withColumns({"_when": F.col(at), "_expiry": F.lit(0)})
    expire = df.withColumns({"_when": F.col(at) + F.lit(width), "_expiry": F.lit(1)})
    marks = arrive.unionByName(expire)
    step = F.when(F.col("_expiry") == 0, 1).otherwise(-1).cast("bigint")
    seq = OrderedGroups.of(marks, keys, ["_when", "_expiry", unique], max_rows=max_rows)
    counted = seq.with_running(**{out: running_sum(step)}).rows()
    return counted.filter(F.col("_expiry") == 0).drop("_when", "_expiry")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "rn",
             max_rows: int | None = None) -> DataFrame:
    """1-based position of each row in its group; ``keys=[]`` ranks the whole table."""
    return OrderedGroups.of(df, keys, order, max_rows=max_rows).with_running(**{out: row_count()}).rows()


def with_previous(df: DataFrame, keys: list[str], order: list[str], max_rows: int | None = None,
                  **columns: str) -> DataFrame:
    """Add, per name, the given column of the preceding row of the group."""
    seq = OrderedGroups.of(df, keys, order, max_rows=max_rows)
    return seq.with_running(**{n: previous(c) for n, c in columns.items()}).rows()


def with_next(df: DataFrame, keys: list[str], order: list[str], max_rows: int | None = None,
              **columns: str) -> DataFrame:
    """Add, per name, the given column of the following row of the group."""
    seq = OrderedGroups.of(df, keys, order, descending=True, max_rows=max_rows)
    return seq.with_running(**{n: previous(c) for n, c in columns.items()}).rows()


def batch_number(df: DataFrame, keys: list[str], order: list[str], size: int, out: str = "batch",
                 max_rows: int | None = None) -> DataFrame:
    """0-based number of the fixed-size batch that each row falls into."""
    rows = numbered(df, keys, order, "_rn", max_rows)
    return rows.withColumn(out, F.floor((F.col("_rn") - 1) / F.lit(size)).cast("bigint")).drop("_rn")


def displacement(df: DataFrame, keys: list[str], arrival: list[str], target: list[str], k: int,
                 max_rows: int | None = None) -> DataFrame:
    """How far each row is from its sorted place, and whether a buffer of ``k`` could fix that."""
    rows = numbered(df, keys, arrival, "_came", max_rows)
    rows = numbered(rows, keys, target, "sorted_pos", max_rows)
    moved = F.abs(F.col("_came") - F.col("sorted_pos"))
    return rows.withColumns({"moved": moved, "within_k": moved <= k}).drop("_came")


def first_position(df: DataFrame, keys: list[str], order: list[str], item: str, items: list[str],
                   max_rows: int | None = None) -> DataFrame:
    """0-based position of the first row of each item per key, -1 where the item never occurs."""
    placed = numbered(df.select(*keys, *order, item), keys, order, "_rn", max_rows)
    firsts = placed.groupBy(*keys).agg(
        *[F.min(F.when(F.col(item) == i, F.col("_rn") - 1)).alias(f"_p{n}") for n, i in enumerate(items)]
    )
    cells = F.array(*[
        F.struct(F.lit(i).alias(item), F.coalesce(F.col(f"_p{n}"), F.lit(-1)).cast("bigint").alias("pos"))
        for n, i in enumerate(items)
    ])
    return firsts.select(*keys, F.inline(cells))


def equal_range(df: DataFrame, keys: list[str], value: str, max_rows: int | None = None) -> DataFrame:
    """First and last 0-based position of each value if every group were sorted by it.

    Only the value counts are ordered, never the rows.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = OrderedGroups.of(counts, keys, [value], max_rows=max_rows).with_running(_upto=running_sum("_n"))
    return upto.rows().select(
        *keys, value,
        (F.col("_upto") - F.col("_n")).alias("first_pos"), (F.col("_upto") - 1).alias("last_pos"),
    )


# --- k-th smallest ---------------------------------------------------------------------------------

BINS = 4096


def kth_smallest(df: DataFrame, keys: list[str], value: str, k: int, out: str = "kth",
                 max_rows: int | None = None) -> DataFrame:
    """k-th smallest (0-based, duplicates count) of a numeric column; groups of k rows or fewer give none.

    NULL values are skipped before anything is counted, NULL keys are one group, and the result has the
    column's own type. Ordinary groups are numbered. Oversized groups are narrowed: each round counts
    equal-width bins between the group's bounds and keeps only the bin holding rank k, until that bin is
    small or holds values that a double cannot tell apart; its values are then counted one by one.
    """
    limit = max_rows or max_group_rows(df)
    data = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    parts = split_hot(data, keys, limit)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_v"))
    found = parts.cold.withColumn("_rn", place).filter(F.col("_rn") == k + 1).select(*keys, F.col("_v").alias(out))
    if parts.hot is None:
        return found
    hot, groups = named_groups(parts.hot, keys, "_g")
    narrowed = _narrow(hot.select("_g", "_v"), k, out, limit)
    return found.unionByName(narrowed.join(groups, "_g").select(*keys, out))


def _narrow(hot: DataFrame, k: int, out: str, limit: int) -> DataFrame:
    def inside() -> DataFrame:
        """Rows between the current bounds of their group."""
        within = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        return hot.join(small(bounds.rows, bounds.df), "_g").filter(within)

    lo, hi = F.col("_lo").cast("double"), F.col("_hi").cast("double")
    unsettled = F.count_if((F.col("_n") > limit) & (lo < hi))
    bounds = store(
        hot.groupBy("_g").agg(
            F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            F.lit(k).cast("bigint").alias("_k"), F.count(F.lit(1)).alias("_n"),
        ).filter(F.col("_n") > k),
        "kth", unsettled=unsettled,
    )
    before = F.col("_upto") - F.col("_n")
    holds = (before <= F.col("_k")) & (F.col("_k") < F.col("_upto"))
    while bounds.seen["unsettled"]:
        share = F.try_divide(F.col("_v").cast("double") - lo, hi - lo)
        bins = (
            inside()
            .withColumn("_bin", F.coalesce(F.least(F.floor(share * BINS), F.lit(BINS - 1)), F.lit(0)))
            .groupBy("_g", "_bin", "_k")
            .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
        )
        upto = OrderedGroups.of(bins, ["_g"], ["_bin"], max_rows=BINS + 1).with_running(_upto=running_sum("_n"))
        kept = upto.rows().filter(holds).select("_g", "_lo", "_hi", (F.col("_k") - before).alias("_k"), "_n")
        bounds = store(kept, "kth", unsettled=unsettled)
    counts = inside().groupBy("_g", "_k", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = OrderedGroups.of(counts, ["_g"], ["_v"], max_rows=limit + 1).with_running(_upto=running_sum("_n"))
    return upto.rows().filter(holds).select("_g", F.col("_v").alias(out))


# --- longest increasing subsequence ------------------------------------------------------------------

def longest_increasing(df: DataFrame, keys: list[str], order: list[str], value: str,
                       out: str = "length", max_rows: int | None = None) -> DataFrame:
    """Length of the longest strictly increasing subsequence per key; a key with NULL values only has none.

    NULL values are skipped before anything else, NULL keys are one group. Ordinary groups are folded
    one after the other from sorted Arrow batches, carrying only the list of smallest ends. Oversized
    groups go through ``_wavefront``, on the rank of each value instead of the value itself.
    """
    limit = max_rows or max_group_rows(df)
    data = df.select(*keys, *order, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    parts = split_hot(data, keys, limit)
    schema = T.StructType([*[data.schema[k] for k in keys], T.StructField(out, T.LongType())])
    none = object()

    def fold(batches):
        current, ends = none, []
        for batch in batches:
            done, lengths = [], []
            columns = [batch.column(k).to_pylist() for k in [*keys, "_v"]]
            for *row_key, v in zip(*columns, strict=True):
                if row_key != current:
                    if current is not none:
                        done.append(current)
                        lengths.append(len(ends))
                    current, ends = row_key, []
                at = bisect_left(ends, v)
                ends[at:at + 1] = [v]
            if done:
                yield table(batch, done, lengths)
            last = batch
        if current is not none:
            yield table(last, [current], [len(ends)])

    def table(like, done, lengths):
        columns = [pa.array([d[i] for d in done], like.schema.field(k).type) for i, k in enumerate(keys)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(lengths, pa.int64())], [*keys, out])

    folded = (
        parts.cold.repartition(*(keys or [F.lit(0)])).sortWithinPartitions(*keys, *order).select(*keys, "_v")
        .mapInArrow(fold, schema)
    )
    if parts.hot is None:
        return folded
    side = ceil(sqrt(parts.hot_rows / limit)) + 1
    hot, groups = named_groups(parts.hot, keys, "_g")
    hot = store(hot, "hot").df
    ranks = store(equal_range(hot, ["_g"], "_v", max_rows), "ranks").df
    hot = hot.join(ranks.withColumn("_rank", F.col("first_pos").cast("double")), ["_g", "_v"])
    found = _wavefront(hot.select("_g", *order, F.col("_rank").alias("_v")), ["_g"], order, out, side,
                       T.StructType([hot.schema["_g"], T.StructField(out, T.LongType())]))
    return folded.unionByName(found.join(groups, "_g").select(*keys, out))


def _wavefront(hot: DataFrame, keys: list[str], order: list[str], out: str, parts: int,
               schema: T.StructType) -> DataFrame:
    """The same length for oversized groups, on a grid of time chunks x value chunks.

    A grid cell needs the best lengths seen at lower values in its own time chunk (as steps over the
    position), at earlier times in its own value chunk (as steps over the value), and the best length
    of everything both earlier and lower (one number). All cells of one anti-diagonal are independent,
    so each round runs them in parallel and hands steps on to the next diagonal.
    """
    grid = (
        hot.repartitionByRange(parts, *keys, *order).withColumn("_t", F.spark_partition_id())
        .repartitionByRange(parts, *keys, "_v").withColumn("_u", F.spark_partition_id())
    )
    placed = store(grid, "grid").df
    corner = placed.groupBy(*keys).agg(F.min("_t").alias("_t0"), F.min("_u").alias("_u0"),
                                       F.max("_t").alias("_t1"), F.max("_u").alias("_u1"))
    ends = store(corner, "corner")
    cells = placed.join(small(ends.rows, ends.df), keys).withColumns({
        "_t": F.col("_t") - F.col("_t0"), "_u": F.col("_u") - F.col("_u0"),
        "_tn": F.col("_t1") - F.col("_t0"), "_un": F.col("_u1") - F.col("_u0"),
    }).drop("_t0", "_u0", "_t1", "_u1")
    # positions become dense numbers inside a time chunk, so that steps can refer to them
    cells = numbered(cells, [*keys, "_t"], order, "_pos").withColumn("_diag", F.col("_t") + F.col("_u"))
    kept = [*keys, "_t", "_u", "_tn", "_un", "_pos", "_v", "_diag"]
    stored = store(cells.select(*kept), "cells", partition_by=["_diag"], last=F.max(F.col("_tn") + F.col("_un")))
    rows = stored.df

    names = [*keys, "_t", "_u", "_tn", "_un", "_kind", "_pos", "_v", "_len"]
    cell_schema = T.StructType(
        [schema[k] for k in keys]
        + [T.StructField(c, T.LongType()) for c in ["_t", "_u", "_tn", "_un"]]
        + [T.StructField("_kind", T.StringType()), T.StructField("_pos", T.LongType()),
           T.StructField("_v", T.DoubleType()), T.StructField("_len", T.LongType())]
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        group = [head[k] for k in keys]
        t, u, tn, un = (int(head[c]) for c in ["_t", "_u", "_tn", "_un"])
        kinds = {kind: part for kind, part in pdf.groupby("_kind")}
        empty = pdf.iloc[:0]
        base = int(kinds["corner"]["_len"].max()) if "corner" in kinds else 0
        lower = kinds.get("lower", empty).sort_values("_pos")
        lower_pos, lower_len = lower["_pos"].tolist(), lower["_len"].tolist()
        earlier = kinds.get("earlier", empty).sort_values("_v")
        values, lens = earlier["_v"].tolist(), earlier["_len"].tolist()
        mine = kinds.get("row", empty).sort_values("_pos")
        steps = list(zip(lower_pos, lower_len))
        best = max([base, *lower_len, *lens])
        for pos, v in zip(mine["_pos"], mine["_v"]):
            below = bisect_left(lower_pos, pos)
            at = bisect_left(values, v)
            length = 1 + max(base, lower_len[below - 1] if below else 0, lens[at - 1] if at else 0)
            best = max(best, length)
            steps.append((pos, length))
            if at < len(values) and values[at] == v and lens[at] >= length:
                continue
            end = at
            while end < len(values) and lens[end] <= length:
                end += 1
            values[at:end], lens[at:end] = [v], [length]
        out_rows = []
        if u < un:
            top = 0
            for pos, length in sorted(steps):
                if length > top:
                    top = length
                    out_rows.append((*group, t, u + 1, tn, un, "lower", pos, None, length))
        if t < tn:
            out_rows += [(*group, t + 1, u, tn, un, "earlier", None, v, n) for v, n in zip(values, lens)]
        out_rows.append((*group, t + 1, u + 1, tn, un, "corner", None, None, best))
        return pd.DataFrame(out_rows, columns=names)

    shape = [F.col(f.name).cast(f.dataType).alias(f.name) for f in cell_schema.fields]
    messages: list = []
    answer = None
    for diag in range(int(stored.seen["last"]) + 1):
        here = (
            rows.filter(F.col("_diag") == diag)
            .withColumns({"_kind": F.lit("row"), "_len": F.lit(None)}).select(*shape)
        )
        for sent in messages:
            inside = (F.col("_t") <= F.col("_tn")) & (F.col("_u") <= F.col("_un"))
            here = here.unionByName(sent.df.filter(inside & (F.col("_t") + F.col("_u") == diag)))
        solved = store(here.groupBy(*keys, "_t", "_u").applyInPandas(solve, cell_schema), "wave")
        final = solved.df.filter((F.col("_kind") == "corner") & (F.col("_t") > F.col("_tn"))
                                 & (F.col("_u") > F.col("_un")))
        answer = final if answer is None else answer.unionByName(final)
        messages = [*messages, solved][-2:]
    return answer.select(*keys, F.col("_len").alias(out))
