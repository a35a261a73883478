"""Grouped aggregates: histograms, granularity, cubes, combinations, bitmaps, summaries."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.scan import OrderedGroups, running_sum, same_keys
from tallyloom.sources.store import small, store


def success_summary(df: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Total, successful, failed and success rate; a key without rows cannot occur, so no zero guard."""
    total = F.count(F.lit(1))
    good = F.count_if(ok)
    return df.groupBy(*keys).agg(
        total.alias("total"), good.alias("successful"), (total - good).alias("failed"),
        F.coalesce(F.try_divide(good.cast("double"), total.cast("double")), F.lit(0.0)).alias("success_rate"),
    )


def status_counts(df: DataFrame, phase: str, status: str, statuses: list[str]) -> DataFrame:
    """One row per phase with one count column per status, and one for all others and NULL."""
    return df.groupBy(phase).agg(
        *[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses],
        F.count_if(~F.coalesce(F.col(status).isin(*statuses), F.lit(False))).alias("n_other"),
        F.count(F.lit(1)).alias("total"),
    )


LARGEST_SCAN = 10_000_000
"""Buckets that one task may sum up; more are scanned in chunks."""


def bucket_count(df: DataFrame, value: str, k: int | None = None) -> int:
    """Number of buckets 0, 1, ... that hold the whole column: ``k``, or the largest value + 1.

    Raises if a value has no bucket: NULL, below 0, with a fraction, or ``k`` and above.
    """
    x = F.col(value)
    bad = F.count_if(x.isNull() | (x < 0) | (x != F.floor(x)) | (x >= k if k is not None else F.lit(False)))
    misfits, most = df.agg(bad, F.max(x)).first()
    if misfits:
        raise ValueError(f"{misfits} values of {value} fit no bucket")
    return k if k is not None else int(most) + 1 if most is not None else 0


def histogram(df: DataFrame, value: str, k: int | None = None) -> DataFrame:
    """Counts of the integers 0..k-1, zero where a value does not occur; see ``bucket_count``."""
    buckets = df.sparkSession.range(bucket_count(df, value, k)).withColumnRenamed("id", "bucket")
    counts = df.groupBy(F.col(value).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("_n"))
    return buckets.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n")
    )


def counting_sort(df: DataFrame, value: str, k: int | None = None, block: int = 100_000) -> DataFrame:
    """The whole column in ascending order as ``(pos, value)``, rebuilt from the counts; see ``bucket_count``.

    A value that fills many rows is first cut into blocks, which are spread over the tasks before
    they are expanded.
    """
    counts = histogram(df, value, k).filter(F.col("n") > 0)
    upto = OrderedGroups.of(counts, [], ["bucket"], max_rows=LARGEST_SCAN).with_running(_upto=running_sum("n"))
    starts = upto.rows().withColumn("_from", F.col("_upto") - F.col("n"))
    blocks = starts.select(
        F.col("bucket").alias("value"), "_upto",
        F.explode(F.sequence("_from", F.col("_upto") - 1, F.lit(block).cast("bigint"))).alias("_start"),
    ).repartition("_start")
    last = F.least(F.col("_start") + F.lit(block), F.col("_upto")) - 1
    return blocks.select(F.explode(F.sequence("_start", last)).alias("pos"), "value")


# --- greatest common divisor -------------------------------------------------------------------------

def granularity(df: DataFrame, keys: list[str], value: Column, out: str = "gcd") -> DataFrame:
    """Greatest common divisor of an integer column per key (0 if all values are 0).

    NULL values are skipped, NULL keys are one group. The divisor is folded per Arrow batch before the
    shuffle, so a hot key sends a few numbers per partition, and folded again over the sorted partial
    results.
    """
    data = df.select(*keys, F.abs(value.cast("bigint")).alias(out)).filter(F.col(out).isNotNull())
    schema = data.schema

    def fold(rows: pa.Table) -> pa.Table:
        """One row for each key, in the order of first appearance."""
        group = np.zeros(rows.num_rows, np.int64)
        for k in keys:
            column = rows.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            group = np.unique(group * (len(column.dictionary) + 1) + column.indices.to_numpy(), return_inverse=True)[1]
        by = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[by], prepend=-1))
        first = by[starts]
        divisors = np.gcd.reduceat(rows.column(out).to_numpy()[by], starts)
        seen = np.argsort(first)
        folded = rows.select(keys).take(pa.array(first[seen]))
        return folded.append_column(out, pa.array(divisors[seen]))

    def partial(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(fold(pa.Table.from_batches([batch])))
                size += held[-1].num_rows
            if size > 200_000:
                merged = fold(pa.concat_tables(held))
                held, size = [merged], merged.num_rows
                if size > 100_000:  # mostly distinct keys: pass them on, nothing more to fold here
                    yield from merged.to_batches()
                    held, size = [], 0
        if held:
            yield from fold(pa.concat_tables(held)).to_batches()

    def final(batches):
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            mine = pa.Table.from_batches([batch])
            both = fold(mine if carry is None else pa.concat_tables([carry, mine]))
            carry = both.slice(both.num_rows - 1)
            yield from both.slice(0, both.num_rows - 1).to_batches()
        if carry is not None:
            yield from carry.to_batches()

    partials = data.mapInArrow(partial, schema)
    return partials.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(final, schema)


# --- cubes and combinations --------------------------------------------------------------------------

WIDE_SET = 200
"""Item sets beyond this size are expanded by more than one task."""


def cube_sum(df: DataFrame, dims: list[str], measure: Column, out: str) -> DataFrame:
    """Sum and row count for every subset of ``dims``.

    The finest grain is aggregated first, so the 2^n expansion touches groups and not rows.
    """
    grain = df.groupBy(*dims).agg(F.sum(measure).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    return grain.cube(*dims).agg(
        F.grouping_id().cast("bigint").alias("grouping"),
        F.sum("_sum").alias(out), F.sum("_n").alias("n"),
    )


def combinations(items: Column, k: int) -> Column:
    """All ascending k-element combinations of a sorted, duplicate-free array column."""
    if k == 0:
        return F.array(F.array().cast(T.ArrayType(T.StringType())))
    found = F.transform(items, lambda x: F.array(x))
    for _ in range(k - 1):
        found = F.flatten(F.transform(found, lambda c: F.transform(
            F.filter(items, lambda x: x > F.element_at(c, -1)),
            lambda x: F.concat(c, F.array(x)),
        )))
    return found


def frequent_combinations(df: DataFrame, basket: str, item: str, k: int, min_support: int) -> DataFrame:
    """k-item combinations held together by at least ``min_support`` baskets.

    Rare items are dropped first (no combination with them can qualify), equal item sets are counted
    once, and only the distinct item sets are expanded, one item per step. Between the steps only
    combinations that are frequent themselves go on, as no larger one can be more frequent. An item
    set never holds more than the frequent items, of which there are at most (distinct basket-item
    pairs) / min_support. If there are wide sets, their first items are dealt out before the next step.
    """
    held = store(df.select(basket, item).distinct(), "held").df
    common = store(
        held.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_support).select(item),
        "common")
    sets = store(
        held.join(small(common.rows, common.df), item, "left_semi")
        .groupBy(basket).agg(F.sort_array(F.collect_set(item)).alias("_rest"))
        .filter(F.size("_rest") >= k)
        .groupBy("_rest").agg(F.count(F.lit(1)).alias("_n")),
        "sets", widest=F.max(F.size("_rest")))
    rows = sets.df.withColumn("items", F.array().cast(sets.df.schema["_rest"].dataType))
    for missing in range(k - 1, -1, -1):
        picked = rows.filter(F.size("_rest") > missing).select("_n", "items", "_rest", F.posexplode("_rest").alias("_at", "_x"))
        rows = picked.select(
            "_n", F.concat("items", F.array("_x")).alias("items"),
            F.slice("_rest", F.col("_at") + 2, F.size("_rest")).alias("_rest"))
        if missing == k - 1 and (sets.seen["widest"] or 0) > WIDE_SET:
            rows = rows.repartition(F.xxhash64("items", "_rest"))
        if 0 < missing < k - 1:
            level = store(rows.filter(F.size("_rest") >= missing), "level").df
            going = store(level.groupBy("items").agg(F.sum("_n").alias("_s"))
                          .filter(F.col("_s") >= min_support).select("items"), "going")
            rows = level.join(small(going.rows, going.df), "items", "left_semi")
    return (
        rows.groupBy("items").agg(F.sum("_n").cast("bigint").alias("support"))
        .filter(F.col("support") >= min_support)
    )


# --- sets per key ------------------------------------------------------------------------------------

def kind_bitmap(df: DataFrame, keys: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """One bit per kind seen, and how many bits are set."""
    code = reduce(
        lambda c, n: c.when(F.col(kind) == kinds[n], F.lit(1 << n)), range(1, len(kinds)),
        F.when(F.col(kind) == kinds[0], F.lit(1)),
    )
    return df.groupBy(*keys).agg(
        F.coalesce(F.bit_or(code.cast("bigint")), F.lit(0).cast("bigint")).alias("bitmap")
    ).withColumn("kinds", F.bit_count("bitmap").cast("bigint"))


def covering_groups(df: DataFrame, keys: list[str], item: str, required: list[str]) -> DataFrame:
    """Keys whose items are a superset of ``required``."""
    flags = [F.bool_or(F.col(item) == r).alias(f"_has{n}") for n, r in enumerate(required)]
    covered = reduce(lambda a, b: a & b, [F.col(f"_has{n}") for n in range(len(required))])
    return df.groupBy(*keys).agg(*flags).filter(covered).select(*keys)


def covering_pairs(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Keys of ``right`` whose every item also occurs under the same key in ``left``."""
    wanted = right.select(*keys, item).distinct()
    missing = wanted.join(left, same_keys(wanted, left, [*keys, item]), "left_anti").select(*keys).distinct()
    groups = wanted.select(*keys).distinct()
    return groups.join(missing, keys, "left_anti")


def best_attempt(df: DataFrame, keys: list[str], ok: Column, order: list[str], keep: list[str]) -> DataFrame:
    """Per key the latest successful row, or the latest row if none succeeded."""
    best = F.max_by(F.struct(*keep, ok.alias("_ok")), F.struct(ok, *order))
    picked = df.groupBy(*keys).agg(best.alias("_best"))
    return picked.select(*keys, *[F.col(f"_best.{c}") for c in keep], F.col("_best._ok").alias("succeeded"))


# --- key codes ---------------------------------------------------------------------------------------

def radix(number: Column, base: int) -> Column:
    """Digits 0-9A-Z of a positive number; the empty string for zero."""
    return F.when(number == 0, F.lit("")).otherwise(F.conv(number.cast("string"), 10, base))
