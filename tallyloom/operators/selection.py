"""Best total value of items under a capacity, for all groups at once."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.store import small, store

PARTIAL_LIMIT = 1000
"""Row numbers up to this are limited per partition before the shuffle (a planner threshold)."""


def best_under_capacity(items: DataFrame, keys: list[str], weight: Column, value: Column, capacity: Column,
                        out: str = "best_value") -> DataFrame:
    """0/1 selection: the largest total value whose total weight fits the capacity, per key.

    At most capacity / w items of weight w can be taken, and then the most valuable ones, so each
    (key, weight) shrinks to that many rows before anything else happens. Its prefix sums are a small
    table (weight used -> value). The tables of a key are merged in pairs, halving their number per
    round, and states that weigh more without being worth more are dropped. Items of weight 0 are always
    taken if they are worth something; items of negative or NULL weight, and of NULL value, never are.
    NULL keys are one group.
    """
    groups = store(items.select(*keys, capacity.alias("_cap")).distinct().withColumn("_g", F.monotonically_increasing_id()), "groups")
    own, keys = keys, ["_g"]
    name = {c: f"_k{i}" for i, c in enumerate([*own, "_cap"])}
    sized = items.select(*own, capacity.alias("_cap"), weight.alias("_w"), value.alias("_v"))
    same_group = reduce(and_, [sized[c].eqNullSafe(F.col(k)) for c, k in name.items()])
    numbers = small(groups.rows, groups.df.select("_g", *[F.col(c).alias(k) for c, k in name.items()]))
    sized = store(sized.join(numbers, same_group).select("_g", "_w", "_v", "_cap"), "items").df
    free = sized.filter((F.col("_w") == 0) & (F.col("_v") > 0) & (F.col("_cap") >= 0)).groupBy("_g").agg(F.sum("_v").alias("_free"))
    sized = sized.filter((F.col("_w") > 0) & (F.col("_w") <= F.col("_cap")) & (F.col("_v") > 0))
    most = sized.agg(F.max(F.floor(F.col("_cap") / F.col("_w")))).first()[0] or 0
    best_first = F.col("_v").desc()
    if most > PARTIAL_LIMIT:  # too many for the planner's own limit before the shuffle
        here = Window.partitionBy(*keys, "_cap", "_w", "_salt").orderBy(best_first)
        sized = (
            sized.withColumn("_salt", F.spark_partition_id())
            .withColumn("_rn", F.row_number().over(here)).filter(F.col("_rn") <= most).drop("_salt", "_rn")
        )
    same = Window.partitionBy(*keys, "_cap", "_w").orderBy(best_first)
    top = sized.withColumn("_rn", F.row_number().over(same)).filter(F.col("_rn") <= most)
    upto = same.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = store(
        top.filter(F.col("_rn") <= F.floor(F.col("_cap") / F.col("_w")))
        .withColumns({"_used": F.col("_rn") * F.col("_w"), "_val": F.sum("_v").over(upto)})
        .withColumn("_slot", F.dense_rank().over(Window.partitionBy(*keys, "_cap").orderBy("_w")) - 1)
        .select(*keys, "_cap", "_slot", "_used", "_val"),
        "classes",
    ).df
    used, val = (F.lit(0).cast(taken.schema[c].dataType).alias(c) for c in ("_used", "_val"))
    first = groups.df.select("_g", "_cap").withColumn("_slot", F.lit(0))
    nothing = taken.select(*keys, "_cap", "_slot").unionByName(first).distinct()
    start = taken.unionByName(nothing.select(*keys, "_cap", "_slot", used, val))
    state = store(start, "budget", slots=F.max("_slot"))
    slots_left = int(state.seen["slots"] or 0)
    while slots_left > 0:
        state_next = store(_merge(state.df, keys), "budget", slots=F.max("_slot"))
        state.drop()
        state, slots_left = state_next, slots_left // 2
    best = state.df.groupBy("_g").agg(F.max("_val").alias("_best")).join(free, "_g", "left")
    total = F.col("_best") + F.coalesce("_free", F.lit(0))
    return groups.df.join(best, "_g").select(*own, total.cast(state.df.schema["_val"].dataType).alias(out))


def _merge(state: DataFrame, keys: list[str]) -> DataFrame:
    """Combine the tables in slots 2i and 2i + 1 of every key; a last odd one moves on as it is."""
    pair = F.floor(F.col("_slot") / 2).cast("int")
    even = state.filter(F.col("_slot") % 2 == 0).withColumn("_slot", pair)
    odd = state.filter(F.col("_slot") % 2 == 1).select(
        *keys, "_cap", pair.alias("_slot"), F.col("_used").alias("_used2"), F.col("_val").alias("_val2"))
    on = [*keys, "_cap", "_slot"]
    sums = even.join(odd, on, "left").filter(
        F.col("_used") + F.coalesce("_used2", F.lit(0)) <= F.col("_cap")
    ).select(
        *on, (F.col("_used") + F.coalesce("_used2", F.lit(0))).alias("_used"),
        (F.col("_val") + F.coalesce("_val2", F.lit(0))).alias("_val"),
    ).groupBy(*on, "_used").agg(F.max("_val").alias("_val"))
    lighter = Window.partitionBy(*on).orderBy("_used").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.withColumn("_ahead", F.max("_val").over(lighter))
    return ahead.filter(F.col("_ahead").isNull() | (F.col("_val") > F.col("_ahead"))).drop("_ahead")
