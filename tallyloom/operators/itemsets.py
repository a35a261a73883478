"""Frequent item sets of any size by pattern growth over merged baskets.

Baskets with the same items are one row with a weight before anything is counted. A level holds, for each frequent set
of its size, what the baskets that hold the set have behind its last item, again with equal rows merged to one with the
sum of their weights. The next level is a count over (set, next item) and one join with the sets that are frequent, for all sets
and baskets at once: a level never has more rows than there are different (set, rest of a basket), however many baskets repeat
them, and nothing is computed once per set.

``packed`` and ``unpacked`` turn an engine bitmap into bytes and back; bitmaps with few bits become lists of places.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources.store import small, store

BUCKET = 32_768
SPARSE = BUCKET // 32
"""Bits up to which a list of 16-bit places is at most half the bitmap."""


def unpacked(data: bytes) -> np.ndarray:
    """A bitmap as bytes; a shorter value is a list of places."""
    if len(data) == BUCKET // 8:
        return np.frombuffer(data, np.uint8)
    out = np.zeros(BUCKET, bool)
    out[np.frombuffer(data, "<u2")] = True
    return np.packbits(out, bitorder="little")


def packed(bits: np.ndarray, count: int) -> bytes:
    if count > SPARSE:
        return bits.tobytes()
    return np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype("<u2").tobytes()


def frequent_sets(df: DataFrame, basket: str, item: str, min_support: int, longest: int | None = None) -> DataFrame:
    """``(items, support)``: every set of items, in ascending order, that at least ``min_support`` baskets hold together.

    ``longest`` bounds the number of items. A basket that holds an item several times holds it once; null baskets and items
    are left out. A support below 1 counts as 1, so sets that no basket holds never come out.
    """
    least = max(1, min_support)
    held = store(df.select(F.col(basket).alias("basket"), F.col(item).alias("last")).filter("basket IS NOT NULL AND last IS NOT NULL").distinct(), "held")
    single = store(held.df.groupBy("last").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least), "single")
    kind = held.df.schema["last"].dataType
    kept = held.df.join(small(single.rows, single.df.select("last")), "last", "left_semi")
    baskets = kept.groupBy("basket").agg(F.sort_array(F.collect_list("last")).alias("rest"))
    merged = baskets.groupBy("rest").agg(F.count(F.lit(1)).alias("weight"))
    level = store(merged.select(F.lit(0).cast("bigint").alias("prefix"), "rest", "weight"), "level")
    held.drop()
    single.drop()
    out, before, size = None, None, 0
    while (level.rows and size != longest) or out is None:
        size += 1
        grown = level.df.select("prefix", F.posexplode("rest").alias("at", "last"), "rest", "weight")
        counts = grown.groupBy("prefix", "last").agg(F.sum("weight").alias("support")).filter(F.col("support") >= least)
        if before is None:
            counts = counts.withColumn("items", F.array().cast(T.ArrayType(kind)))
        else:
            counts = counts.join(small(before.rows, before.df.select(F.col("id").alias("prefix"), "items")), "prefix")
        found = store(counts.select("prefix", "last", F.concat("items", F.array("last")).alias("items"), "support",
                                    F.monotonically_increasing_id().alias("id")), "frequent")
        sets = found.df.select("items", "support")
        out, before = sets if out is None else out.unionByName(sets), found
        behind = grown.filter(F.col("at") + 1 < F.size("rest")).join(
            small(found.rows, found.df.select("prefix", "last", "id")), ["prefix", "last"])
        behind = behind.select(F.col("id").alias("prefix"), F.expr("slice(rest, at + 2, size(rest))").alias("rest"), "weight")
        done, level = level, store(behind.groupBy("prefix", "rest").agg(F.sum("weight").alias("weight")), "level")
        done.drop()
    return out
