"""Nested data: flattening to any depth and applying a function that may fail."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources.store import store


def flatten_variant(df: DataFrame, ids: list[str], column: str) -> DataFrame:
    """Leaves of a nested VARIANT array in order, as ``(ids, path, leaf)``; empty arrays vanish.

    Each round opens one level of what is still an array, so there are as many rounds as levels. The
    path (an array of positions) sorts into the order of the leaves.
    """
    spark = df.sparkSession
    open_rows = df.select(*ids, F.array().cast("array<int>").alias("path"), F.col(column).alias("leaf"))
    leaves = None
    while True:
        step = open_rows.lateralJoin(spark.tvf.variant_explode(F.col("leaf").outer())).select(
            *ids, F.concat("path", F.array("pos")).alias("path"), F.col("value").alias("leaf"),
            F.schema_of_variant("value").startswith("ARRAY").alias("nested"))
        level = store(step, "flatten", nested=F.count_if("nested"))
        flat = level.df.filter(~F.col("nested")).drop("nested")
        leaves = flat if leaves is None else leaves.unionByName(flat)
        if not level.seen["nested"]:
            return leaves
        open_rows = level.df.filter("nested").drop("nested")


def apply_capturing(df: DataFrame, fn: Callable[..., object], args: list[str], result: T.DataType,
                    value: str = "value", error: str = "error") -> DataFrame:
    """Call ``fn`` per row; a raised exception becomes text in ``error`` and a NULL ``value``."""
    schema = T.StructType([*df.schema.fields, T.StructField(value, result), T.StructField(error, T.StringType())])

    def attempt(*row):
        try:
            return fn(*row), None
        except Exception as problem:  # captured as data
            return None, f"{type(problem).__name__}: {problem}"

    def run(batches):
        for batch in batches:
            done = [attempt(*row) for row in zip(*[batch[a] for a in args])]
            yield batch.assign(**{
                value: pd.Series([v for v, _ in done], index=batch.index, dtype="object"),
                error: pd.Series([e for _, e in done], index=batch.index, dtype="object"),
            })

    return df.mapInPandas(run, schema)
