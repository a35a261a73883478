"""Shared helpers: tables, written intermediates, connected components, Arrow columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    The setting is read from the session and never changed. Only a session inside one process may leave it
    unset; its tables then go to a folder of its own that is deleted when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _local_root(spark.conf.get("spark.master", ""))
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local_root(master: str) -> str:
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="tallyloom-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage at a durable table.

    The shuffle files of the write go as soon as it has ended; the setting for that is put back.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def free(*tables: DataFrame) -> None:
    """Empty tables made by ``written`` that nothing will read any more."""
    for df in tables:
        if files := df.inputFiles():
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


SUM = "count(*)", "bit_xor(xxhash64(u, v))", "sum(xxhash64(u, v) % 1000003)"


def components(edges: DataFrame) -> DataFrame:
    """``(id, comp)``: for each vertex of ``edges(a, b)`` the smallest vertex that it reaches.

    Alternating star contraction: every vertex hands its neighbours to the smallest one, once over
    its larger and once over its smaller neighbours, until nothing moves. Each half round is two
    shuffles on the vertex with map-side minima and a join that splits hot vertices; a round is a
    written table. The number of rounds grows with the logarithm of the diameter.
    """
    at = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .filter("u <> v").distinct())
    seen = at.selectExpr(*SUM).first()
    while seen[0]:
        # large star: larger neighbours of u point to the least of u's neighbourhood
        both = at.select("u", "v").unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")))
        large = (both.join(least.withColumn("m", F.least("u", "m")), "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        large = written(large)
        # small star: u and its smaller neighbours point to the least of them
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        at, before = written(small), seen
        seen = at.selectExpr(*SUM).first()
        if seen == before:
            break
    return at.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(
        at.select(F.col("v").alias("id"), F.col("v").alias("comp"))).distinct()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, places, values = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


MOST_ROWS = 32_768


def slices(batches: Iterator[pa.RecordBatch], text: int | str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of whole rows of about ``limit`` text bytes, one row at least,
    ``MOST_ROWS`` at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            upto = min(max(upto, at + 1), at + MOST_ROWS, batch.num_rows)
            yield batch.slice(at, upto - at)
            at = upto


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
