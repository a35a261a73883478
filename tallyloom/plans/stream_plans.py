"""Streaming queries: each runs over the files that are there now and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators import ordered as od
from tallyloom.plans.event_plans import LEVELS_SQL, error_step
from tallyloom.plans.registry import query
from tallyloom.sources.store import new_path
from tallyloom.sources.tables import load
from tallyloom.streaming import jobs


FILE_ROWS = 1_000_000


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    load(spark, sf_dir, name)  # pins the session time zone
    return jobs.read_files(spark, sf_dir, f"{name}.parquet")


def in_order(spark: SparkSession, df: DataFrame, by: list[str], most: int = FILE_ROWS) -> DataFrame:
    """The table as a stream of several files in the order of ``by``, one file for each micro-batch.

    ``by`` ends in a unique column. A file has about ``most`` rows; NULLs come in the first one.
    """
    cut, folder = new_path(spark, "cut"), new_path(spark, "arrivals")
    files = max(4, -(-df.count() // most))
    ranged = df.repartitionByRange(files, *[F.col(c).asc_nulls_first() for c in by])
    ranged.withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(cut)
    parts = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(cut)
    numbers = sorted(r[0] for r in parts.select("_part").distinct().collect())  # one for each file
    for i in numbers or [0]:  # written one after the other, as they would arrive
        parts.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(f"{folder}/rows")
    return jobs.read_files(spark, folder, "rows", maxFilesPerTrigger="1")


@query("stream_rate", """
WITH w AS (SELECT user_id, unnest(range(epoch_us(ts) // 300000000 - 11, epoch_us(ts) // 300000000 + 1)) * 300 AS window_start
           FROM events)
SELECT user_id, window_start, window_start + 3600 AS window_end, count(*) AS n, count(*) >= 3 AS limited FROM w
GROUP BY ALL HAVING (window_start + 3600) * 1000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM events)""")
def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rates every five minutes, as far as the watermark (ten minutes) has closed the windows."""
    events = stream(spark, sf_dir, "events").select("ts", "user_id")
    rates = jobs.sliding_rate(events, "ts", "user_id", "60 minutes", "5 minutes", "10 minutes", 3)
    return jobs.run_to_table(rates, "rate").select(
        "user_id", F.unix_seconds("window_start").alias("window_start"),
        F.unix_seconds("window_end").alias("window_end"), "n", "limited")


@query("stream_error_level", LEVELS_SQL + "SELECT event_id, user_id, level FROM levels")
def stream_error_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events arrive in files in the order of time, one file a micro-batch."""
    days = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "props")
    events = in_order(spark, days, ["ts", "event_id"])
    out = jobs.stream_levels(events, "user_id", "ts", "event_id", error_step(), new_path(spark, "levels"))
    schema = T.StructType([*days.select("event_id", "user_id").schema.fields, T.StructField("level", T.LongType())])
    return spark.read.schema(schema).parquet(out).select("event_id", "user_id", "level")


@query("stream_reorder", """
SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderkey FROM orders""")
def stream_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders arriving by key in micro-batches, released by date through a buffer as large as they are late."""
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    late = od.displacement(rows, ["o_custkey"], ["o_orderkey"], ["o_orderdate", "o_orderkey"], 0)
    most = late.agg(F.max("moved")).first()[0] or 0
    orders = in_order(spark, rows, ["o_orderkey"])
    out = jobs.stream_reorder(orders, "o_custkey", ["o_orderdate", "o_orderkey"], int(most) + 1, new_path(spark, "reorder"))
    return out.select("o_custkey", "seq", "o_orderkey")


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries of the same events come out once."""
    events = stream(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    again = stream(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    once = jobs.distinct_events(events.unionByName(again), "ts", ["event_id"], "1 day")
    return jobs.run_to_table(once.drop("ts"), "dedup")


@query("stream_new_files", "SELECT doc_id, source FROM documents")
def stream_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run over the same folder finds no new file and adds nothing."""
    documents = stream(spark, sf_dir, "documents").select("doc_id", "source")
    out, progress = new_path(spark, "pickup"), new_path(spark, "pickup-progress")
    jobs.append_files(documents, out, progress)
    jobs.append_files(documents, out, progress)
    return spark.read.schema(documents.schema).parquet(out)
