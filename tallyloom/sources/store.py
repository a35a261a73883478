"""Written intermediate tables.

Iterative operators cut their lineage by writing a parquet table under the shared folder named by
``spark.checkpoint.dir``, so a lost executor never loses a round and the next round plans with the
real file size. The row counts an operator needs to decide whether to stop are observed by the same
write and cost no extra job.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
"""Rows of a few scalar columns that are still small enough to send to every executor."""


TASK_ROWS = 1_000_000
"""Rows of a few scalar columns that one task sorts or groups, where a job knows how many it has."""


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over as many partitions as ``rows`` need, where that is more than the session's."""
    parts = -(-rows // TASK_ROWS)
    return df if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(parts, *keys)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a temporary one only for a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    path = tempfile.mkdtemp(prefix="tallyloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def work_dir(spark: SparkSession) -> str:
    """This application's own folder for written tables."""
    return f"{shared_dir(spark)}/tallyloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables this application wrote; DataFrames that still read them become invalid."""
    delete(spark, work_dir(spark))


@dataclass
class Stored:
    """A written table with the numbers observed while writing it."""

    df: DataFrame
    path: str
    rows: int
    seen: dict[str, int] = field(default_factory=dict)

    def drop(self) -> None:
        """Delete the files; call only when no live DataFrame reads them any more."""
        delete(self.df.sparkSession, self.path)


def store(df: DataFrame, label: str, partition_by: list[str] | None = None, **observed: Column) -> Stored:
    """Write ``df`` and read it back, observing its row count and any further aggregates."""
    spark = df.sparkSession
    watch = Observation()
    path = new_path(spark, label)
    counted = df.observe(
        watch, F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in observed.items()]
    )
    writer = counted.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    got = dict(watch.get)  # without any entry if the planner proved the result empty
    rows = int(got.get("_rows") or 0)
    return Stored(spark.read.schema(df.schema).parquet(path), path, rows, {n: got.get(n) for n in observed})


def small(stored_rows: int, df: DataFrame) -> DataFrame:
    """Broadcast ``df`` when the observed row count proves it small, else leave it to the planner."""
    return F.broadcast(df) if stored_rows <= BROADCAST_ROWS else df
