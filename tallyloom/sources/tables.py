"""Readers and writers: parquet tables, whole-file texts, JSON records, case lines, text output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table. Zone-less timestamps become UTC instants so that epoch arithmetic is defined."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table out over all cores before CPU-heavy work on its rows.

    A table that is read in at least as many splits as there are cores stays as it is, so a shuffle
    is only ever added to inputs of a few hundred megabytes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def key_from_name(name: Column, suffix: str) -> Column:
    """File stem: the last path segment without ``suffix``."""
    last = F.substring_index(name, "/", -1)
    stem = F.substring(last, F.lit(1), F.length(last) - F.lit(len(suffix)))
    return F.when(last.endswith(suffix), stem).otherwise(last)


def read_texts(
    spark: SparkSession, path: str, suffix: str = ".txt", skip_suffix: str | None = None
) -> DataFrame:
    """``(key, text)``: one row per file ending in ``suffix``, leaving out ``skip_suffix`` files."""
    files = (
        spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    )
    if skip_suffix:
        files = files.filter(~F.col("name").endswith(skip_suffix))
    return files.select(key_from_name(F.col("name"), suffix).alias("key"), "text")


def read_records(spark: SparkSession, path: str, schema: T.StructType, suffix: str = ".json") -> DataFrame:
    """One JSON object per file; unreadable files are skipped. ``key`` is the stem of the file name."""
    corrupt = "_corrupt"
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    records = (
        spark.read.schema(wide)
        .option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", corrupt).option("pathGlobFilter", f"*{suffix}")
        .json(path)
        .select("*", F.col("_metadata.file_name").alias("_name"))
    )
    return (
        records.filter(F.col(corrupt).isNull())
        .withColumn("key", key_from_name(F.col("_name"), suffix))
        .drop(corrupt, "_name")
    )


def parse_cases(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines ``[input, expected]`` as VARIANT columns ``args`` (always an array) and ``expected``.

    A scalar input counts as a one-element argument list; blank and malformed lines are dropped.
    """
    pair = lines.withColumn("_case", F.try_parse_json(column)).filter(F.col("_case").isNotNull())
    given = F.variant_get("_case", "$[0]", "variant")
    wrapped = F.parse_json(F.concat(F.lit("["), F.to_json(given), F.lit("]")))
    return pair.withColumns({
        "args": F.when(F.schema_of_variant(given).startswith("ARRAY"), given).otherwise(wrapped),
        "expected": F.variant_get("_case", "$[1]", "variant"),
    }).drop("_case")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return parse_cases(spark.read.text(path))


def write_records(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """JSON lines, replacing the target; files follow Spark's partitions and not the record keys."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_texts(df: DataFrame, column: str, path: str) -> None:
    """One text column as text files, replacing the target."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
