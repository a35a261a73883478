"""One file per key: a Spark data source ``keyed_files`` that writes and reads folders of small files.

Writing: every task writes its rows' files into the run's own folder, each under a name of the attempt's own first
and then moved to its place, so a repeated task replaces equal bytes. Nothing is visible before the commit, which
writes one small file, ``_current``, that names the run; an overwrite drops the runs before it afterwards, an aborted
run leaves ``_current`` as it was. Tasks hand the driver two numbers each.

Reading: the files named by ``_current``, or, in a folder written by anything else, all files that are not hidden, are
packed into input partitions of bounded bytes and files. Names are pruned by prefix and suffix before that. A
file that cannot be read is a row with a ``problem`` and no text.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pf
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import CaseInsensitiveDict, DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "keyed_files"
SCHEMA = "key string, name string, bytes bigint, text string, problem string"
FOLDERS = 256
PART_BYTES, PART_FILES, BATCH_BYTES = 64 << 20, 10_000, 4 << 20
NO_KEY = "%"
"""The file name of a null key; no quoted key is that."""
CURRENT = "_current"


def open_path(path: str) -> tuple[pf.FileSystem, str]:
    if path.startswith("file:") or "://" not in path:
        return pf.LocalFileSystem(), os.path.normpath("/" + path.removeprefix("file:").lstrip("/"))
    return pf.FileSystem.from_uri(path)


def file_name(key: str | None, suffix: str) -> str:
    name = (NO_KEY if key is None else quote(key, safe=" ")) + suffix
    if not key and key is not None or len(name) > 240:
        raise ValueError(f"a key of {len(key or '')} characters gives no file name")
    return name


def key_of(name: str, suffix: str) -> str | None:
    stem = name.removesuffix(suffix)
    return None if stem == NO_KEY else unquote(stem)


def _replace(fs: pf.FileSystem, path: str, data: bytes) -> None:
    own = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, path)


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class KeyedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.suffix, self.overwrite, self.run = options["path"], options.get("suffix", ""), overwrite, f"run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_path(self.path)
        made, files, size = set(), 0, 0
        for batch in iterator:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                name = file_name(key, self.suffix)
                folder = f"{root}/{self.run}/{zlib.crc32(name.encode()) % FOLDERS:02x}"
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                data = (text or "").encode()
                _replace(fs, f"{folder}/{name}", data)
                files, size = files + 1, size + len(data)
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = open_path(self.path)
        fs.create_dir(root, recursive=True)
        before = current(fs, root) or {"runs": [], "files": 0, "bytes": 0}
        done = [m for m in messages if m is not None]
        state = {"runs": [self.run], "files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}
        if not self.overwrite:
            state = {"runs": before["runs"] + state["runs"], **{k: before[k] + state[k] for k in ("files", "bytes")}}
        _replace(fs, f"{root}/{CURRENT}", json.dumps(state).encode())
        for run in before["runs"] if self.overwrite else []:
            if fs.get_file_info(f"{root}/{run}").type == pf.FileType.Directory:
                fs.delete_dir(f"{root}/{run}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_path(self.path)
        if fs.get_file_info(f"{root}/{self.run}").type == pf.FileType.Directory:
            fs.delete_dir(f"{root}/{self.run}")


def current(fs: pf.FileSystem, root: str) -> dict | None:
    """What the last commit wrote: runs, files and bytes; None in a folder of another origin."""
    if fs.get_file_info(f"{root}/{CURRENT}").type != pf.FileType.File:
        return None
    with fs.open_input_stream(f"{root}/{CURRENT}") as f:
        return json.loads(f.read())


@dataclass
class Files(InputPartition):
    names: list[str]


class KeyedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = CaseInsensitiveDict(options)
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.prefix, self.skip = options.get("prefix", ""), options.get("skipSuffix") or None
        self.most = int(options.get("partitionBytes", PART_BYTES)), int(options.get("partitionFiles", PART_FILES))

    def wanted(self, name: str) -> bool:
        return (not name.startswith((".", "_")) and name.endswith(self.suffix) and name.startswith(quote(self.prefix, safe=" "))
                and not (self.skip and name.endswith(self.skip)))

    def partitions(self) -> list[Files]:
        fs, root = open_path(self.path)
        state = current(fs, root)
        found = []
        for top in [f"{root}/{run}" for run in state["runs"]] if state else [root]:
            there = fs.get_file_info(pf.FileSelector(top, recursive=True, allow_not_found=state is not None))
            found += [(f.path, f.size or 0) for f in there if f.type == pf.FileType.File and self.wanted(f.base_name)]
        parts, names, size = [], [], 0
        for path, n in sorted(found):
            if names and (size + n > self.most[0] or len(names) >= self.most[1]):
                parts.append(Files(names))
                names, size = [], 0
            names.append(path)
            size += n
        return [*parts, Files(names)] if names else parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = open_path(self.path)
        rows: list[tuple] = []
        size = 0
        for path in partition.names:
            name = os.path.basename(path)
            try:
                with fs.open_input_stream(path) as f:
                    data = f.read()
                row = (key_of(name, self.suffix), name, len(data), data.decode(errors="replace"), None)
            except OSError as problem:
                row = (key_of(name, self.suffix), name, None, None, type(problem).__name__)
            rows.append(row)
            size += row[2] or 0
            if size >= BATCH_BYTES:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          ["key", "name", "bytes", "text", "problem"])


class KeyedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> KeyedReader:
        return KeyedReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> KeyedWriter:
        if schema.fieldNames() != ["key", "text"]:
            raise ValueError("the columns must be key and text")
        return KeyedWriter(dict(self.options), overwrite)


def write_files(df: DataFrame, path: str, key: Column, text: Column, suffix: str = "", append: bool = False) -> None:
    """``text`` of every row as a file named after its ``key``; a null text is an empty file, a null key has a name of its own.

    Of rows that share a key the greatest text stands, as keys name files. An empty key, or one whose name would be longer
    than 240 characters, raises. What was at ``path`` is replaced unless ``append``; on a failure it stays as it was.
    """
    df.sparkSession.dataSource.register(KeyedFiles)
    rows = df.select(key.cast("string").alias("key"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    one = rows.groupBy("key").agg(F.max("text").alias("text"))
    one.write.format(FORMAT).mode("append" if append else "overwrite").option("suffix", suffix).save(path)


def read_files(spark: SparkSession, path: str, suffix: str = "", skip_suffix: str | None = None, prefix: str = "", **options: int) -> DataFrame:
    """``(key, name, bytes, text, problem)`` of every file; only names that start and end as given are opened."""
    spark.dataSource.register(KeyedFiles)
    reader = spark.read.format(FORMAT).option("suffix", suffix).option("prefix", prefix)
    if skip_suffix:
        reader = reader.option("skipSuffix", skip_suffix)
    return reader.options(**{k: str(v) for k, v in options.items()}).load(path)


def write_records(df: DataFrame, path: str, key: Column, suffix: str = ".json", append: bool = False) -> None:
    """Each row as one JSON object in a file of its own, nulls written out."""
    write_files(df, path, key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), suffix, append)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, suffix: str = ".json", **options: int) -> DataFrame:
    """``(key, record, bad)``: one row a file; a file that is unreadable or no JSON object of that schema has a null record
    and is ``bad``, so that it can be counted and looked at instead of being lost."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("text", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "multiLine": "true"})
    rows = read_files(spark, path, suffix, **options).select("key", "text", "problem", parsed.alias("all"))
    bad = F.col("problem").isNotNull() | F.col("all").isNull() | F.col("all._bad").isNotNull() | ~F.ltrim("text").startswith("{")
    own = F.struct(*[F.col(f"all.{f.name}").alias(f.name) for f in kind.fields])
    return rows.select("key", F.when(~bad, own).alias("record"), bad.alias("bad"))
