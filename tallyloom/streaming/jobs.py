"""Structured Streaming counterparts of the batch operators.

Every job reads files, keeps its progress in a checkpoint folder and runs with
``trigger(availableNow=True)`` or any other trigger the caller passes. Jobs with a state for each key
keep it in the engine's keyed state, which is versioned with the progress, so a repeated batch changes nothing.
The keys are dealt over ``GROUPS`` by hash, and a group's keys are worked on together in numpy: a micro-batch costs at most so
many calls, however many keys it has. A group's state is one table of all its keys as bytes. The rows of one group in
one micro-batch are handled together: bound them with ``maxFilesPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState

from tallyloom.sources.store import new_path

AVAILABLE_NOW = {"availableNow": True}
GROUPS = 1024
"""Groups that the keys of a job with state are dealt over; a progress folder is bound to it."""
WINDOWS = 100_000
"""Closed windows that are handed on at once."""


def read_files(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None,
               **options: str) -> DataFrame:
    """Stream of one parquet table: the file or folder ``name`` under ``folder``, new files included."""
    folder = folder.rstrip("/")
    schema = schema or spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    stream = reader.parquet(f"{folder}/{{{name}}}")  # as a pattern, since a plain path must be a folder
    naive = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else stream


def append_files(stream: DataFrame, out: str, progress: str, trigger: dict | None = None) -> None:
    """Append the stream's rows to parquet files under ``out``, each input exactly once."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", progress)
        .trigger(**(trigger or AVAILABLE_NOW)).start()
    )
    query.awaitTermination()


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream over what is there now and return the rows it wrote."""
    spark = stream.sparkSession
    out = new_path(spark, label)
    append_files(stream, out, new_path(spark, f"{label}-progress"))
    return spark.read.schema(stream.schema).parquet(out)


def distinct_events(stream: DataFrame, at: str, unique: list[str], lateness: str) -> DataFrame:
    """First occurrence of each id within the watermark."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(unique)


def _plain(df: DataFrame, column: str) -> Column:
    """A column as a number that Python compares like the engine: instants in microseconds."""
    return F.unix_micros(column) if isinstance(df.schema[column].dataType, T.TimestampType) else F.col(column)


def _typed(df: DataFrame, column: str, value: Column) -> Column:
    """The inverse of ``_plain``."""
    return F.timestamp_micros(value) if isinstance(df.schema[column].dataType, T.TimestampType) else value


def _grouped(stream: DataFrame, key: str, columns: list[str], **more: Column) -> DataFrame:
    """``(_group, _key, _v0, _some0, _v1, ...)``: the key as text, so that it is exact beside nulls, and values without nulls.

    A frame then never turns integers into floats; a flag says where a null was, and sorts first.
    """
    plain = [_plain(stream, c) for c in columns]
    kinds = [T.LongType() if isinstance(k, T.TimestampType) else k for k in (stream.schema[c].dataType for c in columns)]
    none = [F.lit({T.StringType: "", T.DateType: "1970-01-01"}.get(type(k), "0")).cast(k) for k in kinds]
    values = [x for i, (v, n) in enumerate(zip(plain, none, strict=True))
              for x in (F.coalesce(v, n).alias(f"_v{i}"), v.isNotNull().alias(f"_some{i}"))]
    return stream.select(F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("_group"), F.col(key).cast("string").alias("_key"),
                         *values, *[c.alias(n) for n, c in more.items()])


def _ordered(frame: pd.DataFrame, size: int) -> pd.DataFrame:
    """Rows by key, then by the first ``size`` values, nulls first; ``_code`` numbers the keys."""
    frame = frame.assign(_code=pd.factorize(frame["_key"], use_na_sentinel=False)[0])
    by = [c for i in range(size) for c in (f"_some{i}", f"_v{i}")]
    return frame.sort_values(["_code", *by], kind="stable").reset_index(drop=True)


def _bytes(frame: pd.DataFrame, schema: pa.Schema) -> bytes:
    table = pa.Table.from_pandas(frame, schema, preserve_index=False).replace_schema_metadata(None)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def sliding_rate(stream: DataFrame, at: str, key: str, width: str, slide: str, lateness: str,
                 limit: int) -> DataFrame:
    """Rows per key in sliding windows; a window is final once the watermark has passed its end.

    The state holds counts of a key in the smallest steps that windows begin and end at, once and not once per window that
    covers them; windows are summed when they close. A late row counts where its windows are still open.
    NULL keys are one key; a NULL time is in no window.
    """
    wide, step, late = (pd.Timedelta(x).value // 1000 for x in (width, slide, lateness))
    grain = gcd(wide, step)
    # a row's last window ends by then: the watermark is that of ``at``, and no row goes that an open window covers
    last = F.timestamp_micros(F.unix_micros(at) + wide)
    timed = stream.filter(F.col(at).isNotNull()).withColumn("_last", last).withWatermark("_last", f"{(late + wide) // 1000} milliseconds")
    micros = F.unix_micros(at)
    rows = timed.select(F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("_group"), F.col(key).cast("string").alias("_key"),
                        (micros - F.pmod(micros, F.lit(grain))).alias("_at"), "_last")
    out_schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_start", T.LongType()), T.StructField("n", T.LongType())])
    kept = pa.schema([("_key", pa.string()), ("_at", pa.int64()), ("n", pa.int64())])

    def follow(_, frames, state: GroupState):
        seen = [f[["_key", "_at"]].assign(n=1) for f in frames if len(f)]
        done, now = 0, state.getCurrentWatermarkMs() * 1000
        if state.exists:
            seen.append(_table(bytes(state.get[0])).to_pandas())
            done = state.get[1]
        all_ = pd.concat(seen) if seen else pd.DataFrame({"_key": [], "_at": [], "n": []}).astype({"_key": object, "_at": "int64", "n": "int64"})
        number, names = pd.factorize(all_["_key"], use_na_sentinel=False)
        code, when, n = _summed(number, all_["_at"].to_numpy(np.int64), all_["n"].to_numpy(np.int64))
        first = when - when % step
        open_ = first + wide > now
        state.update((_bytes(pd.DataFrame({"_key": names[code[open_]], "_at": when[open_], "n": n[open_]}), kept), now))
        state.setTimeoutTimestamp(now // 1000 + 1)
        parts = []
        for back in range(-(-wide // step)):
            start = first - back * step
            closed = (start + wide > np.maximum(when, done)) & (start + wide <= now)
            parts.append((code[closed], start[closed], n[closed]))
        code, start, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for i in range(0, len(n), WINDOWS):
            yield pd.DataFrame({"_key": names[code[i : i + WINDOWS]], "_start": start[i : i + WINDOWS], "n": n[i : i + WINDOWS]})

    closed = rows.groupBy("_group").applyInPandasWithState(follow, out_schema, "held binary, done long", "append", "EventTimeTimeout")
    return closed.select(
        F.col("_key").cast(stream.schema[key].dataType).alias(key), F.timestamp_micros("_start").alias("window_start"),
        F.timestamp_micros(F.col("_start") + wide).alias("window_end"), "n", (F.col("n") >= limit).alias("limited"),
    )


def _summed(code: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``n`` for each pair of code and time."""
    by = np.lexsort((at, code))
    code, at, n = code[by], at[by], n[by]
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (at[1:] != at[:-1])])[: len(code)])
    return code[first], at[first], np.add.reduceat(n, first) if len(first) else n


def stream_levels(stream: DataFrame, key: str, at: str, unique: str, delta: Column, folder: str,
                  trigger: dict | None = None) -> str:
    """``clamped_level`` over a stream: ``(key, at, unique, level, late)`` in the returned output folder.

    A row that lies before the last row of its key in an earlier batch is late: it comes out with a NULL
    level and changes nothing. A NULL step adds nothing; NULL keys are one group; a NULL time is before all others.
    """
    rows = _grouped(stream, key, [at, unique], _step=F.coalesce(delta.cast("bigint"), F.lit(0)))
    values = [f for f in rows.schema.fields if f.name not in ("_group", "_step")]
    out_schema = T.StructType([*values, T.StructField("level", T.LongType()), T.StructField("late", T.BooleanType())])
    names = [f.name for f in values]
    kept = to_arrow_schema(T.StructType([*values, T.StructField("_level", T.LongType())]))

    def follow(_, frames, state: GroupState):
        batch = pd.concat(list(frames))[[*names, "_step"]]
        batch["_old"], batch["_level"] = False, 0
        if state.exists:
            last = _table(bytes(state.get[0])).to_pandas().assign(_old=True, _step=0)
            batch = pd.concat([last, batch])  # before equal rows, as the sort is stable
        batch = _ordered(batch, 2)
        code, old = batch["_code"].to_numpy(), batch["_old"].to_numpy(bool)
        # what sorts before or with a key's last row is late; keys without a last row have none
        place = np.arange(len(batch))
        upto = np.full(int(code.max()) + 1, -1)
        upto[code[old]] = place[old]
        late = place < upto[code]
        if old.any():  # rows that equal the last one sort behind it
            mark = upto[code]
            same = (mark >= 0) & (place > mark)
            for c in ("_some0", "_v0", "_some1", "_v1"):
                values_ = batch[c].to_numpy()
                same &= values_ == values_[np.maximum(mark, 0)]
            late |= same
        live = ~late
        step = np.where(old, batch["_level"], batch["_step"])[live].astype(np.int64)  # a key starts from the level it had
        level = np.zeros(len(batch), np.int64)
        level[live] = _clamped(code[live], step)
        end = batch.assign(_level=level)[live].drop_duplicates("_code", keep="last")
        state.update((_bytes(end[[*names, "_level"]], kept),))
        new = ~old
        out = batch.loc[new, names].reset_index(drop=True)
        out["level"] = pd.array(level[new], "Int64")
        out.loc[late[new], "level"] = pd.NA
        out["late"] = late[new]
        yield out

    leveled = rows.groupBy("_group").applyInPandasWithState(follow, out_schema, "last binary", "append", "NoTimeout")
    out = f"{folder}/out"
    fields = [F.when(F.col(f"_some{i}"), _typed(stream, c, F.col(f"_v{i}"))).alias(c) for i, c in enumerate((at, unique))]
    append_files(leveled.select(F.col("_key").cast(stream.schema[key].dataType).alias(key), *fields, "level", "late"), out, f"{folder}/progress", trigger)
    return out


def _clamped(code: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Running sums that never fall below 0, anew for each run of equal codes."""
    first = np.concatenate([[True], code[1:] != code[:-1]])[: len(code)]
    total = np.cumsum(step)
    run = np.cumsum(first) - 1
    total = total - (total - step)[first][run] if len(code) else total
    lowest = pd.Series(total).groupby(run).cummin().to_numpy()
    return total - np.minimum(0, lowest)


def stream_reorder(stream: DataFrame, key: str, order: list[str], k: int, folder: str,
                   flush: bool = True, trigger: dict | None = None) -> DataFrame:
    """Bounded reorder: per key the k largest rows seen are held back, the others are released in order.

    If no row arrives more than k places late, the released sequence is sorted. Gives the rows written so
    far, ``(key, seq, order...)``; with ``flush`` what the state still holds follows them. ``order`` must end
    in a unique column and hold numbers, instants or strings; NULL sorts first. NULL keys are one group.
    """
    spark = stream.sparkSession
    rows = _grouped(stream, key, order)
    values = [f for f in rows.schema.fields if f.name != "_group"]
    out_schema = T.StructType([*values, T.StructField("seq", T.LongType())])
    names = [f.name for f in values]
    kept = to_arrow_schema(out_schema)
    counts = pa.schema([("_key", pa.string()), ("done", pa.int64())])

    def release(_, frames, state: GroupState):
        seen = [f[names] for f in frames]
        done = None
        if state.exists:
            seen.insert(0, _table(bytes(state.get[0])).to_pandas()[names])
            done = _table(bytes(state.get[1])).to_pandas()
        rows = _ordered(pd.concat(seen), len(order))
        code = rows["_code"].to_numpy()
        count = np.bincount(code)
        place = np.arange(len(code)) - (np.cumsum(count) - count)[code]
        keys = rows.drop_duplicates("_code")[["_key", "_code"]]
        if done is None:
            before = np.zeros(len(count), np.int64)
        else:  # a key may have no row here when nothing is held back
            known = pd.concat([keys, done[["_key"]]])["_key"]
            number = pd.factorize(known, use_na_sentinel=False)[0]
            before = np.zeros(int(number.max()) + 1, np.int64)
            before[number[len(keys) :]] = done["done"].to_numpy()
        free = place < count[code] - k
        rows["seq"] = before[code] + place + 1
        freed = np.bincount(code[free], minlength=len(count))
        after = pd.DataFrame({"_key": keys["_key"].to_numpy(), "done": before[: len(count)] + freed})
        if done is not None:
            rest = done[number[len(keys) :] >= len(keys)]
            after = pd.concat([after, rest])
        state.update((_bytes(rows.loc[~free, [*names, "seq"]], kept), _bytes(after, counts)))
        yield rows.loc[free, [*names, "seq"]]

    def typed(df: DataFrame) -> DataFrame:
        fields = [F.when(F.col(f"_some{i}"), _typed(stream, c, F.col(f"_v{i}"))).alias(c) for i, c in enumerate(order)]
        return df.select(F.col("_key").cast(stream.schema[key].dataType).alias(key), "seq", *fields)

    released = rows.groupBy("_group").applyInPandasWithState(release, out_schema, "held binary, done binary", "append", "NoTimeout")
    out, progress = f"{folder}/out", f"{folder}/progress"
    append_files(typed(released), out, progress, trigger)
    schema = T.StructType([stream.schema[key], T.StructField("seq", T.LongType()), *[stream.schema[c] for c in order]])
    done = spark.read.schema(schema).parquet(out)
    if not flush:
        return done
    state = spark.read.format("statestore").load(progress).select(F.col("value.groupState.held").alias("held"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("held").to_pylist():
                yield from _table(data).to_batches()

    return done.unionByName(typed(state.mapInArrow(held, out_schema)))
