"""Token ids in files of static range asymmetric numeral codes.

Layout of a folder: ``table`` (parquet: token, frequency; one table shared by all files, frequencies add
up to ``2**BITS``) and one ``.ans`` file for each run of ``FILE_TOKENS`` ids in document order. A file holds

* a header: magic, format numbers, position of its first id, documents, ids, blocks, table checksum;
* a document index: key, null flag and length of every document that starts in the file;
* a block index, the checkpoints: ids, lanes, words, payload offset and checksum of each block;
* the blocks. Id ``i`` of a block belongs to lane ``i % lanes``. A block starts with its lanes' 64-bit
  states, then the 32-bit words that the lanes take in order of (step, lane).

Every block decodes on its own from its checkpoint, so readers can split a file anywhere; all blocks of
a file run side by side in numpy. A decoder that ends in other states than the encoder began with, or a
checksum that differs, raises.

Tasks write a file under a name of its own and move it to its place, so a repeated task replaces equal
bytes and a lost executor leaves nothing half written under a final name.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import base
from tallyloom.llm.bpe_automaton import read_spec
from tallyloom.llm.word_ids import encoder, id_type

BITS = 20
LOW = np.uint64(1 << 31)
LANES, BLOCK = 1024, 262_144
SMALL_LANES = 32
FILE_TOKENS = 1 << 22
MAGIC = b"LANS0001"
HEAD = "<8sIIQQQQI"  # magic, bits, spare, first, documents, ids, blocks, table checksum
BLOCK_ROW = np.dtype([("ids", "<u4"), ("lanes", "<u4"), ("words", "<u8"), ("offset", "<u8"), ("crc", "<u4")])


class Table:
    """Frequencies of the ids that occur, scaled to ``2**BITS``; each is at least 1."""

    def __init__(self, tokens: np.ndarray, scaled: np.ndarray):
        size = int(tokens.max()) + 1 if len(tokens) else 1
        self.freq, self.cum = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        by = np.argsort(tokens)
        tokens, scaled = tokens[by], scaled[by].astype(np.uint64)
        self.freq[tokens] = scaled
        self.cum[tokens] = np.cumsum(scaled) - scaled
        self.symbol = np.repeat(tokens, scaled.astype(np.int64)).astype(np.uint32)
        self.crc = zlib.crc32(tokens.astype("<u4").tobytes() + scaled.astype("<u4").tobytes())

    @staticmethod
    def scale(counts: np.ndarray) -> np.ndarray:
        """Integer shares of ``2**BITS`` that add up, none of them 0."""
        total = 1 << BITS
        if len(counts) > total:
            raise ValueError("more distinct ids than the table has room for")
        share = np.maximum(1, np.floor(counts / counts.sum() * total).astype(np.int64))
        while (over := int(share.sum()) - total) != 0:
            most = np.argsort(-share, kind="stable")
            if over < 0:
                share[most[0]] -= over
            else:
                take = np.minimum(share[most] - 1, np.maximum(1, share[most] * over // total))
                take = np.minimum(take, np.maximum(0, over - (np.cumsum(take) - take)))
                share[most] -= take
        return share


def _encode_blocks(ids: np.ndarray, table: Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Final states [block, lane] and the word stream of each block, for ids [block, step, lane]."""
    blocks, steps, lanes = ids.shape
    x = np.full((blocks, lanes), LOW)
    low32, spare = np.uint64(2**32 - 1), np.uint64(63 - BITS)
    words, who = [None] * steps, [None] * steps
    for t in range(steps - 1, -1, -1):
        f = table.freq[ids[:, t]]
        full = x >= f << spare
        words[t], who[t] = (x[full] & low32).astype(np.uint32), full.sum(1)
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(BITS)) + (x - q * f) + table.cum[ids[:, t]]
    out = []
    if blocks == 1:
        return x, [np.concatenate(words)]
    cuts = [np.cumsum(n)[:-1] for n in who]
    parts = [np.split(w, c) for w, c in zip(words, cuts, strict=True)]
    for b in range(blocks):
        out.append(np.concatenate([p[b] for p in parts]))
    return x, out


def _decode_blocks(x: np.ndarray, streams: list[np.ndarray], steps: int, table: Table) -> np.ndarray:
    """Ids [block, step, lane] from states and word streams."""
    blocks, lanes = x.shape
    begin = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    flat = np.concatenate([*streams, np.zeros(lanes, np.uint32)]).astype(np.uint64)
    at = begin[:-1].astype(np.int64)
    out = np.empty((blocks, steps, lanes), np.uint32)
    mask = np.uint64((1 << BITS) - 1)
    for t in range(steps):
        slot = x & mask
        out[:, t] = s = table.symbol[slot]
        x = table.freq[s] * (x >> np.uint64(BITS)) + slot - table.cum[s]
        low = x < LOW
        place = np.cumsum(low, 1)
        x = np.where(low, x << np.uint64(32) | flat[np.minimum(at[:, None] + place - 1, len(flat) - 1)], x)
        at = at + place[:, -1]
    if (at != begin[1:]).any() or (x != LOW).any():
        raise ValueError("damaged block: the decoder did not end where the encoder began")
    return out


def pack(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray, first: int, table: Table) -> bytes:
    """The bytes of one file."""
    rows, payload, offset = [], [], 0
    whole = len(ids) // BLOCK
    shapes = [(0, whole, BLOCK, LANES)] if whole else []
    rest = len(ids) - whole * BLOCK
    if rest:
        shapes.append((whole * BLOCK, 1, rest, LANES if rest >= BLOCK // 4 else SMALL_LANES))
    for start, blocks, size, lanes in shapes:
        steps = -(-size // lanes)
        part = ids[start : start + blocks * size]
        part = np.concatenate([part, np.full(blocks * steps * lanes - len(part), part[-1])])
        states, streams = _encode_blocks(part.reshape(blocks, steps, lanes), table)
        for b in range(blocks):
            data = states[b].astype("<u8").tobytes() + streams[b].astype("<u4").tobytes()
            rows.append((size, lanes, len(streams[b]), offset, zlib.crc32(data)))
            payload.append(data)
            offset += len(data)
    null = np.array([k is None for k in keys], np.uint8)
    index = b"".join([
        struct.pack(HEAD, MAGIC, BITS, 0, first, len(keys), len(ids), len(rows), table.crc),
        np.array([k or 0 for k in keys], "<i8").tobytes(), null.tobytes(), lengths.astype("<u4").tobytes(),
        np.array(rows, BLOCK_ROW).tobytes()])
    return b"".join([index, struct.pack("<I", zlib.crc32(index)), *payload])


def unpack(data: bytes, table: Table) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """Position of the first id, keys, lengths and ids of one file; raises if anything is damaged."""
    magic, bits, _, first, docs, n, blocks, crc = struct.unpack_from(HEAD, data)
    if magic != MAGIC or bits != BITS or crc != table.crc:
        raise ValueError("not a file of this format and table")
    at = struct.calcsize(HEAD)
    keys = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    rows = np.frombuffer(data, BLOCK_ROW, blocks, at)
    at += rows.nbytes
    if zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("damaged index")
    at += 4
    out = []
    same = np.flatnonzero(np.diff(rows["ids"].astype(np.int64))) + 1  # whole blocks first, then the last one
    for group in np.split(rows, same):
        if not len(group):
            continue
        states, streams = [], []
        lanes, size = int(group["lanes"][0]), int(group["ids"][0])
        for r in group:
            begin = at + int(r["offset"])
            raw = data[begin : begin + 8 * lanes + 4 * int(r["words"])]
            if zlib.crc32(raw) != r["crc"]:
                raise ValueError("damaged block: checksum")
            states.append(np.frombuffer(raw, "<u8", lanes))
            streams.append(np.frombuffer(raw, "<u4", int(r["words"]), 8 * lanes))
        got = _decode_blocks(np.array(states), streams, -(-size // lanes), table)
        out.append(got.reshape(len(group), -1)[:, :size].ravel())
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    if len(ids) != n:
        raise ValueError("damaged file: ids are missing")
    return first, [None if z else k for k, z in zip(keys.tolist(), null.tolist(), strict=True)], lengths, ids


def _tokenise(spec, end_id: int, kind: str):
    """Rows of one range of keys, in order, to ids with the running position inside the range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(spec.value)
        part, done = TaskContext.get().partitionId(), 0
        for rows in base.slices(batches, "text"):
            ids, offsets = words.encode([x or "" for x in rows.column("text").to_pylist()])
            lengths = np.diff(offsets) + 1
            ids = np.insert(ids, offsets[1:], end_id).astype(kind)
            borders = np.concatenate([[0], np.cumsum(lengths)])
            raw, size = ids.tobytes(), ids.itemsize
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(np.full(len(lengths), part, np.int32)), pa.array(done + borders[:-1]),
                 pa.array(lengths), pa.array([raw[size * a : size * b] for a, b in zip(borders[:-1], borders[1:], strict=True)], pa.binary())],
                ["id", "part", "at", "n", "ids"])
            done += int(borders[-1])
    return run


def _counts(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            data = np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind)
            got = np.bincount(data, minlength=len(total))
            got[: len(total)] += total
            total = got
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["token", "n"])
    return run


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:") or "://" not in path:
        return pyarrow.fs.LocalFileSystem(), os.path.normpath("/" + path.removeprefix("file:").lstrip("/"))
    return pyarrow.fs.FileSystem.from_uri(path)


def _write_file(path: str, shared, kind: str):
    """One file from the rows of a run of ids; a row of the manifest."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("start", "ascending")])
        ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), kind)
        number, first = rows.column("file")[0].as_py(), rows.column("start")[0].as_py()
        data = pack(rows.column("id").to_pylist(), rows.column("n").to_numpy(), ids, first, Table(*shared.value))
        fs, folder = _open(f"{path}/ids")
        fs.create_dir(folder, recursive=True)
        own = f"{folder}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:
            out.write(data)
        fs.move(own, f"{folder}/{number:010d}.ans")
        return pa.table({"file": [number], "first": [first], "documents": [rows.num_rows], "ids": [len(ids)], "bytes": [len(data)]})
    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise ``docs`` and write their ids under ``path`` in ascending order of ``key``.

    Each document's ids end with ``end_id``; a null or empty text is that id alone. A null key comes
    first; rows that share a key are ordered by their texts. Other columns are not written. Returns the
    manifest: ``(file, first, documents, ids, bytes)``; an empty table writes no file. ``path`` must be
    a new folder that all executors reach. A file holds the documents that start in one run of
    ``FILE_TOKENS`` ids, so its size is bounded by that and its last document.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    width = id_type(spec.value)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = base.written(
        slim.repartitionByRange(parts, "id").sortWithinPartitions("id", "text").mapInArrow(
            _tokenise(spec, end_id, width), T.StructType([T.StructField("id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()),
                                                   T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])))
    counts = rows.select("ids").mapInArrow(_counts(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counts.orderBy("token").collect()  # at most the vocabulary
    tokens = np.array([r.token for r in found], np.int64)
    scaled = Table.scale(np.array([r.n for r in found], np.int64)) if found else tokens
    spark.createDataFrame([(int(t), int(f)) for t, f in zip(tokens, scaled, strict=True)], "token int, frequency int") \
        .coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((tokens, scaled))

    # one row for each range: positions of the ranges, from their totals
    sums = rows.groupBy("part").agg(F.sum("n").alias("ids"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before"))
    placed = rows.join(F.broadcast(base.written(sums)), "part").withColumn("start", F.col("before") + F.col("at"))
    placed = placed.withColumn("file", F.floor(F.col("start") / FILE_TOKENS).cast("long"))
    return base.written(placed.select("file", "start", "id", "n", "ids").groupBy("file").applyInArrow(
        _write_file(path, shared, width), "file long, first long, documents long, ids long, bytes long"))


def _read(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            for data in batch.column("content"):
                first, keys, lengths, ids = unpack(data.as_py(), table)
                borders = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(first + borders[:-1]),
                     pa.array([raw[4 * a : 4 * b] for a, b in zip(borders[:-1], borders[1:], strict=True)], pa.binary())],
                    ["doc_id", "start", "ids"])
    return run


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids)`` of all files under ``path``; ids as little-endian 32-bit integers."""
    table = spark.read.parquet(f"{path}/table").orderBy("token").collect()  # at most the vocabulary
    shared = spark.sparkContext.broadcast((np.array([r.token for r in table], np.int64), np.array([r.frequency for r in table], np.int64)))
    schema = "doc_id long, start long, ids binary"
    if not table:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ans").load(f"{path}/ids")
    return files.select("content").mapInArrow(_read(shared), schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(<key>, start, n_tokens, ids_crc32)`` as read back from files written to a new shared folder."""
    path = base.scratch(docs.sparkSession)
    write_ids(docs, path, tokenizer, end_id, key, text)
    return read_ids(docs.sparkSession, path).select(
        F.col("doc_id").alias(key), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
