"""Packing of documents into token windows, filled with what a BM25 index finds near the first document.

1. Every text is encoded where it stands; only ids move from here on. Term statistics (a term is a token id,
   so there are as many as the vocabulary has) are counted over all documents.
2. Documents are sorted by their two heaviest terms and dealt out by range, so that documents about one thing
   stand next to each other and a group of copies, however large, is cut by a hash of its rows. A task reads its range
   in order and closes a shard of the index whenever it has ``SHARD_TOKENS`` ids; memory is bounded by that and by the
   longest document.
3. In a shard, the first unused document is the seed of a window. Its distinct terms query the shard's inverted
   index; unused documents follow by their score (without a common term: in order of the shard) until the window is
   full. The document that does not fit is cut, and what is left of it is the next seed. A document of a
   whole window or more gives its windows by itself, and only what is left of it is indexed.
4. What a shard cannot fill a window with goes to the next shard of the task. At a task's end it
   is cut into lengths that are powers of two, which are not padded.

So each id is in one piece and there is no padding at all. A repeated task gets the same rows in the same order and
returns the same pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import base
from tallyloom.llm.bpe_automaton import read_spec
from tallyloom.llm.word_ids import encoder, id_type

WINDOW = 4096
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75
COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _encode(spec, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(spec.value)
        for rows in base.slices(batches, "text"):
            ids, offsets = words.encode([x or "" for x in rows.column("text").to_pylist()])
            ids = np.insert(ids, offsets[1:], end_id).astype(kind)
            ends = offsets + np.arange(len(offsets))
            raw, size = ids.tobytes(), ids.itemsize
            yield pa.RecordBatch.from_arrays(
                [rows.column("key"), pa.array(np.diff(ends)),
                 pa.array([raw[size * a : size * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["key", "n", "ids"])
    return run


def terms_of(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, term, count)`` of some documents, by row and term."""
    row = np.repeat(np.arange(len(ids), dtype=np.uint64), [len(x) for x in ids])
    flat = np.concatenate([*ids, np.zeros(0, ids[0].dtype if ids else np.uint16)])
    small = flat.dtype.itemsize == 2 and len(ids) <= 1 << 16
    kind, bits = (np.uint32, 16) if small else (np.uint64, 32)  # narrow keys sort fastest
    key = np.sort(row.astype(kind) << kind(bits) | flat.astype(kind))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    found = key[first]
    return (found >> kind(bits)).astype(np.int64), (found & kind((1 << bits) - 1)).astype(np.int64), np.diff(np.append(first, len(key)))


GROUP_TOKENS = 1 << 20


def groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``GROUP_TOKENS`` ids, one row at least."""
    group = np.cumsum(batch.column("n").to_numpy()) // GROUP_TOKENS
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, int(np.searchsorted(group, group[at], "right")) - at)
        at += part.num_rows
        yield part


def arrays(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _frequencies(kind: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for part in groups(batch):
                df += np.bincount(terms_of(arrays(part.column("ids"), kind))[1], minlength=vocabulary)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df[found])], ["term", "df"])
    return run


def heaviest(ids: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """The two terms of each document that weigh most, as one number; ties go to the smaller term."""
    out = np.zeros(len(ids), np.int64)
    row, term, count = terms_of(ids)
    if not len(row):
        return out
    weight = idf[term] * count * (K1 + 1) / (count + K1)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    for shift in (32, 0):
        most = np.maximum.reduceat(weight, first)
        at = np.flatnonzero(weight == np.repeat(most, np.diff(np.append(first, len(row)))))
        at = at[np.concatenate([[True], row[at][1:] != row[at][:-1]])]
        out[row[at]] |= np.where(weight[at] >= 0, term[at] + 1, 0) << shift
        weight[at] = -1.0
    return out


def _routes(kind: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, _ = shared.value
        for batch in batches:
            for part in groups(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(heaviest(arrays(part.column("ids"), kind), idf))], ["key", "n", "ids", "route"])
    return run


class Shard:
    """A BM25 index of some pieces, and which of them are unused."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        self.idf, self.unused = idf, np.ones(len(ids), bool)
        row, term, count = terms_of(ids)
        size = np.array([len(x) for x in ids], np.float64)
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size[row] / mean))
        by = np.argsort(term, kind="stable")
        self.row, self.weight = row[by], weight[by]
        self.begin = np.searchsorted(term[by], np.arange(len(idf) + 1))

    def near(self, query: np.ndarray) -> Iterator[int]:
        """Unused pieces by their score for the query's distinct terms; those without a term in common last, in order."""
        terms = np.unique(query)
        terms = terms[self.begin[terms + 1] > self.begin[terms]]
        counts = self.begin[terms + 1] - self.begin[terms]
        ends = np.cumsum(counts)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(self.begin[terms], counts)
        score = np.bincount(self.row[at], self.weight[at], len(self.unused))
        left = np.flatnonzero(self.unused)
        size = min(64, len(left))
        while True:  # mostly a few pieces fill the window
            some = left[np.argpartition(-score[left], size - 1)[:size]] if size < len(left) else left
            least = score[some].min() if size < len(left) else -1.0
            some = left[score[left] >= least]
            some = some[np.argsort(-score[some], kind="stable")]
            yield from (int(x) for x in some if self.unused[x])
            if size >= len(left):
                return
            left = left[score[left] < least]
            if not len(left):
                return
            size = min(8 * size, len(left))


class Packer:
    """Pieces into windows; ``out`` has a row for each: item, start, length, sequence, offset."""

    def __init__(self, window: int):
        self.window, self.out, self.sequence, self.filled = window, [], 0, 0

    def put(self, item: int, start: int, length: int) -> int:
        """As much as fits into the open window; what is left over."""
        some = min(length, self.window - self.filled)
        if some:
            self.out.append((item, start, some, self.sequence, self.filled))
            self.filled += some
        if self.filled == self.window:
            self.sequence, self.filled = self.sequence + 1, 0
        return length - some

    def finish(self, pieces: list[tuple[int, int, int]]) -> None:
        """The last pieces, of less than a window together, in sequences that are powers of two long."""
        total = sum(n for _, _, n in pieces)
        lengths = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        at = 0
        for item, start, n in pieces:
            while n:
                some = min(n, lengths[0] - at)
                self.out.append((item, start, some, self.sequence, at))
                start, n, at = start + some, n - some, at + some
                if at == lengths[0]:
                    lengths.pop(0)
                    self.sequence, at = self.sequence + 1, 0


Piece = tuple[int, int, int]  # document, start, length


def pack_shard(packer: Packer, ids: list[np.ndarray], begun: list[Piece], idf: np.ndarray, mean: float) -> list[Piece]:
    """Fill windows from documents of which all but those ``begun`` are new; what does not fill a window.

    ``begun`` and what is returned are shorter than a window together.
    """
    fresh = {item for item, *_ in begun}
    rest: list[tuple[int, int]] = []  # start and length of what is indexed of each document
    for item, x in enumerate(ids):
        whole = 0 if item in fresh else len(x) // packer.window * packer.window
        for start in range(0, whole, packer.window):
            packer.put(item, start, packer.window)
        rest.append((whole, 0 if item in fresh else len(x) - whole))
    shard = Shard([x[a : a + n] for x, (a, n) in zip(ids, rest, strict=True)], idf, mean)
    shard.unused &= np.array([n > 0 for _, n in rest], bool)
    left = sum(n for _, n in rest) + sum(n for _, _, n in begun)
    order, at, seeds = np.flatnonzero(shard.unused), 0, list(begun)
    while left >= packer.window:
        if not seeds:
            while not shard.unused[order[at]]:
                at += 1
            seeds = [(int(order[at]), *rest[order[at]])]
            shard.unused[order[at]] = False
        item, start, n = seeds[0]
        for piece in seeds:
            packer.put(*piece)
        seeds = []
        for other in shard.near(ids[item][start : start + n]):
            shard.unused[other] = False
            begin, size = rest[other]
            over = packer.put(other, begin, size)
            if not packer.filled:
                seeds = [(other, begin + size - over, over)] if over else []
                break
        left -= packer.window
    return seeds + [(int(i), *rest[i]) for i in np.flatnonzero(shard.unused)]


def _pack(kind: str, window: int, shard_tokens: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window)
        packer.sequence = TaskContext.get().partitionId() << 40
        docs: list[tuple] = []  # key and ids of the documents of the open shard
        begun: list[Piece] = []
        size, key_type = 0, None

        def close(last: bool) -> pa.RecordBatch:
            nonlocal docs, begun, size
            left = pack_shard(packer, [x for _, x in docs], begun, *shared.value)
            if last:
                packer.finish(left)
                left = []
            found = [(a, n, zlib.crc32(docs[i][1][a : a + n].astype("<u4").tobytes()), len(docs[i][1]), s, o) for i, a, n, s, o in packer.out]
            values = zip(*found, strict=True) if found else [[]] * len(COLUMNS)
            out = pa.RecordBatch.from_arrays(
                [pa.array([docs[i][0] for i, *_ in packer.out], key_type), *(pa.array(list(x), pa.int64()) for x in values)], ["key", *COLUMNS])
            docs, begun = [docs[i] for i, *_ in left], [(k, a, n) for k, (_, a, n) in enumerate(left)]
            packer.out, size = [], 0
            return out

        for batch in batches:
            key_type = batch.schema.field("key").type
            for key, ids in zip(batch.column("key").to_pylist(), arrays(batch.column("ids"), kind), strict=True):
                docs.append((key, ids.copy()))
                size += len(ids)
                if size >= shard_tokens:
                    yield close(False)
        if docs:
            yield close(True)
    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
         window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``(<key>, start, length, ids_crc32, doc_tokens, sequence_id, offset)``: a row for each piece of a document.

    A document's ids end with ``end_id``; a null or empty text is that id alone. ``start`` counts the document's
    ids before the piece, ``offset`` those of the sequence before it. Sequences are ``window`` ids long, a power
    of two, but for those of a task's last ids, which are smaller powers of two. Rows that share a key, or have
    none, are documents of their own. Other columns are not read. An empty table gives no rows.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    kind, vocabulary = id_type(spec.value), 1 << 16
    key_type = docs.schema[key].dataType
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", key_type), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    pieces = T.StructType([T.StructField("key", key_type), *(T.StructField(c, T.LongType()) for c in COLUMNS)])
    rows = base.written(slim.mapInArrow(_encode(spec, end_id, kind), schema))
    total, tokens = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not total:
        return spark.createDataFrame([], pieces).withColumnRenamed("key", key)
    if kind != "<u2":
        vocabulary = 1 + max(r[0] for r in rows.select("ids").mapInArrow(_largest(kind), "id long").groupBy().max("id").collect())
    found = rows.select("n", "ids").mapInArrow(_frequencies(kind, vocabulary), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    got = found.toArrow()  # at most the vocabulary
    df = np.zeros(vocabulary)
    df[got.column("term").to_numpy()] = got.column("df").to_numpy()
    shared = spark.sparkContext.broadcast((np.log1p((total - df + 0.5) / (df + 0.5)), tokens / total))
    routed = rows.mapInArrow(_routes(kind, shared), T.StructType([*schema, T.StructField("route", T.LongType())]))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # equal routes are dealt out by a hash, so that range bounds, which pass the driver, are two numbers each
    placed = routed.withColumn("spread", F.xxhash64("key", "ids"))
    placed = placed.repartitionByRange(parts, "route", "spread").sortWithinPartitions("route", "spread", "key", "ids")
    out = placed.select("key", "ids").mapInArrow(
        _pack(kind, window, shard_tokens, shared), pieces)
    return out.withColumnRenamed("key", key)


def _largest(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = [int(x.max()) for batch in batches for x in arrays(batch.column("ids"), kind)]
        yield pa.RecordBatch.from_arrays([pa.array([max(most, default=0)], pa.int64())], ["id"])
    return run
