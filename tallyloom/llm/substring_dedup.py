"""Substring removal by level-wise doubling of repeated word windows.

A window of ``window`` words that occurs twice also repeats every shorter window inside it, so the
search goes up by doubling: quarter windows first, those that repeat are extended to half windows, and
those that repeat again to whole ones. Each level only looks at what the level below left over, and the
search ends at the window length or as soon as nothing survives.

* Quarter level: of each whole window only the quarter window with the least hash is looked at (the
  first of equals). Both copies of a repeated window choose the same one, so a ninth of the places is
  enough and no repeat is lost.
* Half level: a surviving place is extended to the right and to the left; one of the two lies inside
  the whole window.
* Whole level: all windows around a surviving half window, keyed by 128 bits. The least (document,
  start) of each stays, every other occurrence is removed.

A place is told by (content of the document, position), so copies of one document do not count as
repeats at the lower levels; copies are found by the key of their word sequence, and every later copy
goes in full. Keys shared by any number of rows are only ever reduced by minima with map-side
combining or joined in joins whose hot partitions Spark splits. Whole texts cross the network once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import base, words

NOTHING = hashlib.sha256(b"").hexdigest()


def _content(w: words.Words, h: np.ndarray, seed: int) -> np.ndarray:
    """A key of each row's word sequence."""
    place = np.arange(len(h)) - np.repeat(w.row[:-1], w.counts)
    summed = np.zeros(len(h) + 1, words.U)
    np.cumsum(words.mix(h ^ words.mix(place.astype(words.U), seed), seed + 1), out=summed[1:])
    return words.mix(summed[w.row[1:]] - summed[w.row[:-1]] + w.counts.astype(words.U), seed).view(np.int64)


def _texts(w: words.Words) -> list[bytes]:
    whole = w.data.tobytes()
    return [whole[a:b] for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in base.slices(batches, "text"):
        w = words.words(part.column("text"))
        h = w.hashes()
        sha = [hashlib.sha256(b" ".join(x.split())).hexdigest() for x in _texts(w)]
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(_content(w, h, 1)), pa.array(_content(w, h, 2)),
             pa.array(w.counts.astype(np.int64)), pa.array(sha)], ["id", "k", "k2", "n", "sha"])


def _anchors(window: int):
    """Places of the least quarter window of any whole window."""
    quarter = window // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.slices(batches, "text"):
            w = words.words(part.column("text"))
            h = w.hashes()
            k = _content(w, h, 1)
            small = words.windows(h, quarter)
            at, offsets = words.window_rows(w.row, window)
            if not len(at):
                continue
            view = np.lib.stride_tricks.sliding_window_view(small, window - quarter + 1)
            chosen = np.zeros(len(h), bool)
            for a in range(0, len(at), 200_000):
                some = at[a : a + 200_000]
                chosen[some + view[some].argmin(1)] = True
            chosen = np.flatnonzero(chosen)
            owner = np.searchsorted(w.row, chosen, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(owner)), pa.array(k[owner]),
                 pa.array(small[chosen].view(np.int64)), pa.array((chosen - w.row[owner]).astype(np.int32))],
                ["id", "k", "h", "pos"])
    return run


def _places(part: pa.RecordBatch, w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """The listed places of each row: (row, position in the row)."""
    column = part.column("at")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(counts)), counts), flat


def _extended(window: int, whole: bool):
    """Windows of twice the length around the listed ones: (id, k, h, g, pos), each once a row."""
    half, quarter = window // 2, window // 4
    size, shifts = (window, range(-half, 1)) if whole else (half, (0, -quarter))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.slices(batches, "text"):
            w = words.words(part.column("text"))
            row, pos = _places(part, w)
            wanted = np.zeros(len(w.start) + 1, bool)
            for shift in shifts:
                inside = (pos + shift >= 0) & (pos + shift + size <= w.counts[row])
                wanted[(w.row[row] + pos + shift)[inside]] = True
            at = np.flatnonzero(wanted)
            if not len(at):
                continue
            owner = np.searchsorted(w.row, at, "right") - 1
            h = words.windows(w.hashes(), size)[at].view(np.int64)
            g = words.windows(w.hashes(1), size)[at].view(np.int64) if whole else h
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(owner)), part.column("k").take(pa.array(owner)),
                 pa.array(h), pa.array(g), pa.array((at - w.row[owner]).astype(np.int32))],
                ["id", "k", "h", "g", "pos"])
    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.slices(batches, "text"):
            w = words.words(part.column("text"))
            row, pos = _places(part, w)
            cover = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(cover, w.row[row] + pos, 1)
            np.add.at(cover, w.row[row] + pos + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            kept, n = [], []
            for r, text in enumerate(_texts(w)):
                out = gone[w.row[r] : w.row[r + 1]]
                kept.append(b" ".join(x for x, cut in zip(text.split(), out.tolist(), strict=True) if not cut).decode())
                n.append(int(out.sum()))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("k"), pa.array(n, pa.int64()), pa.array(kept, pa.string())],
                ["id", "k", "n_removed", "kept"])
    return run


def remove_repeats(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(<key>, k, n_words, n_removed, kept)``: each row's words left by removing repeated windows.

    A word goes if a window of ``window`` words that covers it has a word sequence that also starts
    earlier: in a row with a smaller key, or earlier in the same one. ``kept`` is the words left, joined
    by one space; it is null where nothing was removed, so unchanged texts need not be carried, and
    empty where all words went. A null or empty text has no words. A null key takes no part: nothing of
    it is removed and it makes nothing else go. Repeated rows come back as often as given and do not
    count as earlier than each other; rows with one key and different texts are told apart by ``k``, a
    key of the words. Other columns are ignored. ``window`` must be a multiple of 4.
    ``unchanged_sha256`` is the digest of all words joined by one space.
    """
    if window % 4:
        raise ValueError("window must be a multiple of 4")
    kind = docs.schema[key]
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def schema(*more: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([T.StructField("id", kind.dataType), T.StructField("k", T.LongType()),
                             *[T.StructField(*m) for m in more]])

    long, whole, string = T.LongType(), T.IntegerType(), T.StringType()
    rows = base.written(slim.mapInArrow(_rows, schema(("k2", long), ("n", long), ("sha", string))))
    known = slim.filter("id is not null")
    classes = base.written(rows.filter(f"id is not null and n >= {window}").groupBy("k", "k2").agg(F.min("id").alias("first")))

    def repeated(found: DataFrame) -> DataFrame:
        """Places whose window occurs at another place too, as one list for each document."""
        at = F.xxhash64("k", "pos")
        twice = (found.groupBy("h").agg(F.min(at).alias("x"), F.max(at).alias("y"))
                 .filter("x <> y").select("h"))
        kept = found.select("h", "id", "k", "pos").join(base.written(twice), "h", "left_semi")
        return base.written(kept.groupBy("id", "k").agg(F.collect_list("pos").alias("at")))

    found = known.mapInArrow(_anchors(window), schema(("h", long), ("pos", whole)))
    lists = repeated(found)
    originals = classes.select(F.col("first").alias("id"), "k")
    lists = base.written(lists.join(originals, ["id", "k"], "left_semi"))
    near = base.written(known.join(lists, "id").select("id", "k", "text", "at")
                        .mapInArrow(_matching, schema(("text", string), ("at", T.ArrayType(whole)))))
    extended = schema(("h", long), ("g", long), ("pos", whole))
    lists = repeated(near.mapInArrow(_extended(window, False), extended))
    near = base.written(near.drop("at").join(lists, ["id", "k"]).select("id", "k", "text", "at"))

    found = near.mapInArrow(_extended(window, True), extended)
    firsts = base.written(found.groupBy("h", "g").agg(
        F.min(F.struct("id", "pos")).alias("first"), F.max(F.struct("id", "pos")).alias("last"))
        .filter("first <> last").select("h", "g", "first"))
    later = found.join(firsts, ["h", "g"]).filter(F.struct("id", "pos") > F.col("first"))
    lists = base.written(later.groupBy("id", "k").agg(F.collect_set("pos").alias("at")))
    cut = base.written(near.drop("at").join(lists, ["id", "k"]).select("id", "k", "text", "at")
                       .mapInArrow(_cut(window), schema(("n_removed", long), ("kept", string)))
                       .dropDuplicates(["id", "k"]))

    marked = base.written(rows.join(classes, ["k", "k2"], "left"))
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    out = marked.withColumn("copy", copy).join(cut, ["id", "k"], "left")
    return out.select(
        F.col("id").alias(key), "k", F.col("n").alias("n_words"),
        F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.col("sha").alias("unchanged_sha256"))


def _matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the content key they were joined for (rows may share an id)."""
    for part in base.slices(batches, "text"):
        w = words.words(part.column("text"))
        same = _content(w, w.hashes(), 1) == part.column("k").to_numpy()
        yield part.filter(pa.array(same))
