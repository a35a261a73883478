"""Hard negatives by exact integer scores, from float32 matrix products in a residue number system.

A vector's components become integers. For each of several small primes the matrices of two tiles are reduced
to the prime's balanced residues and multiplied in float32, which is exact as no sum reaches 2**24. Chinese
remaindering (Garner's mixed radix digits, each again a small float32 number) gives the exact signed score:
the product of the primes is more than twice the largest squared length, which bounds every score. How many primes
that takes follows from the data.

Anchors and rows are dealt into chunks of bounded size, and each pair of chunks meets once, in a co-group: first for
the best rows of an anchor's own label (only tiles of one label are multiplied), then, with the scores of
those, for the best rows of other labels whose score lies in each positive's window. Every chunk pair returns a few
rows an anchor; a window over the anchor picks the first of them. Scores are never stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import base

EXACT = 1 << 24
"""Integers up to this are exact in float32."""
LARGEST = 1023
"""No prime is larger: digits are multiplied by inverses, and their products must be exact as well."""
LONGEST = float(1 << 62)
"""Squared length that a vector must stay below, so that every score fits a long."""
DIMENSIONS = 1024
"""Components summed in one product; longer vectors are multiplied in parts."""
ANCHORS, ROWS = 65_536, 131_072
"""Rows of a chunk on either side."""
TILE = 256, 8192


def primes(dimensions: int, bound: int) -> list[int]:
    """Odd primes, the largest first, whose balanced products stay exact and whose product exceeds ``2 * bound + 1``."""
    half = min(LARGEST // 2, int((EXACT / max(1, min(dimensions, DIMENSIONS))) ** 0.5))
    out: list[int] = []
    for p in range(2 * half + 1, 2, -2):
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            if prod(out) > 2 * bound + 1 and len(out) > 1:
                return out
    raise OverflowError("vectors too long for the primes there are")


def balanced(x: np.ndarray, p: int, wide: bool = False) -> np.ndarray:
    """``x`` modulo ``p`` in -p/2 to p/2, in place. Wide values are reduced twice, as their quotient is rounded."""
    for _ in range(1 + wide):
        x -= np.rint(x * np.float32(1 / p)) * np.float32(p)
    return x


def residues(x: np.ndarray, p: int) -> np.ndarray:
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def scores(a: list[np.ndarray], b: list[np.ndarray], ps: list[int], bound: int) -> np.ndarray:
    """Exact inner products of the rows of two matrices given by their residues; float32 where that is exact, else long."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(ps):
        r: np.ndarray | None = None
        for at in range(0, max(1, a[k].shape[1]), DIMENSIONS):
            part = balanced(a[k][:, at : at + DIMENSIONS] @ b[k][:, at : at + DIMENSIONS].T, p, wide=True)
            r = part if r is None else balanced(r + part, p)
        for j in range(k):
            inverse = pow(ps[j], -1, p)
            r -= digits[j]
            r *= np.float32(inverse - p if inverse > p // 2 else inverse)
            r = balanced(r, p, wide=True)
        digits.append(r)
    kind = np.float32 if 2 * bound < EXACT else np.int64
    out = digits[0].astype(kind, copy=False)
    for k in range(1, len(ps)):
        out = out + digits[k].astype(kind, copy=False) * kind(prod(ps[:k]) % 2**63)
    return out


class Tile:
    """One side of a chunk: rows in order of ties (key, nulls last, then row number)."""

    def __init__(self, rows: pa.Table, dimensions: int):
        rows = rows.combine_chunks()
        key = rows.column("key")
        no_key = np.asarray(key.is_null().to_numpy(), bool)
        key_values = key.fill_null(0).to_numpy().astype(np.int64)
        order = np.lexsort((rows.column("uid").to_numpy(), key_values, no_key))
        self.rows = rows.take(pa.array(order))
        self.uid, self.label = self.rows.column("uid").to_numpy(), self.rows.column("label").to_numpy()
        self.x = np.zeros((len(order), dimensions), np.int32)
        for k, v in enumerate(self.rows.column("x")):
            v = np.frombuffer(v.as_buffer(), "<i4")
            self.x[k, : len(v)] = v

    def residues(self, which: np.ndarray, ps: list[int]) -> list[np.ndarray]:
        return [residues(self.x[which], p) for p in ps]


def _tiles(n: int, size: int) -> list[slice]:
    return [slice(k, k + size) for k in range(0, n, size)]


def first_of(owner: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first ``k`` entries of each owner by falling score, then place."""
    by = np.lexsort((place, -score, owner))
    o = owner[by]
    begin = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.zeros(0, np.int64)
    nth = np.arange(len(o)) - np.repeat(begin, np.diff(np.append(begin, len(o))))
    return by[nth < k]


def best_alike(anchors: Tile, rows: Tile, ps: list[int], bound: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, row, score)``: each anchor's first ``k`` rows of its label, without itself."""
    found = []
    for label in np.intersect1d(anchors.label, rows.label):
        mine, theirs = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
        for some in _tiles(len(mine), TILE[0]):
            a, of = anchors.residues(mine[some], ps), mine[some]
            kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
            for part in _tiles(len(theirs), TILE[1]):
                there = theirs[part]
                s = scores(a, rows.residues(there, ps), ps, bound).astype(np.float64 if bound < 2**53 else np.int64, copy=False)
                least = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)] if s.shape[1] > k + 1 else np.full(len(of), s.min())
                i, j = np.nonzero(s >= least[:, None])  # one more than k, as the anchor itself may be among them
                other = anchors.uid[of[i]] != rows.uid[there[j]]
                i, j = i[other], j[other]
                kept = [np.concatenate(x) for x in zip(kept, (i, there[j], s[i, j].astype(np.int64)), strict=True)]
                first = first_of(kept[0], kept[2], kept[1], k)
                kept = [x[first] for x in kept]
            found.append((of[kept[0]], kept[1], kept[2]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(f[c] for f in found)]) for c in range(3))


def best_in_windows(anchors: Tile, rows: Tile, owner: np.ndarray, low: np.ndarray, high: np.ndarray,
                    ps: list[int], bound: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(window, row, score)``: for each window (an anchor, a least and a greatest score; anchors ascend) the first ``k``
    rows of other labels in it."""
    found = []
    for some in _tiles(len(anchors.uid), TILE[0]):
        begin, end = np.searchsorted(owner, [some.start, min(some.stop, len(anchors.uid))])
        if begin == end:
            continue
        own, lo, hi = owner[begin:end] - some.start, low[begin:end], high[begin:end]
        size = min(some.stop, len(anchors.uid)) - some.start
        least, most = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
        np.minimum.at(least, own, lo)
        np.maximum.at(most, own, hi)
        a = anchors.residues(np.arange(some.start, some.start + size), ps)
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for part in _tiles(len(rows.uid), TILE[1]):
            there = np.arange(part.start, min(part.stop, len(rows.uid)))
            s = scores(a, rows.residues(there, ps), ps, bound)
            if s.dtype == np.float32:  # windows of floats: scores are below 2**24, so bounds beyond that may be cut to it
                inside = (s >= np.minimum(least, EXACT).astype(np.float32)[:, None]) & (s <= np.maximum(most, -EXACT).clip(max=EXACT).astype(np.float32)[:, None])
            else:
                inside = (s >= least[:, None]) & (s <= most[:, None])
            i, j = np.nonzero(inside)
            other = anchors.label[some][i] != rows.label[there[j]]
            i, j = i[other], j[other]
            value = s[i, j].astype(np.int64)
            by = np.lexsort((j, -value, i))
            i, j, value = i[by], j[by], value[by]
            # of an anchor's rows, by falling score: the first at or below each window's top, and those behind it
            rank = i * (2 * bound + 2) + (bound - value) if bound < 2**40 else None
            for nth in range(k):
                if nth == 0:
                    at = (np.searchsorted(rank, own * (2 * bound + 2) + (bound - np.minimum(hi, bound))) if rank is not None
                          else np.array([_first_below(i, value, o, h) for o, h in zip(own.tolist(), hi.tolist(), strict=True)], np.int64))
                pick = at + nth
                ok = np.flatnonzero(pick < len(i))
                ok = ok[(i[pick[ok]] == own[ok]) & (value[pick[ok]] >= lo[ok])]
                kept = [np.concatenate(x) for x in zip(kept, (ok + begin, there[j[pick[ok]]], value[pick[ok]]), strict=True)]
            first = first_of(kept[0], kept[2], kept[1], k)
            kept = [x[first] for x in kept]
        found.append(kept)
    return tuple(np.concatenate([np.zeros(0, np.int64), *(f[c] for f in found)]) for c in range(3))


def _first_below(i: np.ndarray, value: np.ndarray, owner: int, top: int) -> int:
    begin, end = np.searchsorted(i, [owner, owner + 1])
    return int(begin + np.searchsorted(-value[begin:end], -top))


def _integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, data, length = [], [], []
            for k, v in enumerate(batch.column("x")):
                if v.is_valid and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(x).all():
                        x = np.floor(scale * x)
                        if (size := float((x * x).sum())) >= LONGEST:
                            raise OverflowError("a vector is too long for its scores to fit a long")
                        rows.append(k)
                        data.append(x.astype("<i4").tobytes())
                        length.append(int(size) + 1)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("key"), kept.column("label"), kept.column("anchor"), pa.array(data, pa.binary()), pa.array(length, pa.int64())],
                                             ["key", "label", "anchor", "x", "length"])
    return run


def _positives(dimensions: int, ps: list[int], bound: int, k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return pa.table({"uid": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "other_key": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        a, b = Tile(anchors, dimensions), Tile(rows, dimensions)
        i, j, score = best_alike(a, b, ps, bound, k)
        return pa.table({"uid": a.uid[i], "other": b.uid[j], "other_key": b.rows.column("key").take(pa.array(j)), "score": score})
    return run


def _negatives(dimensions: int, ps: list[int], bound: int, k: int, low: int, high: int):
    names = ["uid", "nth", "other", "other_key", "score"]

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5, names)
        a, b = Tile(anchors, dimensions), Tile(rows, dimensions)
        given = a.rows.column("positives").combine_chunks()
        owner = np.repeat(np.arange(len(a.uid)), given.value_lengths().to_numpy())
        nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
        of = given.flatten().to_numpy().tolist()  # bounds in Python's integers: a score may be near the end of a long
        lo, hi = (np.array(x, np.int64) for x in ([-(-low * s // 100) for s in of], [high * s // 100 for s in of]))
        w, j, score = best_in_windows(a, b, owner, lo, hi, ps, bound, k)
        return pa.table([pa.array(a.uid[owner[w]]), pa.array(nth[w]), pa.array(b.uid[j]), b.rows.column("key").take(pa.array(j)), pa.array(score)], names)
    return run


def mine(rows: DataFrame, key: str, vector: str, label: str | Column, anchors: Column, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``, scores being exact.

    A component x counts as ``floor(scale * x)``. An anchor's positives are its first ``positives`` other rows of the
    same label; for each, the first ``negatives`` rows of other labels with ``low * positive <= 100 * negative
    <= high * positive`` are returned. First is: higher score, then smaller key, nulls last, then either.

    Rows without a label or a vector, or with a null or non-finite component, take no part. A shorter vector ends in
    zeros; an empty one scores 0. Rows that share a key are rows of their own, each an anchor where ``anchors`` says
    so; a null there is no anchor. Other columns are not read. A squared length of 2**62 or more raises, as
    its scores would not fit a long. An empty table gives no rows.
    """
    spark = rows.sparkSession
    slim = rows.select(F.col(key).cast("long").alias("key"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
                       F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("x"))
    slim = slim.filter(F.col("label").isNotNull()).mapInArrow(_integers(scale), "key long, label long, anchor boolean, x binary, length long")
    table = base.written(slim.withColumn("uid", F.monotonically_increasing_id()))
    n, m, bound, width = table.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max("length"), F.max(F.length("x"))).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not m:
        return spark.createDataFrame([], out)
    dimensions = max(1, width // 4)
    ps = primes(dimensions, bound)
    sides = -(-m // ANCHORS), max(-(-n // ROWS), min(3 * spark.sparkContext.defaultParallelism, -(-n // 1024)))

    def paired(left: DataFrame, right: DataFrame, function, schema: str) -> DataFrame:
        """Each chunk of anchors with each chunk of rows: a row of either side is sent once for each chunk of the other."""
        a = left.withColumn("a", F.pmod(F.xxhash64("uid"), F.lit(sides[0])).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(sides[1] - 1))))
        r = right.select([F.col(c).alias(c) for c in right.columns]).withColumn("r", F.pmod(F.xxhash64("uid"), F.lit(sides[1])).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(sides[0] - 1))))
        return a.groupBy("a", "r").cogroup(r.groupBy("a", "r")).applyInArrow(function, schema)

    def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("other_key"), "other")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    everyone = table.select("uid", "key", "label", "x")
    chosen = table.filter("anchor").select("uid", "key", "label", "x")
    alike = paired(chosen, everyone, _positives(dimensions, ps, bound, positives), "uid long, other long, other_key long, score long")
    alike = base.written(first(alike, ["uid"], positives).select("uid", F.col("rank").alias("nth"), F.col("other_key").alias("positive_id"), F.col("score").alias("positive_score")))
    of = alike.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_score")))["positive_score"].alias("positives"))
    seen = paired(chosen.join(of, "uid"), everyone, _negatives(dimensions, ps, bound, negatives, low, high),
                  "uid long, nth long, other long, other_key long, score long")
    seen = first(seen.withColumn("nth", (F.col("nth") + 1).cast("int")), ["uid", "nth"], negatives)
    return seen.join(alike, ["uid", "nth"]).join(chosen.select("uid", F.col("key").alias("anchor_id")), "uid").select(
        "anchor_id", "positive_id", "rank", F.col("other_key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS uid,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.uid, a.vec_id AS anchor_id, r.uid AS other, r.vec_id AS id, a.label = r.label AS alike,
           CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM rows a JOIN rows r ON a.uid <> r.uid WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT * FROM pairs WHERE alike
    QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, id NULLS LAST, other) <= 5),
found AS (
    SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.uid, p.other ORDER BY n.score DESC, n.id NULLS LAST, n.other) AS rank
    FROM positives p JOIN pairs n ON n.uid = p.uid AND NOT n.alike
    WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
"""
