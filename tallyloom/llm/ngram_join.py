"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets of sizes m and n with Jaccard similarity t or more differ in few tokens, so under *any*
total order of all tokens their prefixes of ``size - ceil(t * size) + 1`` tokens share a token. A
pair is a candidate only if that holds under every one of the orders: the first order's prefixes are
an inverted index, the other orders' prefixes are intersected for the pairs that it and the sketches
leave, and only what is left is verified on the whole sets.

Each order sorts by (frequent or not, a hash seeded per order). The frequent tokens are found over
all rows: each task counts its own tokens, tokens that it met repeatedly are summed, and the most
frequent ``FREQUENT`` are sent to the tasks (8 bytes each, so at most 1 MB). Any list of tokens gives
valid orders; a good one keeps lines and passages that many documents share out of the prefixes.

Rows with one and the same set are one class before any join; a class is joined by its smallest
document id, from there on as a number in the order of the ids. Every pair must first pass a sketch:
parities of the set's hashed tokens, of which two sets differ in no more places than they have tokens that are
not common, so no similar pair is lost. A set has as many of them as tokens or more (``BITS`` at least, ``MOST``
at most), as a sketch much smaller than its set tells nothing; of two lengths, the longer is folded to the shorter.

Blocks (classes with a common prefix token) are linked in passes. The first compares every member with
the block's hub. Blocks whose members are then not all connected are compared in tiles of bounded size,
sketch against sketch inside a task, and no pair becomes a row unless its sketches are near: first only
a spanning forest of the near pairs of a tile, nearest first, then, once those are verified, every near
pair that still lies between two components. So the rows of a group grow with its members and its tiles, and every
component comes out whole: a link is left unverified only between documents already connected. The
sketch comparisons in a group that is not connected still grow with its square.
Blocks of more than ``MANY`` members are blocked more finely before: sets this similar differ in at most
D tokens, so of D + 1 parts of the token space (cut by a hash) they agree on one entirely, and members
meet only under the contents of a part. Of blocks with the same members one is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import base, words

FREQUENT = 131_072
"""Tokens in the frequent list, a parameter of the order and not of the result."""
OFTEN = 4
"""Times that a task must meet a token among ``COUNTED`` before it reports it as perhaps frequent."""
COUNTED = 2_000_000
BITS = 2048
"""Least places of a sketch."""
MOST = 131_072
"""Most places of a sketch. It tells little of sets that differ in more tokens than that; the prefixes still do."""
FEW = 24
"""Members up to which the pairs of a block become rows; larger blocks are compared in tiles."""
TILE = 1024
"""Members of a block that meet as many others in one tile, about."""
MANY = 32_768
"""Members from which a block is blocked more finely before its members are compared."""


def token_sets(column: pa.Array, size: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, flat with row offsets."""
    w = words.words(column, lower)
    h = w.hashes()
    at, offsets = words.window_rows(w.row, size)
    flat = words.windows(h, size)[at] if len(at) else np.zeros(0, words.U)
    owner = np.repeat(np.arange(len(w.counts)), np.diff(offsets))
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):  # fewer words than a shingle: the whole sequence is the one token
        whole = []
        for r in short:
            x = h[w.row[r] : w.row[r + 1]]
            whole.append(words.mix(words.windows(x, len(x)), 100 + len(x))[0])
        flat, owner = np.concatenate([flat, np.array(whole, words.U)]), np.concatenate([owner, short])
        by = np.argsort(owner, kind="stable")
        flat, owner = flat[by], owner[by]
    border = np.searchsorted(owner, np.arange(len(w.counts) + 1))
    rows = [words.distinct(flat[a:b]) for a, b in zip(border[:-1], border[1:], strict=True)]
    return np.concatenate([np.zeros(0, words.U), *rows]), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)


def prefixes(flat: np.ndarray, offsets: np.ndarray, num: int, den: int, often: np.ndarray, order: int):
    """Each set's prefix under one order, ascending, as 48-bit ranks, flat with row offsets."""
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.minimum(np.searchsorted(often, flat), max(len(often) - 1, 0))
    common = often[place] == flat if len(often) else np.zeros(len(flat), bool)
    p = np.where(n > 0, n - -(-n * num // den) + 1, 0)
    rank = owner.astype(words.U) << words.U(48) | common.astype(words.U) << words.U(47) | words.mix(flat, 20 + order) >> words.U(17)
    inside = np.arange(len(flat)) - np.repeat(offsets[:-1], n) < np.repeat(p, n)
    return np.sort(rank)[inside] & words.U(2**48 - 1), np.concatenate([[0], np.cumsum(p)])


def sketches(flat: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> np.ndarray:
    """``bits`` parities of each set's tokens, as one row of 64-bit words a set."""
    place = (words.mix(flat, 41) % words.U(bits)).astype(np.int64)
    found, some = [np.zeros((0, bits // 8), np.uint8)], max(1, 256 * BITS // bits)
    for at in range(0, len(offsets) - 1, some):  # 256 sets are counted at once, fewer if sketches are long
        ends = offsets[at : at + some + 1]
        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        odd = np.bincount(owner * bits + place[ends[0] : ends[-1]], minlength=(len(ends) - 1) * bits) & 1
        found.append(np.packbits(odd.astype(bool).reshape(-1, bits), axis=1))
    return np.concatenate(found).view(np.int64)


def fitted_sketches(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as long as the sets ask for, flat 64-bit words with row offsets: the next power of two of the size,
    from ``BITS`` to ``MOST`` places."""
    n = np.diff(offsets)
    bits = np.clip(2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), BITS, MOST)
    cut = np.concatenate([[0], np.cumsum(bits // 64)])
    out = np.zeros(cut[-1], np.int64)
    for b in np.unique(bits):
        rows = np.flatnonzero(bits == b)
        mine = flat[np.repeat(bits == b, n)]
        found = sketches(mine, np.concatenate([[0], np.cumsum(n[rows])]), int(b))
        out[cut[rows][:, None] + np.arange(b // 64)] = found
    return out, cut


def folded(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of sketches as sketches of ``width`` words; zeros after a shorter sketch change nothing."""
    return np.bitwise_xor.reduce(x.reshape(len(x), -1, width), axis=1)


def padded(sketch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of sketches as rows of one length, zeros after the shorter ones, and their own lengths in words."""
    width = sketch.value_lengths().to_numpy().astype(np.int64)
    x = np.zeros((len(width), width.max(initial=BITS // 64)), words.U)
    x[np.arange(x.shape[1]) < width[:, None]] = sketch.flatten().to_numpy().view(words.U)
    return x, width


def near_pairs(x: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray | None, num: int, den: int,
               width: np.ndarray | None = None):
    """Pairs of rows with different labels whose sketches may be those of similar sets, and how far they are apart.

    With ``side``, only pairs of different sides. ``width``: words of each sketch, which grow with ``n``; zeros follow them.
    """
    by = np.argsort(n, kind="stable")
    x, n, label = x[by], n[by], label[by]
    side = None if side is None else side[by]
    width = np.full(len(n), x.shape[1]) if width is None else width[by]
    found = []
    for w in np.unique(width):
        first, last = np.searchsorted(width, [w, w + 1])
        y = folded(x[first : np.searchsorted(n, n[last - 1] * den // num, "right")], w)
        step = max(1, 32 * BITS // 64 // int(w))
        for at in range(first, last, step):
            rows = slice(at, min(at + step, last))
            upto = int(np.searchsorted(n, n[rows][-1] * den // num, "right"))  # none larger is similar
            apart = np.bitwise_count(y[at - first : rows.stop - first, None] ^ y[None, at - first : upto - first]).sum(axis=2, dtype=np.int64)
            on = apart * (den + num) <= (n[rows, None] + n[None, at:upto]) * (den - num)
            on &= label[rows, None] != label[None, at:upto]
            if side is not None:
                on &= side[rows, None] != side[None, at:upto]
            i, j = np.nonzero(np.triu(on, 1))
            found.append(np.stack([by[i + at], by[j + at], apart[i, j]]))
    i, j, apart = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return np.minimum(i, j), np.maximum(i, j), apart


def forest(label: np.ndarray, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) make a spanning forest of the labels, nearest pairs first."""
    comp = np.unique(label, return_inverse=True)[1]
    left, chosen = np.lexsort((j, i, apart)), [np.zeros(0, np.int64)]
    while len(left := left[comp[i[left]] != comp[j[left]]]):
        a, b, rank = comp[i[left]], comp[j[left]], np.arange(len(left))
        best = np.full(len(comp), len(left))
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        some = np.flatnonzero(best < len(left))
        chosen.append(left[np.unique(best[some])])
        to = np.arange(len(comp))
        to[some] = a[best[some]] + b[best[some]] - some  # the other end of the nearest pair
        back = (to[to] == np.arange(len(comp))) & (to > np.arange(len(comp)))
        to[back] = np.flatnonzero(back)
        while (to[to] != to).any():
            to = to[to]
        comp = to[comp]
    return np.concatenate(chosen)


def _near(num: int, den: int, spanning: bool):
    """Near pairs (a, b) of each tile; rows come sorted by tile, and a tile may lie in several batches."""
    def pairs(tile: pa.RecordBatch) -> pa.RecordBatch:
        n, label = tile.column("n").to_numpy(), tile.column("name").to_numpy()
        x, width = padded(tile.column("sketch"))
        side = tile.column("side").to_numpy() if tile.column("i")[0] != tile.column("j")[0] else None
        i, j, apart = near_pairs(x, n, label, side, num, den, width)
        if spanning:
            kept = forest(label, i, j, apart)
            i, j = i[kept], j[kept]
        rep = tile.column("rep")
        return pa.RecordBatch.from_arrays([rep.take(pa.array(i)), rep.take(pa.array(j))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                held = batch if held is None else pa.concat_batches([held, batch])
            if held is None or not held.num_rows:
                continue
            keys = [held.column(c).to_numpy() for c in ("token", "i", "j")]
            new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            ends = np.concatenate([[0], np.flatnonzero(new) + 1, [held.num_rows] if batch is None else []]).astype(np.int64)
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if (out := pairs(held.slice(a, b - a))).num_rows:
                    yield out
            held = held.slice(ends[-1])
    return run


def _near_enough(num: int, den: int):
    """Of pairs (a, b, na, nb, sa, sb): those whose sketches may be those of similar sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                (x, wx), (y, wy) = padded(part.column("sa")), padded(part.column("sb"))
                apart = np.zeros(len(x), np.int64)
                for w in np.unique(both := np.minimum(wx, wy)):
                    rows = np.flatnonzero(both == w)
                    apart[rows] = np.bitwise_count(folded(x[rows], w) ^ folded(y[rows], w)).sum(axis=1, dtype=np.int64)
                n = part.column("na").to_numpy() + part.column("nb").to_numpy()
                yield part.select(["a", "b"]).filter(pa.array(apart * (den + num) <= n * (den - num)))
    return run


def _frequent_in(text: str, size: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for part in chain(base.slices(batches, text), [None]):
            if part is not None:
                got.append(token_sets(part.column(text), size, lower)[0])
                held += len(got[-1])
            if got and (part is None or held > COUNTED):
                tokens, n = np.unique(np.concatenate(got), return_counts=True)
                keep = n >= OFTEN
                yield pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(n[keep])], ["token", "n"])
                got, held = [], 0
    return run


def _describe(key: str, text: str, size: int, lower: bool, num: int, den: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for part in base.slices(batches, text):
            flat, offsets = token_sets(part.column(text), size, lower)
            n = np.diff(offsets)
            keys = []
            for seed in (11, 12):
                summed = np.zeros(len(flat) + 1, words.U)
                np.cumsum(words.mix(flat, seed), out=summed[1:])
                total = summed[offsets[1:]] - summed[offsets[:-1]]
                keys.append(pa.array(words.mix(total + n.astype(words.U), seed).view(np.int64)))
            prefix, cut = prefixes(flat, offsets, num, den, often, 0)
            yield pa.RecordBatch.from_arrays(
                [part.column(key), pa.array(n.astype(np.int64)), *keys, base.lists(prefix.view(np.int64), cut),
                 base.lists(*fitted_sketches(flat, offsets))],
                ["id", "n", "k1", "k2", "p0", "sketch"])
    return run


def _parts(size: int, lower: bool, num: int, den: int, frequent):
    """Keys under which similar sets surely meet: the contents of one part of the token space.

    Sizes fall into classes of ratio ``den / num``, so similar sets are of one class or of neighbours, and
    each set is listed in its own class and the next. An empty part says little; it is listed once for
    each token of the first order's prefix, of which similar sets share one as well.
    """
    width = np.log(den / num) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for part in base.slices(batches, "text"):
            flat, offsets = token_sets(part.column("text"), size, lower)
            n = np.diff(offsets)
            prefix, cut = prefixes(flat, offsets, num, den, often, 0)
            owner = np.repeat(np.arange(len(n)), n)
            rows, keys = [], []
            for up in (0, 1):
                level = np.floor(np.log(np.maximum(n, 1)) / width).astype(np.int64) + up
                largest = np.exp((level + 1) * width)
                parts = np.floor(2 * largest * (den - num) / (den + num) + 1e-6).astype(np.int64) + 1
                border = np.concatenate([[0], np.cumsum(parts)])
                slot = border[owner] + (words.mix(flat, 31) % parts[owner].astype(words.U)).astype(np.int64)
                by = np.argsort(slot, kind="stable")
                summed = np.concatenate([np.zeros(1, words.U), np.cumsum(words.mix(flat[by], 32))])
                ends = np.searchsorted(slot[by], np.arange(border[-1] + 1))
                row = np.repeat(np.arange(len(n)), parts)
                name = words.mix((np.arange(border[-1]) - border[row]).astype(words.U), 33) + words.mix(level[row].astype(words.U), 34)
                some = (ends[1:] > ends[:-1]) & (n[row] > 0)
                rows.append(row[some])
                keys.append(words.join(name, summed[ends[1:]] - summed[ends[:-1]])[some])
                none = np.flatnonzero(~some & (n[row] > 0))
                counts = np.diff(cut)[row[none]]
                at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(cut[row[none]], counts)
                rows.append(np.repeat(row[none], counts))
                keys.append(words.join(np.repeat(name[none], counts), prefix[at], 5))
            row, key = np.concatenate(rows), np.concatenate(keys)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(row)), part.column("label").take(pa.array(row)), pa.array(n[row]), pa.array(key.view(np.int64))],
                ["rep", "label", "n", "token"])
    return run


def _sets(key: str, text: str, size: int, lower: bool, num: int, den: int, orders: int, frequent):
    """Whole sets, and their prefixes under the other orders: a token's rank in the order is its name, cut to 32 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for part in base.slices(batches, text):
            flat, offsets = token_sets(part.column(text), size, lower)
            columns = []
            for k in range(1, orders):
                prefix, cut = prefixes(flat, offsets, num, den, often, k)
                columns.append(base.lists((prefix >> words.U(16)).astype(np.uint32).view(np.int32), cut))
            yield pa.RecordBatch.from_arrays([part.column(key), base.lists(flat.view(np.int64), offsets), *columns],
                                             ["id", "tokens", *[f"p{k}" for k in range(1, orders)]])
    return run


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, lower: bool = True,
                       orders: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(<key>, n_shingles, component_id)`` for every row of ``docs``.

    Two rows link when ``den * |intersection| >= num * |union|`` of their sets of distinct
    ``size``-word shingles; a text with fewer words is one token, a text without words or a null has
    the empty set and links with nothing. ``component_id`` is the smallest key reachable by links, the
    row itself included. Repeated rows come back as often as given; rows that share a key are one
    document; a null key gets a null component and links with nothing. Other columns are ignored.
    Tokens are 64-bit hashes, classes of equal sets are keyed by 128 bits.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    counts = slim.select("text").mapInArrow(_frequent_in("text", size, lower), "token long, n long")
    top = (counts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT))
    often = np.sort(np.array([r.token for r in top.select("token").collect()], np.int64).view(words.U))
    frequent = spark.sparkContext.broadcast(often)

    schema = T.StructType([
        T.StructField("id", kind), *[T.StructField(c, T.LongType()) for c in ("n", "k1", "k2")],
        *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("p0", "sketch")]])
    rows = base.written(slim.mapInArrow(_describe("id", "text", size, lower, num, den, frequent), schema))
    classes = base.written(rows.filter("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("first")))
    if isinstance(kind, T.LongType):
        numbers = None
        classes = classes.withColumn("rep", F.col("first"))
    else:  # numbers in the order of the keys, as rows by token are many and should be short
        numbers = base.written(classes.select("first").distinct().orderBy("first").withColumn("rep", F.monotonically_increasing_id()))
        classes = base.written(classes.join(numbers, "first"))
    fronts = rows.join(classes, ["k1", "k2"]).filter("id = first").dropDuplicates(["k1", "k2"])
    fronts = base.written(fronts.select("rep", "n", "p0", "sketch"))
    heads = base.written(fronts.select("rep", "n", "sketch"))
    members_of = rows.select("id", "n", "k1", "k2").join(classes, ["k1", "k2"], "left").select(
        "id", "n", *[F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("first", "rep")])
    members_of = base.written(members_of)
    base.free(rows)

    posts = fronts.select("rep", "n", F.explode("p0").alias("token"))
    blocks = base.written(posts.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    posts = base.written(posts.join(blocks, "token"))
    base.free(fronts, blocks)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType())),
                           *[T.StructField(f"p{k}", T.ArrayType(T.IntegerType())) for k in range(1, orders)]])
    meet = [f"arrays_overlap(a{k}, b{k})" for k in range(1, orders)]

    def texts_of(ids: DataFrame) -> DataFrame:
        """Texts of classes: ``ids`` (id, ...) with every text of their keys."""
        if numbers is None:
            return slim.join(ids, "id")
        named = ids.join(numbers.withColumnRenamed("rep", "id"), "id").withColumnRenamed("id", "number")
        return slim.join(named, F.col("id") == F.col("first")).select(F.col("number").alias("id"), "text", *ids.drop("id").columns)

    def sketched(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b): those whose sketches are near."""
        a, b = (heads.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near_enough(num, den), "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of written pairs (a, b): those whose other prefixes all meet, and whose sets are similar."""
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        sets = base.written(texts_of(ids).mapInArrow(_sets("id", "text", size, lower, num, den, orders, frequent), schema))
        a, b = (sets.select(F.col("id").alias(c), F.col("tokens").alias(x), *[F.col(f"p{k}").alias(f"{c}{k}") for k in range(1, orders)])
                for c, x in ("ax", "by"))
        both = pairs.join(a, "a").join(b, "b").filter(" and ".join(meet) or "true").withColumn("s", F.size(F.array_intersect("x", "y")))
        links = base.written(both.filter(f"{den} * s >= {num} * (size(x) + size(y) - s)").select("a", "b"))
        base.free(sets)
        return links

    near = f"least(m, n) * {den} >= greatest(m, n) * {num}"

    def spokes(members: DataFrame) -> DataFrame:
        """Links of members (token, rep, n) to the hubs of their blocks."""
        hash_ = F.xxhash64("rep")
        hubs = members.groupBy("token").agg(F.min_by("rep", hash_).alias("hub"), F.min_by("n", hash_).alias("m"))
        found = members.join(hubs, "token").filter(f"rep <> hub and {near}")
        found = base.written(found.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct())
        return verified(base.written(sketched(found)))

    def labels(links: DataFrame) -> DataFrame:
        """Each linked class under its smallest linked class, and that one's: equal labels are connected."""
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = base.written(both.groupBy("a").agg(F.min("b").alias("h")).withColumn("h", F.least("a", "h")))
        up = hook.select(F.col("a").alias("h"), F.col("h").alias("hh"))
        return base.written(hook.join(up, "h", "left").select(F.col("a").alias("rep"), F.coalesce("hh", "h").alias("label")))

    def still_open(members: DataFrame) -> DataFrame:
        """Members (token, rep, n, label) of blocks in which not all labels are equal."""
        who = F.xxhash64("rep", "n")
        mixed = members.groupBy("token").agg(
            F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64(F.lit(1), "rep", "n")).alias("odd"),
            F.sum(F.shiftright(who, 32)).alias("high"), F.sum(who.bitwiseAND(F.lit(2**32 - 1))).alias("low")).filter("x <> y")
        mixed = mixed.groupBy("c", "odd", "high", "low").agg(F.min("token").alias("token"))  # one of those with the same members
        return base.written(members.join(base.written(mixed.select("token")), "token", "left_semi"))

    first = spokes(posts)
    named = base.written(posts.join(labels(first), "rep", "left").select(
        "token", "rep", "n", "members", F.coalesce("label", "rep").alias("label")))
    named_open = still_open(named)
    few = named_open.filter(F.col("members") <= FEW)
    large = named_open.filter(f"members > {FEW} and members <= {MANY}")
    huge = named_open.filter(F.col("members") > MANY)
    if not huge.isEmpty():
        todo = huge.groupBy(F.col("rep").alias("id")).agg(F.min("label").alias("label"))
        texts = texts_of(base.written(todo)).dropDuplicates(["id"]).select("id", "text", "label")
        fine = base.written(texts.mapInArrow(_parts(size, lower, num, den, frequent), "rep long, label long, n long, token long"))
        fine = still_open(fine)
        large = large.unionByName(fine.join(fine.groupBy("token").agg(F.count(F.lit(1)).alias("members")), "token"))

    def tiled(members: DataFrame, spanning: bool) -> DataFrame:
        """Near pairs (a, b) with different labels of members (token, rep, n, label, members) of one block."""
        cuts = F.ceil(F.col("members") / TILE)
        own = F.pmod(F.xxhash64("rep"), cuts)
        tiles = members.select("token", "rep", "n", F.xxhash64("label").alias("name"), own.alias("own"), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("other"))
        tiles = tiles.join(heads.select("rep", "sketch"), "rep").select(
            "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "n", "name",
            F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "sketch")
        tiles = tiles.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
        pairs = tiles.mapInArrow(_near(num, den, spanning), "a long, b long")
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    other = few.select("token", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"))
    rest = few.withColumnRenamed("rep", "a").join(other, "token").filter(f"a < b and label <> other and {near}").select("a", "b")
    large = base.written(large.select("token", "rep", "n", "members", "label"))
    some = sketched(rest.distinct()).unionByName(tiled(large, True)).distinct()
    linked = first.unionByName(verified(base.written(some)))
    comps = base.written(base.components(linked))
    named = large.drop("label").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    large = still_open(base.written(named.select("token", "rep", "n", "members", F.coalesce("comp", "rep").alias("label"))))
    late = verified(base.written(tiled(large, False).distinct()))
    if not late.isEmpty():
        comps = base.written(base.components(linked.unionByName(late)))
    comps = comps.withColumnRenamed("id", "rep")
    if numbers is not None:
        comps = comps.join(numbers.select(F.col("rep").alias("comp"), F.col("first").alias("least")), "comp").drop("comp").withColumnRenamed("least", "comp")
    out = members_of.join(comps, "rep", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("comp", "first", "id")).alias("component_id"))
