"""Text comparison over joined pairs: overlap scores, exact ratios, diffs, shared runs, fuzzy joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import text as tx
from tallyloom.operators.matching import ratios
from tallyloom.operators.ordered import with_previous
from tallyloom.sources.store import small, store

# fixed values: the weights of the overall score
WEIGHTS = {"character": 0.2, "line": 0.3, "token": 0.3, "structure": 0.2}


def versions(df: DataFrame, key: Column, id_col: str, text_col: str) -> DataFrame:
    """Pair every row with the row before it (by id) that has the same key.

    Gives ``(id_a, id_b, text_a, text_b)``, where a is the earlier one: at most one pair per row, also
    in a key that holds a large share of the table. Only ids and key hashes are sorted; the texts are
    fetched afterwards by their unique id. The last fetch is a shuffle join, which leaves the pairs
    spread by ``id_b`` for the per-pair work and aggregates that follow.
    """
    slim = store(df.select(F.col(id_col).alias("id_b"), key.alias("_key")), "keys").df
    linked = with_previous(slim, ["_key"], ["id_b"], id_a="id_b").filter(F.col("id_a").isNotNull())
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    older = texts.toDF("id_a", "text_a")
    newer = texts.toDF("id_b", "text_b")
    return linked.select("id_a", "id_b").join(older, "id_a").join(newer.hint("merge"), "id_b")


def _counted(pairs: DataFrame, ids: list[str], units: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``overlap_scores`` over all rows that share their ids, by one row per unit."""
    def tag(kind: str, col: Column, side: int) -> Column:
        return F.transform(col, lambda x: F.struct(
            F.lit(kind).alias("kind"), x.alias("unit"), F.lit(1 - side).alias("a"), F.lit(side).alias("b")))

    tagged = F.concat(*[
        tag(kind, col, side) for kind, sides in units.items() for side, col in enumerate(sides)
    ])
    counted = (
        pairs.select(*ids, F.inline_outer(tagged))
        .groupBy(*ids, "kind", "unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )

    def score(name: str) -> Column:
        mine = F.col("kind") == name
        both = F.sum(F.when(mine, F.least("a", "b")).otherwise(0))
        total = F.sum(F.when(mine, F.col("a") + F.col("b")).otherwise(0))
        return F.when(total == 0, 1.0).otherwise(2.0 * both / total).alias(f"{name}_score")

    return counted.groupBy(*ids).agg(*[score(name) for name in units])


def overlap_scores(pairs: DataFrame, ids: list[str], units: dict[str, tuple[Column, Column]],
                   texts: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Multiset overlap 2 * sum(min(count)) / total per kind of unit; 1.0 if both sides are empty.

    This bounds the exact matching ratio from above. ``texts`` are scored by their characters, as by
    ``character_score``: null where a side is, and rows that differ in such a score are different pairs.
    Units are counted within the row. Rows that share their ids count as one pair: they are found among the
    scores and counted again together.
    """
    texts = texts or {}
    rows = _by_row(pairs, ids, {**texts, **units}, "score", overlaps)
    known = reduce(and_, [F.col(f"{n}_known") for n in units], F.lit(True))
    own = [F.when(F.col(f"{n}_known"), F.col(f"{n}_score")).alias(f"{n}_score") for n in texts]
    kinds = [F.when(known, F.col(f"{n}_score")).otherwise(1.0).alias(f"{n}_score") for n in units]
    names = [*ids, *[f"{n}_score" for n in texts]]
    scores = rows.select(*ids, *own, *kinds)
    again = store(scores.groupBy(*names).count().filter("count > 1").drop("count"), "shared")
    if not again.rows:
        return scores
    there = small(again.rows, again.df)
    same = lambda left: reduce(and_, [left[c].eqNullSafe(there[c]) for c in names])
    scored = pairs.withColumns({f"{n}_score": character_score(*pair) for n, pair in texts.items()})
    shared = scored.join(there, same(scored), "left_semi")
    return scores.join(there, same(scores), "left_anti").unionByName(_counted(shared, names, units))


def character_score(a: Column, b: Column) -> Column:
    """The same overlap for the characters of two texts, within the row.

    A text has few distinct characters, and removing one from it tells how often it occurs.
    """
    def count(text: Column, c: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, c))

    both = F.aggregate(
        F.array_distinct(tx.characters(a)), F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * both / total)


def overall(scores: dict[str, Column]) -> Column:
    """Weighted sum of the four scores."""
    return sum((F.lit(w) * scores[name] for name, w in WEIGHTS.items()), F.lit(0.0))


# --- whole pairs in numpy ------------------------------------------------------------------------------

BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
"""What is sent to Python at once: a pair has two whole texts and all their units."""


def _characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of a string column as numbers, flat, and how many each row has."""
    column = column.fill_null("").cast(pa.large_string())
    _, places, values = column.buffers()
    ends = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8)[ends[0] : ends[-1]] if values is not None else np.zeros(0, np.uint8)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    data = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    codes, inside = data[at], np.ones(len(at), bool)
    for k in (1, 2, 3):  # the bytes of one character make its number
        inside &= (data[at + k] & 0xC0) == 0x80
        codes = np.where(inside, codes << 8 | data[at + k], codes)
    return codes, np.diff(np.searchsorted(at, ends - ends[0]))


def _units(left: pa.Array, right: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per side all rows' units as numbers, flat, and how many each row has; a null side has none.

    Texts are cut to characters; the elements of arrays are numbered by their distinct values.
    """
    if not pa.types.is_list(left.type):
        return [_characters(left), _characters(right)]
    both = pa.chunked_array([left.flatten(), right.flatten()]).combine_chunks()
    codes = both.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = len(left.flatten())
    counts = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (left, right)]
    return [(codes[:cut], counts[0]), (codes[cut:], counts[1])]


def overlaps(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Twice the units that both sides of a row have, counted, over all units; 1.0 for two empty sides."""
    rows = len(left[1])
    numbers = np.unique(np.concatenate([left[0], right[0]]), return_inverse=True)[1]
    most = max(int(numbers.max(initial=0)) + 1, 1)
    cut = len(left[0])
    found = [np.unique(np.repeat(np.arange(rows), n) * most + codes, return_counts=True)
             for codes, n in ((numbers[:cut], left[1]), (numbers[cut:], right[1]))]
    key, a, b = np.intersect1d(found[0][0], found[1][0], assume_unique=True, return_indices=True)
    both = np.zeros(rows, np.int64)
    np.add.at(both, key // most, np.minimum(found[0][1][a], found[1][1][b]))
    total = left[1] + right[1]
    return np.where(total > 0, 2.0 * both / np.maximum(total, 1), 1.0)


def matching_ratios(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Exact matching-block ratio of each row."""
    return ratios(*[np.split(codes, np.cumsum(n)[:-1]) for codes, n in (left, right)])


def _by_row(pairs: DataFrame, kept: list[Column | str], units: dict[str, tuple[Column, Column]], suffix: str,
            score: Callable[[tuple, tuple], np.ndarray]) -> DataFrame:
    """``kept``, ``score`` of every kind's two sides and whether both are there, row by row, as a written table.

    The columns go to Python in batches of bounded rows and bytes; the settings for that are put back.
    """
    spark, names = pairs.sparkSession, list(units)
    asked = pairs.select(*kept, *[c.alias(f"_{side}{i}") for i, n in enumerate(names) for side, c in zip("ab", units[n], strict=True)])
    own = asked.columns[: len(asked.columns) - 2 * len(names)]
    schema = T.StructType([*asked.select(*own).schema.fields, *[T.StructField(f"{n}_{suffix}", T.DoubleType()) for n in names],
                           *[T.StructField(f"{n}_known", T.BooleanType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sides = [(batch.column(f"_a{i}"), batch.column(f"_b{i}")) for i in range(len(names))]
                found = [pa.array(score(*_units(a, b)), pa.float64()) for a, b in sides]
                known = [pc.and_(a.is_valid(), b.is_valid()) for a, b in sides]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *found, *known], schema.names)

    before = {k: spark.conf.get(k) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        return store(asked.mapInArrow(run, schema), "scores").df
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one big-integer step per element of ``b``."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hits = row & where.get(x, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


def _common_lengths(sides: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in sides:
        yield pd.Series([_common_length(list(a), list(b)) for a, b in zip(left, right)], dtype="int64")


common_length = F.pandas_udf(_common_lengths, T.LongType())
"""Length of the longest ordered overlap of two arrays of units."""


def exact_scores(pairs: DataFrame, ids: list[str], units: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Exact matching-block ratio of two texts or arrays of units per kind; for pairs already joined."""
    return _by_row(pairs, ids, units, "ratio", matching_ratios).select(*ids, *[f"{n}_ratio" for n in units])


def line_diff(pairs: DataFrame, ids: list[str], left: str, right: str) -> DataFrame:
    """Lines of one side without a counterpart on the other: ``(tag, line_no, line)``.

    Equal lines cancel out one for one, in order; ``-`` marks the left side and ``+`` the right.
    """
    sides = pairs.select(*ids, F.explode(F.array(
        F.struct(F.lit("-").alias("tag"), F.col(left).alias("text")),
        F.struct(F.lit("+").alias("tag"), F.col(right).alias("text")),
    )).alias("_side"))
    numbered = sides.select(
        *ids, F.col("_side.tag").alias("tag"), F.posexplode(tx.lines(F.col("_side.text"))).alias("line_no", "line")
    )

    def places(tag: str) -> Column:
        found = F.when(F.col("tag") == tag, F.col("line_no").cast("bigint"))
        return F.sort_array(F.collect_list(found))

    sets = numbered.groupBy(*ids, "line").agg(places("-").alias("_a"), places("+").alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    common = F.least(F.size(a), F.size(b))
    surplus = F.concat(
        F.transform(F.slice(a, common + 1, F.size(a)), lambda n: F.struct(F.lit("-").alias("tag"), n.alias("line_no"))),
        F.transform(F.slice(b, common + 1, F.size(b)), lambda n: F.struct(F.lit("+").alias("tag"), n.alias("line_no"))),
    )
    return sets.select(*ids, F.inline(surplus), "line")


# --- shared runs -------------------------------------------------------------------------------------

def _grams(df: DataFrame, id_col: str, units: Column, n: int, prefix: str) -> DataFrame:
    """Every n-gram with its position and the units just before and after it (NULL at the ends)."""
    def gram(i: Column) -> Column:
        return F.struct(
            F.array_join(F.slice("_w", i, n), "\u0001").alias("gram"),
            F.get("_w", i - 2).alias("before"), F.get("_w", i + F.lit(n - 1)).alias("after"))

    # an empty list for short texts instead of a filter, which would split the text a second time
    count = F.size("_w") - F.lit(n - 1)
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    cut = df.select(id_col, units.alias("_w")).select(
        id_col, F.posexplode(F.transform(starts, gram)).alias(f"{prefix}_pos", "_g"))
    return cut.select(id_col, f"{prefix}_pos", "_g.gram", F.col("_g.before").alias(f"{prefix}_before"),
                      F.col("_g.after").alias(f"{prefix}_after"))


def shared_runs(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
                left_units: Column, right_units: Column, n: int) -> DataFrame:
    """Longest run of units that two texts share, for every pair sharing at least ``n`` in a row.

    Texts meet on equal n-grams. Of a run, only the first and the last n-gram are kept (their outer
    neighbours differ, or a text ends there): a condition of the join, so the inside of long or
    repetitive runs is never emitted. On a diagonal, starts and ends alternate, which makes the n-th
    start belong to the n-th end.
    """
    a = _grams(left, left_id, left_units, n, "a")
    stored = store(_grams(right, right_id, right_units, n, "b"), "grams")
    b = small(stored.rows, stored.df)
    starts = ~F.col("a_before").eqNullSafe(F.col("b_before")) | F.col("a_before").isNull()
    ends = ~F.col("a_after").eqNullSafe(F.col("b_after")) | F.col("a_after").isNull()
    met = a.join(b, (a["gram"] == b["gram"]) & (starts | ends)).select(
        left_id, right_id, (F.col("a_pos") - F.col("b_pos")).alias("diagonal"), F.col("a_pos").alias("pos"),
        starts.alias("is_start"), ends.alias("is_end"),
    )
    # sorted positions of starts and of ends on one diagonal pair up element by element
    runs = met.groupBy(left_id, right_id, "diagonal").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_start"), F.col("pos")))).alias("s"),
        F.sort_array(F.collect_list(F.when(F.col("is_end"), F.col("pos")))).alias("e"),
    )
    lengths = F.zip_with("s", "e", lambda s, e: e - s + n)
    return runs.groupBy(left_id, right_id).agg(
        F.max(F.array_max(lengths)).cast("bigint").alias("longest_run"),
        F.sum(F.size("s")).cast("bigint").alias("runs"),
    )


# --- edit distance -----------------------------------------------------------------------------------

def deletions(word: Column, d: int) -> Column:
    """Hashes of all strings that up to ``d`` deletions make of a word, itself included."""
    none = F.array().cast("array<string>")

    def shorter(v: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(v))
        cut = F.transform(places, lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))))
        return F.when(F.length(v) > 0, cut).otherwise(none)

    def step(state: Column, _: Column) -> Column:
        more = F.array_distinct(F.flatten(F.transform(state["last"], shorter)))
        return F.struct(F.concat(state["all"], more).alias("all"), more.alias("last"))

    start = F.struct(F.array(word).alias("all"), F.array(word).alias("last"))
    return F.transform(F.aggregate(F.sequence(F.lit(1), F.lit(d)), start, step)["all"], lambda v: F.xxhash64(v))


def fuzzy_pairs(names: DataFrame, name: str, d: int) -> DataFrame:
    """Pairs of distinct strings within edit distance ``d`` (1 or more), as ``(name_a, name_b, distance)``.

    Strings of up to 2d + 1 characters meet in a deletion index: two strings within d edits of each other have a common
    string that each becomes by d deletions or fewer, and a string that short has few of those.

    Of a pair with a longer string, cut that into d + 1 even pieces of two characters or more: d edits leave one piece
    untouched, and it then occurs in the shorter string at most d places away. Strings meet on (length, piece number, piece).

    Either way strings meet on a key of their content only, and the distance is checked inside the join. Nulls pair with
    nothing; repeated strings count once.
    """
    if d < 1:
        raise ValueError("the distance must be 1 or more")
    words = names.select(F.col(name).alias("w")).filter(F.col("w").isNotNull()).distinct().withColumn("len", F.length("w"))
    pieces, brief = d + 1, 2 * d + 1

    def start(length: Column, i: Column) -> Column:
        # the last (length mod pieces) pieces are one character longer
        return i * F.floor(length / pieces) + F.greatest(F.lit(0), i - (pieces - length % pieces))

    def width(length: Column, i: Column) -> Column:
        return F.floor(length / pieces) + F.when(i >= pieces - length % pieces, 1).otherwise(0)

    index = (
        words.filter(F.col("len") > brief)
        .select("w", "len", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("i"))
        .select(F.col("w").alias("long_w"), F.col("len").alias("long_len"), "i", F.substring(
            "w", (start(F.col("len"), F.col("i")) + 1).cast("int"),
            width(F.col("len"), F.col("i")).cast("int")).alias("piece"))
    )
    probe = (
        words.filter(F.col("len") + d > brief)
        .select("w", "len", F.explode(F.sequence(F.col("len"), F.col("len") + d)).alias("long_len"))
        .filter(F.col("long_len") > brief)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("i"))
        .withColumns({"p": start(F.col("long_len"), F.col("i")).cast("int"),
                      "n": width(F.col("long_len"), F.col("i")).cast("int")})
        .withColumns({"lo": F.greatest(F.lit(0), F.col("p") - d), "hi": F.least(F.col("len") - F.col("n"), F.col("p") + d)})
        .filter(F.col("lo") <= F.col("hi"))
        .select(F.col("w").alias("short_w"), "long_len", "i", F.explode(F.array_distinct(F.transform(
            F.sequence("lo", "hi"), lambda q: F.substring("w", q + 1, F.col("n"))))).alias("piece"))
    )
    near = F.levenshtein("short_w", "long_w", d) >= 0
    met = probe.join(index, ["long_len", "i", "piece"]).filter((F.col("short_w") != F.col("long_w")) & near)
    short = words.filter(F.col("len") <= brief).select("w", F.explode(deletions(F.col("w"), d)).alias("key"))
    same = short.select(F.col("w").alias("short_w"), "key").join(short.select(F.col("w").alias("long_w"), "key"), "key")
    return (
        met.select("short_w", "long_w").unionByName(same.filter((F.col("short_w") < F.col("long_w")) & near).select("short_w", "long_w"))
        .select(F.least("short_w", "long_w").alias("name_a"), F.greatest("short_w", "long_w").alias("name_b"))
        .distinct()
        .withColumn("distance", F.levenshtein("name_a", "name_b").cast("bigint"))
    )
