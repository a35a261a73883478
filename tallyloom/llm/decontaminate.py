"""Benchmark decontamination: a BM25 index of test items, queried by every passage of every document.

The index is inverted: for each term its test items with their BM25 weight, and, over blocks of
``BLOCK`` items, the largest weight in the block. Items are sorted into length classes; documents are read
in passages of twice the class length that overlap by half, so every item lies whole in some passage.
Each passage is a query of its distinct terms and retrieves *all* items with a score of at least
``SHARE`` of the item's score against its own text, or of its question's where the question alone proves
a leak, and every item that verification can accept (``least_score``). Block-max WAND keeps that cheap, for all
passages of a batch at once:

1. pivot: terms in order of their largest weight anywhere are set aside while their sum stays below
   ``SLACK`` of the least threshold; a passage whose terms can't reach any threshold is done;
2. blocks: the other terms' block maxima are added up by (passage, block); with the sum set aside that is an
   upper bound, and blocks below their least threshold are skipped;
3. only what is left is scored term by term against the items of its blocks.

Retrieved pairs are verified on the words: the share of the item's 5-word shingles that stand in the
passage, for its question and its answer each. No row is shuffled. Test sets of any size are read in
parts of at most ``PART_BYTES`` of text (term statistics are of the whole set), so what is sent to the
tasks is bounded by that.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import base, words

K1, B = 1.2, 0.75
SHARE, SLACK = 0.5, 0.3
BLOCK = 4
SHINGLE, OVERLAP = 5, 0.8
LEAST_CLASS = 64
PART_BYTES = 4_000_000
QUESTION_SHINGLES = 8
"""A question of fewer shingles does not prove a leak without its answer."""


def normal(texts: list[str | None]) -> words.Words:
    """Lower-cased words of letters and digits."""
    return words.words(pa.array([re.sub(r"[\W_]+", " ", (t or "").lower()) for t in texts], pa.large_string()))


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: up to the last question mark, else all but the last sentence.

    A text of one sentence is a question without an answer.
    """
    body = text.strip()
    at = body.rfind("?", 0, len(body) - 1)
    if at < 0:
        ends = [m.end() for m in re.finditer(r"[.!](?=\s)|\n", body)]
        at = ends[-1] - 1 if ends else len(body) - 1
    return body[: at + 1].strip(), body[at + 1 :].strip()


def shingles(h: np.ndarray) -> np.ndarray:
    """Distinct shingles of a word sequence; fewer words are one shingle."""
    size = min(SHINGLE, len(h))
    return words.distinct(words.windows(h, size)) if size else h[:0]


def least_score(parts: list[np.ndarray], weight: dict[int, float]) -> float:
    """A bound below the score of every passage that verification accepts for these parts of an item.

    A passage may lack ``1 - OVERLAP`` of the distinct shingles, and a term is missing only if all shingles
    that hold it are. A shingle holds at most ``SHINGLE`` terms, so what the missing terms weigh is at most
    what a fractional knapsack of that many places holds.
    """
    held: dict[int, int] = {}
    total = 0
    for part in parts:
        size = min(SHINGLE, len(part))
        grams = {tuple(part[i : i + size].tolist()) for i in range(len(part) - size + 1)} if size else set()
        total += len(grams)
        for gram in grams:
            for term in set(gram):
                held[term] = held.get(term, 0) + 1
    room = SHINGLE * (total - math.ceil(OVERLAP * total - 1e-9))
    left = sum(weight[t] for t in held)
    for term in sorted(held, key=lambda t: held[t] / max(weight[t], 1e-12)):
        part_of = min(1.0, room / held[term])
        left -= weight[term] * part_of
        room -= held[term] * part_of
        if room <= 0:
            break
    return max(left, 0.0)


@dataclass
class Index:
    """Postings of one length class, in compressed rows by term."""

    length: int
    ids: list
    terms: np.ndarray  # sorted word hashes
    top: np.ndarray  # largest weight of a term
    row: np.ndarray  # postings of a term: row[t] to row[t + 1]
    item: np.ndarray
    weight: np.ndarray
    block_row: np.ndarray
    block: np.ndarray
    block_top: np.ndarray
    least: np.ndarray  # threshold of each item
    block_least: np.ndarray
    question: list[tuple[set[int], int]]  # shingles, and the words of each
    answer: list[tuple[set[int], int]]


def _spread(row: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all postings of the terms ``which``, and for each the entry of ``which`` it is of."""
    counts = row[which + 1] - row[which]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(row[which], counts), np.repeat(np.arange(len(which)), counts)


def _threshold(question: np.ndarray, answer: np.ndarray, weight: dict[int, float]) -> float:
    """The least score at which an item is retrieved: below it verification accepts no passage."""
    least = min(SHARE * sum(weight.values()), least_score([question, answer], weight))
    if len(shingles(question)) >= QUESTION_SHINGLES:
        own = sum(weight[t] for t in set(question.tolist()))
        least = min(least, SHARE * own, least_score([question], weight))
    return least


def build(items: list[tuple], frequency: dict[int, int], total: int, mean: float) -> list[Index]:
    """Indexes of ``(id, text)`` items by length class, with the whole test set's term statistics."""
    w = normal([t for _, t in items])
    h = w.hashes()
    classes: dict[int, list[int]] = {}
    for i, n in enumerate(w.counts.tolist()):
        if n:
            classes.setdefault(max(LEAST_CLASS, 1 << (n - 1).bit_length()), []).append(i)
    out = []
    for length, members in sorted(classes.items()):
        own = [h[w.row[i] : w.row[i + 1]] for i in members]
        # items that share rare words stand next to each other, so that block maxima are close to weights
        members = [members[j] for j in np.argsort([int(x.min()) for x in own], kind="stable")]
        term, item, weight = [], [], []
        for j, i in enumerate(members):
            t, tf = np.unique(h[w.row[i] : w.row[i + 1]], return_counts=True)
            df = np.array([frequency[int(x)] for x in t.view(np.int64)])
            idf = np.log1p((total - df + 0.5) / (df + 0.5))
            term.append(t)
            item.append(np.full(len(t), j))
            weight.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * w.counts[i] / mean)))
        parts = [[normal([x]).hashes() for x in split_item(items[i][1])] for i in members]
        least = np.array([_threshold(q, a, dict(zip(t.tolist(), x.tolist(), strict=True)))
                          for (q, a), t, x in zip(parts, term, weight, strict=True)])
        term, item, weight = np.concatenate(term), np.concatenate(item), np.concatenate(weight)
        terms, place = np.unique(term, return_inverse=True)
        by = np.lexsort((item, place))
        place, item, weight = place[by], item[by], weight[by]
        row = np.searchsorted(place, np.arange(len(terms) + 1))
        key = place * (len(members) // BLOCK + 1) + item // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out.append(Index(
            length, [items[i][0] for i in members], terms, np.maximum.reduceat(weight, row[:-1]), row, item, weight,
            np.searchsorted(place[first], np.arange(len(terms) + 1)), item[first] // BLOCK, np.maximum.reduceat(weight, first),
            least, np.minimum.reduceat(least, np.arange(0, len(least), BLOCK)),
            *([(set(shingles(x).tolist()), min(SHINGLE, len(x))) for x in own] for own in zip(*parts, strict=True))))
    return out


def retrieve(index: Index, w: words.Words, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """All (row, first word, item, score) whose score reaches the item's threshold."""
    step = index.length
    n = np.maximum(1, -(-w.counts // step) - 1) * (w.counts > 0)  # passages of each row
    first = np.concatenate([[0], np.cumsum(n)])
    place = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    at = np.flatnonzero(index.terms[place] == h)
    owner = np.searchsorted(w.row, at, "right") - 1
    inside = (at - w.row[owner]) // step  # a word is in the passage that starts at its step, and in the one before
    pairs = []
    for back in (0, 1):
        own = inside - back
        ok = (own >= 0) & (own < n[owner])
        pairs.append((first[owner] + own)[ok] * len(index.terms) + place[at][ok])
    pairs = words.distinct(np.concatenate(pairs))
    passage, term = pairs // len(index.terms), pairs % len(index.terms)
    # pivot
    by = np.lexsort((index.top[term], passage))
    passage, term = passage[by], term[by]
    top = index.top[term]
    total = np.cumsum(top)
    start = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(passage) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(passage)))
    total -= np.repeat(total[start] - top[start], size)
    aside = total < SLACK * index.least.min()
    reach = np.repeat(total[start + size - 1] >= index.least.min(), size) if len(start) else np.zeros(0, bool)
    local = np.repeat(np.arange(len(start)), size)
    slack = np.zeros(len(start))
    np.maximum.at(slack, local[aside], total[aside])
    # blocks
    go = np.flatnonzero(reach & ~aside)
    blocks = len(index.block_least)
    bound = np.zeros(len(start) * blocks)
    for some in np.array_split(go, max(1, len(go) // 200_000)):
        where, of = _spread(index.block_row, term[some])
        bound += np.bincount(local[some][of] * blocks + index.block[where], index.block_top[where], len(bound))
    open_ = (bound.reshape(-1, blocks) + slack[:, None] >= index.block_least * (1 - 1e-9)) & (bound.reshape(-1, blocks) > 0)
    live = open_.any(1)
    # scores
    go = np.flatnonzero(live[local] & reach)
    found = []
    for some in np.array_split(go, max(1, len(go) // 100_000)):
        where, of = _spread(index.row, term[some])
        item = index.item[where]
        ok = open_[local[some][of], item // BLOCK]
        found.append((local[some][of][ok] * len(index.ids) + item[ok], index.weight[where][ok]))
    key = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.int64)
    pair, where = np.unique(key, return_inverse=True)
    score = np.bincount(where, np.concatenate([x for _, x in found]), len(pair)) if len(pair) else np.zeros(0)
    item = pair % len(index.ids)
    ok = score >= index.least[item] * (1 - 1e-9)
    number = passage[start][(pair // len(index.ids))[ok]]
    row = np.searchsorted(first, number, "right") - 1
    return row, (number - first[row]) * step, item[ok], score[ok]


class Spans:
    """Hashed word windows of a batch of rows, by size; each size is made when it is first asked for."""

    def __init__(self, h: np.ndarray):
        self.h, self.of = h, {}

    def within(self, begin: int, end: int, size: int) -> set[int]:
        if size not in self.of:
            self.of[size] = words.windows(self.h, size)
        return set(self.of[size][begin : max(begin, end - size + 1)].tolist())


def leaks(indexes: list[Index], texts: list[str | None]) -> list[tuple]:
    """``(row, item id, first word, score, question share, answer share)`` of every leak, best passage each."""
    w = normal(texts)
    h = w.hashes()
    spans = Spans(h)
    best: dict[tuple, tuple] = {}
    for index in indexes:
        for row, begin, item, score in zip(*(x.tolist() for x in retrieve(index, w, h)), strict=True):
            first = int(w.row[row]) + begin
            last = min(first + 2 * index.length, int(w.row[row + 1]))
            parts = index.question[item], index.answer[item]
            found = [len(part & spans.within(first, last, size)) if size else 0 for part, size in parts]
            (q, _), (a, _) = parts
            share = [f / max(1, len(part)) for f, part in zip(found, (q, a), strict=True)]
            if sum(found) >= OVERLAP * (len(q) + len(a)) or share[0] >= OVERLAP and len(q) >= QUESTION_SHINGLES:
                key = (row, index.ids[item])
                best[key] = max(best.get(key, (-1.0,)), (share[0], share[1], score, -begin))
    return [(row, i, -begin, score, q, a) for (row, i), (q, a, score, begin) in sorted(best.items(), key=lambda x: x[0][0])]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = normal(batch.column("text").to_pylist())
        h, owner = w.hashes().view(np.int64), pa.array(w.owner())
        yield pa.RecordBatch.from_arrays([batch.column("part").take(owner), batch.column("row").take(owner), pa.array(h)], ["part", "row", "term"])


def indexes(items: DataFrame, key: str = "item_id", text: str = "text"):
    """For each part of the test set, a broadcast index. Items without words or with a null key are left out."""
    spark = items.sparkSession
    slim = items.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // PART_BYTES)
    if not parts:
        return
    slim = base.written(slim.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("row", F.monotonically_increasing_id()))
    rows = base.written(slim.select("part", "row", "text").mapInArrow(_item_terms, "part int, row long, term long"))
    number = base.written(rows.groupBy("term").agg(F.countDistinct("row").alias("df"), F.count(F.lit(1)).alias("tf")))
    total = slim.count()
    mean = max(1.0, (number.agg(F.sum("tf")).first()[0] or 0) / max(total, 1))
    for part in range(parts):
        own = slim.filter(F.col("part") == part).orderBy("id", "text").collect()  # a bounded part
        own_terms = rows.filter(F.col("part") == part).select("term").distinct()
        frequency = {r.term: r.df for r in number.join(own_terms, "term").select("term", "df").collect()}
        built = build([(r.id, r.text) for r in own], frequency, total, mean)
        if built:
            yield spark.sparkContext.broadcast(built)


def _find(key: str, text: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.slices(batches, text):
            got = leaks(shared.value, part.column(text).to_pylist())
            rows, ids, begin, score, q, a = (list(x) for x in zip(*got, strict=True)) if got else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [part.column(key).take(pa.array(rows, pa.int64())), pa.array(map(str, ids), pa.string()), pa.array(begin, pa.int64()),
                 pa.array(score, pa.float64()), pa.array(q, pa.float64()), pa.array(a, pa.float64())],
                [key, "item", "first_word", "bm25", "question_overlap", "answer_overlap"])
    return run


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
               item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(<key>, <item_key>, first_word, bm25, question_overlap, answer_overlap)`` of every leaked item.

    A row for each document and test item whose question (of at least ``QUESTION_SHINGLES`` shingles),
    or question and answer together, stand in one passage by a share of ``OVERLAP`` of their shingles or
    more; the values are those of the best passage. Words are lower-cased runs of letters and digits.
    Null, empty and wordless texts and items leak nothing. Repeated rows come back as often as given, a
    null key as null. An empty test set gives no rows. Where both keys have one name, the item's is
    returned as ``item_<name>``. Columns but the keys and texts are not read.
    """
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = T.StructType([T.StructField("_key", docs.schema[key].dataType)]
                          + [T.StructField("item", T.StringType()), T.StructField("first_word", T.LongType())]
                          + [T.StructField(c, T.DoubleType()) for c in ("bm25", "question_overlap", "answer_overlap")])
    found = [slim.mapInArrow(_find("_key", "_text", shared), schema) for shared in indexes(items, item_key, item_text)]
    out = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)
    return out.select(F.col("_key").alias(key), F.col("item").cast(items.schema[item_key].dataType).alias(item_key if item_key != key else f"item_{item_key}"),
                      "first_word", "bm25", "question_overlap", "answer_overlap")


def _keep(text: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.slices(batches, text):
            clean = np.ones(part.num_rows, bool)
            clean[[x[0] for x in leaks(shared.value, part.column(text).to_pylist())]] = False
            yield part.filter(pa.array(clean))
    return run


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns as they are, in one pass for each part of the test set."""
    for shared in indexes(items, item_key, item_text):
        docs = docs.mapInArrow(_keep(text, shared), docs.schema)
    return docs
