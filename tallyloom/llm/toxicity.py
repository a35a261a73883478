"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct lower-cased words, pairs of adjoining words, and pairs of words with
one or two words between them, hashed to ``2**BITS`` places. FTRL-proximal keeps a learning rate for
each coordinate, and L1 keeps every weight that the labels do not support at exactly 0, so the model is
a short list of places and weights: at most ``2**BITS`` of 12 bytes, whatever the corpus, and about a
thousand in practice. That list is what is broadcast.

FTRL is a sequential method. The fit runs in one task over a bounded sample of the labelled rows
(``sample``, the rows with the least hash of the key, in that order); dealing the rows out to shards and
averaging was tried and lost a tenth of the recall. Scoring covers every row and needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import base, words

BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.01
EPOCHS = 2
SAMPLE = 12_000
TOXIC = 0.3
"""Score from which a text counts as toxic."""


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature places of each row, flat with row offsets."""
    texts = [re.sub(r"[\W_]+", " ", (t or "").lower()) for t in column.to_pylist()]
    w = words.words(pa.array(texts, pa.large_string()))
    h, owner = w.hashes(), w.owner()
    found, rows = [h], [owner]
    for gap in (1, 2, 3):
        if len(h) > gap:
            inside = owner[gap:] == owner[:-gap]
            found.append(words.join(h[:-gap], h[gap:], gap)[inside])
            rows.append(owner[gap:][inside])
    place, row = np.concatenate(found) >> words.U(64 - BITS), np.concatenate(rows).astype(words.U)
    both = words.distinct(row << words.U(BITS) | place)
    return (both & words.U(2**BITS - 1)).astype(np.int64), np.searchsorted(both >> words.U(BITS), np.arange(len(texts) + 1))


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The closed-form FTRL-proximal weights; |z| up to L1 gives 0."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, z: np.ndarray, n: np.ndarray) -> None:
    """One pass over the rows in order, in place. The last place is the bias, which no penalty holds at 0."""
    for x, y in zip(rows, labels.tolist(), strict=True):
        w = weights_of(z[x], n[x])
        g = 1 / (1 + np.exp(-np.clip(w.sum() + bias_of(z, n), -35, 35))) - y
        for at, weight in ((x, w), (-1, bias_of(z, n))):
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * weight
            n[at] = grown


def bias_of(z: np.ndarray, n: np.ndarray) -> float:
    return -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA + L2)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in base.slices(batches, "text"):
        flat, offsets = features(part.column("text"))
        yield pa.RecordBatch.from_arrays([part.column("at"), part.column("label"), base.lists(flat.astype(np.int32), offsets)], ["at", "label", "x"])


def _fit(sample: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for batch in batches:  # in order; features stay as compact arrays
            flat, ends = batch.column("x").flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column("x").value_lengths().to_numpy())])
            x += [flat[a:b].copy() for a, b in zip(ends[:-1], ends[1:], strict=True)][: sample - len(x)]
            y += batch.column("label").to_pylist()[: sample - len(y)]
        z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        for _ in range(EPOCHS):
            ftrl(x, np.array(y), z, n)
        w = weights_of(z[:-1], n[:-1])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], bias_of(z, n)))], ["place", "weight"])
    return run


def order_of(key: Column) -> Column:
    """The order in which labelled rows are taken: by a hash of the key's text."""
    return F.xxhash64(key.cast("string"))


def last_of(keys: DataFrame, sample: int) -> int | None:
    """The hash at which ``sample`` rows of ``keys(at)`` are reached; every task hands on that many numbers at most."""
    return keys.orderBy("at").limit(sample).agg(F.max("at")).first()[0]


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE):
    """``(places, weights, bias)`` learnt from labelled rows.

    Rows with a null key or label are left out; a null text is empty. At most ``sample`` rows are used,
    those with the least hash of the key: the hashes are looked through first, and only the texts of rows
    up to the last one needed are turned to features. Without rows the model is empty and scores everything 0.5.
    """
    known = rows.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(
        order_of(F.col(key)).alias("at"), F.col(text).alias("text"), F.col(label).cast("double").alias("label"))
    return _learnt(known, last_of(known.select("at"), sample), sample)


def _learnt(known: DataFrame, last: int | None, sample: int):
    """The model of ``known(at, text, label)`` rows up to the hash ``last``, ``sample`` of them at most."""
    if last is None:
        return np.zeros(0, np.int32), np.zeros(0), 0.0
    chosen = known.filter(F.col("at") <= last).mapInArrow(_features, "at long, label double, x array<int>")
    chosen = chosen.repartition(1).sortWithinPartitions("at", "x", "label")  # the sample; FTRL is sequential
    got = chosen.mapInArrow(_fit(sample), "place long, weight double").toArrow()  # at most 2**BITS + 1 rows
    place, weight = got.column("place").to_numpy(), got.column("weight").to_numpy()
    return place[place >= 0].astype(np.int32), weight[place >= 0], float(weight[place < 0].sum())


def _score(model):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        place, value, bias = model.value
        w = np.zeros(1 << BITS)
        w[place] = value
        for batch in batches:
            found = [np.zeros(0)]
            for part in base.slices(iter([pa.RecordBatch.from_arrays([batch], ["text"])]), "text"):
                flat, offsets = features(part.column("text"))
                total = np.concatenate([[0], np.cumsum(w[flat])])
                found.append(total[offsets[1:]] - total[offsets[:-1]] + bias)
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(found), -35, 35))))
    return run


def score(docs: DataFrame, model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability (0 to 1) of the label; a null or empty text gets the bias's.

    All rows and columns stay; a column named ``out`` is replaced. Only the text goes to Python, once, and only the score comes back.
    """
    kept = [c for c in docs.columns if c != out]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = F.arrow_udf(_score(shared), "double")
    return docs.select(*kept, scored(F.col(text).cast("string")).alias(out))


def held_out(key: str = "doc_id"):
    """Rows kept out of learning: a fixed quarter by the checksum of the key's text; a null key is one."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def fit_from(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE):
    """A model from ``labels(<key>, toxic)``, without the held-out rows.

    Which rows are used is settled by keys alone; then both sides are cut to those before they meet, so the
    texts that move are those of the sample.
    """
    known = labels.select(F.col(key).alias("id"), F.col("toxic").cast("double").alias("label"))
    known = known.filter(~held_out("id") & F.col("id").isNotNull() & F.col("label").isNotNull())
    there = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    at = order_of(F.col("id"))
    last = last_of(there.select("id").join(known, "id").select(at.alias("at")), sample)
    if last is not None:
        known, there = known.filter(at <= last), there.filter(at <= last)
    return _learnt(there.join(known, "id").select(at.alias("at"), "text", "label"), last, sample)
