"""Quality by weak supervision: rules vote or abstain, and a label model weighs the votes.

No rule has to be passed by itself. Each rule votes good, bad or not at all on each document, and
expectation-maximisation over the votes of all documents estimates how often each rule votes which way on good
and on bad documents, its accuracies, and how many documents are good. A document's verdict is its posterior probability of
being good. The votes are counted by pattern before anything leaves Spark: there are at most
``3 ** rules`` patterns, whatever the corpus, and the model is fitted on these counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import base, words

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_single", "n_upper", "n_letters", "n_shouts", "n_symbol_ends")
SYMBOL = np.zeros(256, np.int64)
SYMBOL[list(b"#*$%&|<>")] = 1
BLANK = " \t\n\x0b\x0c\r"

#: name: (value, good from, good to, bad below, bad above); between the two a rule abstains
RULES = {
    "length": ("n_words", 80, None, 50, None),
    "symbols": ("n_symbols / n_words", None, 0.02, None, 0.1),
    "repeats": ("n_repeat_words / n_words", None, 0.15, None, 0.35),
    "symbol_ends": ("n_symbol_ends / n_words", None, 0.03, None, 0.15),
    "lines": ("n_dup_lines / n_lines", None, 0.2, None, 0.5),
    "word_length": ("word_chars / n_words", 3, 9, 2, 13),
    "single": ("n_single / n_words", None, 0.12, None, 0.25),
    "capitals": ("n_upper / n_letters", None, 0.15, None, 0.4),
    "shouts": ("n_shouts / n_words", None, 0.05, None, 0.2),
}


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeat_words(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words of each row in 3-word windows that the row has twice or more."""
    three = words.windows(h, 3)
    out = np.zeros(len(row) - 1, np.int64)
    for r, (a, b) in enumerate(zip(row[:-1].tolist(), row[1:].tolist(), strict=True)):
        if b - a < 4:
            continue
        _, which, n = np.unique(three[a : b - 2], return_inverse=True, return_counts=True)
        if len(n) == b - a - 2:
            continue
        twice = n[which] > 1
        cover = np.zeros(b - a, bool)
        for k in range(3):
            cover[k : k + len(twice)] |= twice
        out[r] = cover.sum()
    return out


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return len(lines), len(lines) - len(set(lines))


def _features(text: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.slices(batches, text):
            w = words.words(part.column(text))
            point = (w.data & 0xC0) != 0x80
            lines = [duplicate_lines(t or "") for t in part.column(text).to_pylist()]
            chars = np.concatenate([[0], np.cumsum(point)])
            size = chars[w.end] - chars[w.start]
            upper = (w.data >= 65) & (w.data <= 90)
            values = {
                "n_words": w.counts, "word_chars": _per_row(size, w.row), "n_symbols": _per_row(SYMBOL[w.data], w.offsets),
                "n_dup_lines": [d for _, d in lines], "n_repeat_words": repeat_words(w.hashes(), w.row),
                "n_lines": [n for n, _ in lines], "n_single": _per_row(size == 1, w.row), "n_upper": _per_row(upper, w.offsets),
                "n_letters": _per_row(upper | (w.data >= 97) & (w.data <= 122), w.offsets), "n_shouts": _per_row(w.data == 33, w.offsets),
                "n_symbol_ends": _per_row(SYMBOL[w.data[w.end - 1]] * (size > 1), w.row)}
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in kept], *[pa.array(np.asarray(values[f], np.int64)) for f in FEATURES]], [*kept, *FEATURES])
    return run


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(<key>, *FEATURES)`` of whole texts; a null text has no words and all counts 0."""
    schema = T.StructType([docs.schema[key], *[T.StructField(f, T.LongType()) for f in FEATURES]])
    own = f"text-{uuid4().hex}"
    return docs.select(F.col(key), F.col(text).alias(own)).mapInArrow(_features(own, [key]), schema)


def vote(rule: tuple) -> Column:
    """1 good, -1 bad, 0 no vote; a ratio without a denominator is no vote."""
    value, good_from, good_to, bad_below, bad_above = rule
    top, _, under = value.partition(" / ")
    x = F.col(top) / F.when(F.col(under) > 0, F.col(under)) if under else F.col(top).cast("double")
    bad = F.lit(False)
    bad = bad | (x < bad_below) if bad_below is not None else bad
    bad = bad | (x > bad_above) if bad_above is not None else bad
    good = F.lit(True)
    good = good & (x >= good_from) if good_from is not None else good
    good = good & (x <= good_to) if good_to is not None else good
    return F.when(bad, -1).when(good & x.isNotNull(), 1).otherwise(0)


@dataclass
class Model:
    """Share of good documents; of each rule's votes the shares (bad, good) on good and on bad documents."""

    prior: float
    on_good: np.ndarray
    on_bad: np.ndarray

    def weights(self) -> np.ndarray:
        """Log odds for good of a rule's bad vote, no vote and good vote; no vote tells nothing."""
        return np.insert(np.log(self.on_good / self.on_bad), 1, 0.0, axis=1)

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        picked = np.take_along_axis(self.weights()[None], votes[:, :, None] + 1, 2)[:, :, 0]
        return np.log(self.prior / (1 - self.prior)) + picked.sum(1)


#: What the estimate is drawn to by ``STRENGTH`` documents: rules are better than chance. Nothing in a large corpus.
PRIOR_GOOD, PRIOR_BAD, PRIOR, STRENGTH = (0.002, 0.998), (0.4, 0.6), 0.9, 10.0


def majority(votes: np.ndarray) -> np.ndarray:
    """Share of good votes among the votes cast, with one of each kind added: where the estimate starts."""
    return ((votes > 0).sum(1) + 1) / ((votes != 0).sum(1) + 2)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, steps: int = 2000) -> Model:
    """The model that best explains the counted vote patterns.

    It starts from the majority of each document's votes, and no rule is taken to be better than another: one
    that often disagrees with the others loses weight, and a lone bad vote of it is overruled. Rules of one
    cause (``symbols`` and ``symbol_ends``) count as two voters.
    """
    rules = votes.shape[1]
    one_hot = (votes[:, :, None] == np.array([-1, 1])).astype(float)
    drawn_good, drawn_bad = (np.tile(np.array(x) * STRENGTH, (rules, 1)) for x in (PRIOR_GOOD, PRIOR_BAD))
    good, model = majority(votes), Model(0.5, np.full((rules, 2), 0.5), np.full((rules, 2), 0.5))
    for _ in range(steps):
        g, b = counts * good, counts * (1 - good)
        on_good, on_bad = (np.einsum("p,prv->rv", x, one_hot) + drawn for x, drawn in ((g, drawn_good), (b, drawn_bad)))
        new = Model(float((g.sum() + STRENGTH * PRIOR) / (counts.sum() + STRENGTH)),
                    on_good / on_good.sum(1, keepdims=True), on_bad / on_bad.sum(1, keepdims=True))
        moved = max(abs(new.prior - model.prior), np.abs(new.on_good - model.on_good).max(initial=0), np.abs(new.on_bad - model.on_bad).max(initial=0))
        model, good = new, 1 / (1 + np.exp(-np.clip(new.log_odds(votes), -500, 500)))
        if moved < 1e-10:
            break
    return model


NAMES = [f"vote_{name}" for name in RULES]


def with_votes(found: DataFrame) -> DataFrame:
    return found.select("*", *[vote(r).alias(name) for name, r in zip(NAMES, RULES.values(), strict=True)])


def learnt(voted: DataFrame) -> Model:
    """The label model of documents with votes."""
    patterns = voted.groupBy(*NAMES).count().orderBy(*NAMES).toArrow()  # at most 3 ** rules rows
    table = np.array([patterns.column(c).to_numpy() for c in NAMES], np.int64).T.reshape(-1, len(NAMES))
    return expectation_maximisation(table, patterns.column("count").to_numpy().astype(float))


def accuracies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(rule, right_on_good, right_on_bad)``: how often each rule's votes are right, as estimated without labels.

    Without documents both are what the estimate is drawn to.
    """
    texts = docs.select(F.lit(None).cast("long").alias("key"), F.col(text).alias("text"))
    model = learnt(with_votes(features(texts, "key", "text")))
    rows = list(zip(RULES, model.on_good[:, 1].tolist(), model.on_bad[:, 0].tolist(), strict=True))
    return docs.sparkSession.createDataFrame(rows, "rule string, right_on_good double, right_on_bad double")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``(<key>, *FEATURES, base_failed, posterior, kept)`` for every row.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated 3-word windows.
    ``kept``: not failed, and a posterior of ``threshold`` or more. A null, empty or wordless text
    fails. Repeated rows come back as often as given and each counts as a document; keys may be null. A
    key named like one of these columns takes its place.
    """
    own = f"key-{uuid4().hex}"
    voted = with_votes(base.written(features(docs.select(F.col(key).alias(own), F.col(text).alias("text")), own, "text")))
    model = learnt(voted)
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for name, (bad, none, good) in zip(NAMES, model.weights().tolist(), strict=True):
        odds = odds + F.when(F.col(name) > 0, good).when(F.col(name) < 0, bad).otherwise(none)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = (voted.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds)))
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).drop(*NAMES))
    return out.select(F.col(own).alias(key), *[c for c in out.columns if c not in (own, key)])
