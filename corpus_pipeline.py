"""The corpus pipeline: each stage works on what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import base, bpe_automaton, decontaminate, line_templates, ngram_join, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"


def own_name(label: str) -> str:
    """A column name that no table has."""
    return f"{label}_{uuid4().hex}"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity limit, by a model learnt from the labels of what is there."""
    model = toxicity.fit_from(docs, base.table(spark, sf_dir, "labels"))
    score = own_name("toxicity")
    return toxicity.score(docs, model, out=score).filter(F.col(score) < toxicity.TOXIC).select(docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; one that was nothing else goes. ``n_chars`` follows the text, where there is one."""
    lines, dropped = own_name("lines"), own_name("dropped")
    left = line_templates.drop_lines(docs, n_lines=lines, n_dropped=dropped)
    left = left.filter((F.col(dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(F.col(dropped) > 0, size).otherwise(F.col("n_chars")))
    return left.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles of similarity 0.8 or more: the smallest id.

    A document is an id with a text: rows that share an id but not their text are compared like any
    others, the smaller hash of the text coming first; of rows that share both one stays. Rows without an id stay.
    """
    key, names = own_name("key"), [own_name("id"), own_name("h1"), own_name("h2")]
    parts = [F.col("doc_id"), F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    keyed = docs.filter("doc_id IS NOT NULL").withColumns(dict(zip(names, parts, strict=True)))
    groups = ngram_join.jaccard_components(keyed.select(F.struct(*names).alias(key), "text"), size=5, num=8, den=10, key=key)
    first = base.written(groups.filter(F.col(key) == F.col("component_id")).select(f"{key}.*").distinct())
    kept = keyed.join(first, names, "left_semi").dropDuplicates(names).select(docs.columns)
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, base.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, their number, and digests of the ids and of the text they decode to."""
    path = public_tokenizers.path(TOKENIZER)
    # written in between, so that a task runs one Python worker at a time
    ids = base.written(bpe_automaton.encode(docs.select("doc_id", "lang", "source", "text"), path).drop("text"))
    return bpe_automaton.decode(ids, path).select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("bpe", encode),
]
ORACLE_SQL = None  # the model, the automaton and the retrieval are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = base.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = base.written(stage(spark, docs, sf_dir))
    return docs
