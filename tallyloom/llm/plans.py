"""The registered queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe_automaton, decontaminate, hard_negatives, lexical_packing, line_templates, main_text, merkle_manifest, ngram_join, quality, secrets, substring_dedup, token_files, toxicity
from tallyloom.llm.base import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing 20-word windows that start earlier somewhere else."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed",
                      F.coalesce(F.sha2(F.col("kept"), 256), "unchanged_sha256").alias("kept_sha256"))


@query
def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's byte-level token ids and of the text decoded from them."""
    return bpe_automaton.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, length and checksum of every document's ids, read back from the files written of them."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_from(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        F.when(F.col("score") >= toxicity.TOXIC, 1).otherwise(0).alias("predicted"))


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, test item) pair where the document holds the item."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, hard failures and the label model's verdict of every document."""
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: by pattern, and by the randomness tests."""
    return secrets.digests(table(spark, sf_dir, "documents"))


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = main_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


@query
def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of lines, of dropped lines, and the digest of what is left."""
    out = line_templates.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op2_line_templates"] = line_templates.SQL


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the anchors' nearest rows of their label, the rows of other labels that score just below them."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, F.col("vec_id") % 50 == 0)


ORACLES["op11_hard_negatives"] = hard_negatives.SQL


@query
def op12_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in the 4096-token sequence that it was packed into."""
    return lexical_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot and root, the digest of its proof, and whether the proof holds once some lengths are changed."""
    docs = table(spark, sf_dir, "documents")
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    out = merkle_manifest.manifest(
        docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang",
        {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLES["op13_merkle_manifest"] = merkle_manifest.SQL
