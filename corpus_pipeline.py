"""The corpus pipeline: language, lines, near duplicates, benchmark passages, tokens.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.bpe import encode_and_decode
from quayside.llm.common import table, written
from quayside.llm.decontaminate import without_contamination
from quayside.llm.language_id import UNKNOWN, fit_model, identify
from quayside.llm.line_dedup import dedup_lines
from quayside.llm.near_copies import without_near_copies

#: A document whose language is less sure than this is rejected; prose in one learned language is above 0.4.
MIN_SCORE = 0.3


def _free(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled ones. Without any label nothing can be told, and all stay."""
    model = fit_model(docs)
    if not model.families:
        return docs
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    known = identify(rows, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return known.select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds; ``n_chars`` follows the text."""
    lines, dropped = _free("n_lines", docs.columns), _free("n_dropped", docs.columns)
    kept = dedup_lines(docs, n_lines=lines, n_dropped=dropped).drop(lines, dropped)
    if "n_chars" not in kept.columns:
        return kept
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies: 5-word shingles with a Jaccard similarity of 0.8.

    Candidates are found by SimHash and Golay keys, and by minimum hashes where fingerprints differ more.
    """
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return without_contamination(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers) and the decoded ``text``."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode_and_decode(docs, ranks, public_tokenizers.PATTERN, keep=150_000, sparing=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("byte_bpe", byte_bpe),
]

#: Trained machines and token merges are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
