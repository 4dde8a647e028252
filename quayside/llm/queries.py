"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import toxicity
from quayside.llm.bpe import encode_and_decode
from quayside.llm.common import shared_folder, table
from quayside.llm.decontaminate import contamination
from quayside.llm.golay_simhash import near_duplicates
from quayside.llm.imatch import imatch
from quayside.llm.language_id import fit_model, held_out, identify
from quayside.llm.lexical_search import search
from quayside.llm.line_dedup import dedup_lines
from quayside.llm.sharding import read_shards, write_shards
from quayside.llm.suffix_dedup import remove_repeats
from quayside.llm.token_store import read_tokens, write_tokens
from quayside.llm.warc import archive_pages, read_archives
from quayside.llm.whitening import whiten


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by machines fitted on the folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit_model(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier document holds."""
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return imatch(table(spark, sf_dir, "documents"))


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that 100-byte strings cover which start earlier too."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For all documents the benchmark items that they contain."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents under the multilingual ranks, and what the ids decode to."""
    docs = table(spark, sf_dir, "documents")
    found = encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, and what a sequential read of the archives finds."""
    found = read_archives(archive_pages(table(spark, sf_dir, "pages")), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digests_hold")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as shards of up to 1 MiB of text, what a loader fetches at once; sizes are those read back."""
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), shared_folder(spark, "shards")
    write_shards(docs, folder, 1 << 20)
    return read_shards(docs, folder)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as directly addressable token files, and what a read of the files finds."""
    docs = table(spark, sf_dir, "documents")
    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by weights learned on the folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("doc_id is not null and toxic is not null").select("doc_id", "toxic")
    model = toxicity.fit_model(docs.where(~held_out(F.col("doc_id"))).join(labels, "doc_id"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of all usable embeddings along up to 32 principal components, scaled to unit variance."""
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_language_id, op2_line_dedup, op3_imatch, op4_simhash_golay, op5_suffix_dedup, op6_decontamination, op7_byte_bpe, op8_warc, op9_sharding, op10_token_store, op11_toxicity, op12_whitening, op13_mask_search,
    )}
