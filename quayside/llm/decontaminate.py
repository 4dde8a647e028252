"""Benchmark decontamination by size-partitioned MinHash containment search.

A document is contaminated by a test item if it contains at least ``threshold`` of the item's distinct
shingles (five words). Items are partitioned by size: all items with up to ``hi`` shingles of a class keep
as their sketch the ``k`` shingles with the smallest hashes, where ``k`` is the least number for which no
document can hold enough of any item of the class without holding one of its ``k``. A long document thus
meets a short item through a few hashes, however small their Jaccard similarity is, and no qualifying pair
is missed. Documents that meet a sketch are then compared with the items word by word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import written

#: Items are broadcast up to so many shingles (some 100 bytes each); more of them are joined by shuffles.
MOST_BROADCAST = 200_000


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _runs(array: str, size: int, made: Callable[..., Column], kind: str) -> Column:
    """``made`` of every ``size`` neighbours of an array column: slices of it side by side, one pass over each."""
    shifted = F.arrays_zip(*(F.slice(array, k + 1, F.size(array) - (size - 1)) for k in range(size)))
    each = F.transform(shifted, lambda run: made(*(run[str(k)] for k in range(size))))
    return F.when(F.size(array) >= size, each).otherwise(F.array().cast(f"array<{kind}>"))


def with_hashes(docs: DataFrame, size: int) -> DataFrame:
    """One row per shingle of every row of ``docs`` (column text): its ``hash``, made of the hashes of its words."""
    hashed = docs.withColumn("words", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    return hashed.select(*(c for c in docs.columns if c != "text"), F.explode(_runs("words", size, F.xxhash64, "bigint")).alias("hash"))


def with_shingles(docs: DataFrame, size: int) -> DataFrame:
    """One row per distinct shingle of every row of ``docs`` (column text), as text."""
    cut = docs.withColumn("words", words(F.col("text")))
    runs = _runs("words", size, lambda *w: F.concat_ws(" ", *w), "string")
    return cut.select(*(c for c in docs.columns if c != "text"), F.explode(F.array_distinct(runs)).alias("shingle"))


def item_shingles(items: DataFrame, size: int) -> DataFrame:
    """``item_id, n, shingle, hash`` of the distinct shingles of every item."""
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    each = with_shingles(plain, size).distinct()
    sizes = each.groupBy(F.col("item_id").alias("item")).agg(F.count("*").alias("n"))
    each = each.join(sizes, F.col("item_id").eqNullSafe(F.col("item"))).drop("item")
    return each.withColumn("hash", F.xxhash64(*(F.xxhash64(F.element_at(F.split("shingle", " "), k + 1)) for k in range(size))))


def sketches(parts: DataFrame, threshold: float) -> DataFrame:
    """The MinHash sketch of every item: its ``k`` smallest hashes, ``k`` by its size class.

    Classes double in size. Of an item with n shingles a document may miss ``n - ceil(threshold * n)``, so one
    hash more than the largest such number of the class is enough.
    """
    hi = F.pow(F.lit(2), F.ceil(F.log2("n")))
    k = hi - F.ceil(F.lit(threshold) * hi - 1e-9) + 1
    ranked = parts.groupBy("item_id", "n").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))
    return ranked.withColumn("least", k.cast("int")).select("item_id", F.explode(F.slice("hashes", F.lit(1), F.col("least"))).alias("hash"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """``doc_id, item_id, containment`` of all pairs that reach the threshold.

    Null and short texts (fewer than ``size`` words) have no shingles and are in no pair. Rows that repeat a
    doc_id are judged each by itself and give the better containment; rows that repeat an item_id are one
    item with all their shingles. Null ids are ids like any other. Other columns are not read. An empty
    table on either side gives no pairs.

    Shingles of documents are made and met task by task against the broadcast items; only pairs are
    shuffled. A passage in a third of all documents is one pair per document and item.
    """
    parts = written(item_shingles(items, size), "item-shingles")
    fits = parts.count() <= MOST_BROADCAST
    near = F.broadcast if fits else (lambda df: df)
    keys = near(sketches(parts, threshold).select("hash").distinct())
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.withColumn("version", F.xxhash64("text"))
    hashed = with_hashes(plain, size)
    met = written(hashed.join(keys, "hash").select("doc_id", "version").distinct(), "sketch-hits")
    found = met.select(F.col("doc_id").alias("d"), F.col("version").alias("v"))
    suspects = plain.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left_semi")
    suspects = suspects.dropDuplicates(["doc_id", "version"])
    held = with_shingles(suspects, size)
    shared = held.join(near(parts.select("item_id", "n", "shingle")), "shingle")
    counted = shared.groupBy("doc_id", "version", "item_id", "n").agg(F.count("*").alias("common"))
    ratio = F.col("common") / F.col("n")
    return counted.where(ratio >= threshold - 1e-9).groupBy("doc_id", "item_id").agg(F.max(ratio).alias("containment"))


def contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """A row per document: ``doc_id, contaminated, item_ids`` (ascending) and the best ``containment`` (0 if none reaches the threshold)."""
    pairs = contained_items(docs, items, threshold, size)
    hits = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("containment").alias("containment"))
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    joined = ids.join(hits, F.col("id").eqNullSafe(F.col("doc_id")), "left")
    return joined.select(
        F.col("id").alias("doc_id"), F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("containment", F.lit(0.0)).alias("containment"),
    )


def without_contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """``docs`` without the documents that contain a test item. Rows that share a doc_id go together."""
    hits = contained_items(docs, items, threshold, size).select(F.col("doc_id").alias("contaminated_doc_id")).distinct()
    return docs.alias("d").join(hits.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.contaminated_doc_id")), "left_anti")
