"""Ranked lexical search: each query's best documents by an integer form of BM25.

Queries are worked in blocks of bounded size. A first pass over the whole texts counts each document's terms
and its occurrences of the block's terms; the table that it writes gives the corpus statistics too. A second
pass takes batches of documents: for each query a bitmap per term says which documents hold it, and the bits
of a document across the bitmaps are its presence mask. Documents with equal masks are a group; no score in
it exceeds the sum of its terms' largest contributions. Groups are evaluated by descending bound until the
next bound is below the k-th score found so far, which a task keeps from batch to batch. What tasks keep is
ranked once more over all tasks, so the result is exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import in_tasks, written

# Terms are runs of ASCII letters and digits and of all code points beyond ASCII; only A-Z are lowered.
_KEPT = {*b"0123456789", *b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
_TABLE = bytes(c if c in _KEPT else 32 for c in range(256)).lower()

#: Cells of one query's matrix of terms and documents.
_CELLS = 1 << 22


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text in order, as UTF-8; none of a null text."""
    return (text or "").encode().translate(_TABLE).split()


def _occurrences(numbers: dict[bytes, int]) -> Callable:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                found = Counter(map(numbers.get, words))
                found.pop(None, None)
                lengths.append(len(words))
                terms.append(list(found))
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64())),
            ], ["doc_id", "n", "terms", "counts"])

    return counted


class _Best:
    """The best ``k`` documents of a query: by descending score, then ascending id, a null id last."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((3, 0), np.int64)  # score, whether the id is null, id

    @property
    def least(self) -> int:
        """A score that a further document has to reach."""
        return int(self.rows[0, -1]) if self.rows.shape[1] == self.k else 1

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least
        rows = np.hstack([self.rows, np.array([score[good], null[good], ids[good]])])
        self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]]


def _masks(bitmaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct masks of the documents as rows of bits, the documents ordered by mask, and where each mask begins."""
    packed = np.packbits(bitmaps, axis=0)
    wide = np.zeros((bitmaps.shape[1], -(-packed.shape[0] // 8) * 8), np.uint8)
    wide[:, : packed.shape[0]] = packed.T
    keys = wide.view(np.uint64)[:, 0] if wide.shape[1] == 8 else wide.view(f"V{wide.shape[1]}")[:, 0]
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    bits = np.unpackbits(packed[:, order[first]], axis=0, count=bitmaps.shape[0])
    return bits, order, np.append(first, len(order))


def _evaluate(best: _Best, part: np.ndarray, bitmaps: np.ndarray, weights: np.ndarray, null: np.ndarray, ids: np.ndarray, together: int = 64) -> None:
    """Add to ``best`` from documents (columns) with contributions ``part`` of terms (rows), mask by mask."""
    bits, order, starts = _masks(bitmaps)
    bounds = (weights * part.max(axis=1)) @ bits.astype(np.int64)
    queue = np.argsort(-bounds, kind="stable")
    at = 0
    while at < len(queue) and bounds[queue[at]] >= best.least:
        group, held = [], 0
        while at < len(queue) and held < together and bounds[queue[at]] >= best.least:
            group.append(order[starts[queue[at]]: starts[queue[at] + 1]])
            held += len(group[-1])
            at += 1
        docs = np.concatenate(group)
        best.add(weights @ part[:, docs], null[docs], ids[docs])


def _ranked(queries: list[tuple[int | None, list[int]]], weights: list[int], texts: int, length: int, k: int) -> Callable:
    weight_of = np.array(weights, np.int64)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [_Best(k) for _ in queries]
        for batch in batches:
            ids, sizes = batch.column(0), batch.column(1).to_numpy()
            null, ids = np.asarray(ids.is_null()).astype(np.int64), ids.fill_null(0).to_numpy()
            own, which = np.unique(sizes, return_inverse=True)
            m = np.array([10 + 90 * int(n) * texts // length for n in own], np.int64)[which]
            held = np.diff(batch.column(2).offsets.to_numpy())
            terms, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), held)
            part = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
            by_term = np.argsort(terms, kind="stable")
            terms, doc, part = terms[by_term], doc[by_term], part[by_term]
            for (_, wanted), best in zip(queries, kept, strict=True):
                low, high = np.searchsorted(terms, wanted, "left"), np.searchsorted(terms, wanted, "right")
                here = np.flatnonzero(high > low)
                if not len(here):
                    continue
                low, high, w = low[here], high[here], weight_of[wanted][here]
                if sum(int(x) * int(part[a:b].max()) for a, b, x in zip(low, high, w, strict=True)) < best.least:
                    continue
                step = max(64, _CELLS // len(here))
                for begin in range(0, batch.num_rows, step):  # more than one for queries of very many terms only
                    end = min(begin + step, batch.num_rows)
                    own_part = np.zeros((len(here), end - begin), np.int64)
                    bitmaps = np.zeros((len(here), end - begin), bool)
                    for j, (a, b) in enumerate(zip(low, high, strict=True)):
                        inside = slice(a + np.searchsorted(doc[a:b], begin), a + np.searchsorted(doc[a:b], end))
                        own_part[j, doc[inside] - begin] = part[inside]
                        bitmaps[j, doc[inside] - begin] = True
                    _evaluate(best, own_part, bitmaps, w, null[begin:end], ids[begin:end])
        for (item, _), best in zip(queries, kept, strict=True):
            score, absent, ids = best.rows
            yield pa.RecordBatch.from_arrays([
                pa.array([item] * len(score), pa.int64()), pa.array(ids, pa.int64(), mask=absent.astype(bool)), pa.array(score, pa.int64()),
            ], ["item_id", "doc_id", "score"])

    return ranked


def _blocks(items: DataFrame, most_bytes: int) -> Iterator[list[tuple[int | None, set[bytes]]]]:
    """Queries with their distinct terms; a block ends with the query that takes it to ``most_bytes``."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id")
    block, held = [], 0
    for row in rows.toLocalIterator():
        if block and block[-1][0] == row.item_id:
            own = block[-1][1]
        else:
            if held >= most_bytes:
                yield block
                block, held = [], 0
            own = set()
            block.append((row.item_id, own))
        before = len(own)
        new = set(terms_of(row.text)) - own
        own |= new
        held += sum(map(len, new)) + 8 * (len(own) - before)
    if block:
        yield block


def _search_block(docs: DataFrame, block: list[tuple[int | None, set[bytes]]], k: int) -> DataFrame | None:
    """Rows ``item_id, doc_id, score`` from each task's best documents; None if nothing can score."""
    vocabulary = sorted(set().union(*(own for _, own in block)))
    numbers = {term: i for i, term in enumerate(vocabulary)}
    found = written(in_tasks(docs, _occurrences(numbers), "doc_id long, n long, terms array<int>, counts array<long>"), "search-occurrences")
    texts, length = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not length:
        return None
    holding = {r["term"]: r["count"] for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = [math.floor(1000 * math.log((2 * texts + 2) / (2 * holding.get(i, 0) + 1))) for i in range(len(vocabulary))]
    queries = [(item, sorted(numbers[t] for t in own)) for item, own in block if own]
    return in_tasks(found.where(F.size("terms") > 0), _ranked(queries, weights, texts, length, k), "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents for every item of ``items``.

    Items are worked in blocks whose distinct terms have about ``block_bytes`` bytes (one item more at most);
    that bounds what tasks are sent and what the driver holds. Documents are never limited.

    Rows with one item_id (all null ids are one) are one item with the terms of all their texts. Every row of
    ``docs`` is a document of its own, repeated ones too; null ids come last among equal scores. Null texts
    and texts without a term match nothing, and items without a term have no rows, as have empty tables.
    Other columns of either table are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    parts = []
    for block in _blocks(items, block_bytes):
        scored = _search_block(docs, block, k)
        if scored is not None:
            parts.append(written(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "search-block"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("item_id", "rank", "doc_id", "score")
