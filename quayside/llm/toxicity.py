"""Toxicity: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

A text is described by which hashed words, word pairs and skip-grams (pairs with one or two words between)
occur in it. FTRL-proximal keeps two numbers a cell (``z`` and the sum of squared gradients ``n``): every
cell has a learning rate of its own, and L1 leaves the weights of most cells at exactly zero, so the model is
a short list of cells.

The fit is distributed. The features of at most about ``most_rows`` labelled rows, drawn by a hash, are
written once. In each round every task goes on from the common state over its share of about ``shard_rows``
rows, and the states are averaged by their numbers of rows. The driver sees these states
only (``8 << BITS`` bytes each, ``most_rows / shard_rows`` of them).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import in_tasks, written

BITS = 18
BIAS = 1 << BITS

_WORD = re.compile(r"\w+")
_SKIPS = (1, 2, 3)


def features(text: str | None) -> np.ndarray:
    """The distinct cells of a whole text, the cell of the bias among them."""
    words = " ".join(_WORD.findall((text or "").lower())).encode().split()
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    half = np.uint64(65 - BITS)  # words have the upper half of the cells to themselves
    parts = [(h * np.uint64(0x9E3779B97F4A7C15) >> half) + np.uint64(BIAS >> 1)]
    for skip in _SKIPS:
        parts.append(((h[:-skip] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[skip:] + np.uint64(skip))) * np.uint64(0xD6E8FEB86659FD93) >> half)
    return np.append(np.unique(np.concatenate(parts)).astype(np.int32), np.int32(BIAS))


def chance(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(margin, -35.0, 35.0))))


@dataclass
class State:
    """FTRL-proximal's state; ``alpha`` and ``beta`` set the rates, ``l1`` and ``l2`` pull weights to zero."""

    z: np.ndarray = field(default_factory=lambda: np.zeros(BIAS + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros(BIAS + 1))
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0

    def weights(self, cells: np.ndarray) -> np.ndarray:
        z, n = self.z[cells], self.n[cells]
        pulled = np.maximum(np.abs(z) - np.where(cells == BIAS, 0.0, self.l1), 0.0)
        return -np.sign(z) * pulled / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, cells: np.ndarray, label: int) -> None:
        w, n = self.weights(cells), self.n[cells]
        g = chance(w.sum()) - label
        self.z[cells] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[cells] = n + g * g


@dataclass
class Model:
    """The cells whose weight is not zero, in ascending order, and their weights."""

    cells: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def dense(self) -> np.ndarray:
        out = np.zeros(BIAS + 1)
        out[self.cells] = self.weights
        return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [features(t.as_py()).tobytes() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), batch.column(1)], ["cells", "label"])


def _learner(z: bytes, n: bytes) -> Callable:
    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = State(np.frombuffer(z, np.float32).astype(float), np.frombuffer(n, np.float32).astype(float))
        rows = 0
        for batch in batches:
            for cells, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                state.learn(np.frombuffer(cells.as_buffer(), np.int32), label)
            rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_pydict({
                "rows": [rows], "z": pa.array([state.z.astype(np.float32).tobytes()], pa.binary()), "n": pa.array([state.n.astype(np.float32).tobytes()], pa.binary()),
            })

    return learned


def fit_model(rows: DataFrame, most_rows: int = 24_576, shard_rows: int = 4096, rounds: int = 6) -> Model:
    """A model from the columns ``doc_id, text, toxic`` (0 or 1, integer) of ``rows``.

    Rows with another label or without one teach nothing; null and empty texts are texts without words. A
    document with several labels is learned once with each. Without any labelled row, or with one class only,
    the model has no cells or its bias only, and scores are constant.
    """
    labelled = rows.where("toxic in (0, 1)").select(
        F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("label"), F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"), "text").alias("draw"))
    count = labelled.count()
    if not count:
        return Model()
    share = min(1.0, most_rows / count)
    drawn = labelled.where(F.pmod("draw", F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    shards = max(1, round(min(count, most_rows) / shard_rows))
    dealt = drawn.repartition(shards, F.pmod("draw", F.lit(1 << 20))).sortWithinPartitions("draw", "label").select("text", "label")
    sample = written(in_tasks(dealt, _featured, "cells binary, label int"), "toxic-features")
    state = State()
    for _ in range(rounds):
        step = _learner(state.z.astype(np.float32).tobytes(), state.n.astype(np.float32).tobytes())
        found = in_tasks(sample.coalesce(shards), step, "rows long, z binary, n binary").collect()
        if not found:
            return Model()
        weight = np.array([r["rows"] for r in found], float) / sum(r["rows"] for r in found)
        for name in ("z", "n"):
            setattr(state, name, sum(w * np.frombuffer(r[name], np.float32).astype(float) for w, r in zip(weight, found, strict=True)))
    weights = state.weights(np.arange(BIAS + 1))
    cells = np.flatnonzero(weights)
    return Model(cells.astype(np.int32), weights[cells])


def _scorer(model: Model, place: int) -> Callable:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.dense()
        for batch in batches:
            found = pa.array([chance(weights[features(t.as_py())].sum()) for t in batch.column(place)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "score"])

    return scored


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` last, the chance (0 to 1) that a text is toxic; a column of that name is replaced.

    Only ``text`` is read, the whole of it. Null, empty and wordless texts get the score of the bias alone;
    equal texts get equal scores. Null ids and repeated rows make no difference; an empty table gives no rows.
    """
    docs = docs.drop("score")
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return in_tasks(docs, _scorer(model, docs.columns.index("text")), f"{schema}, score double")
