"""Language identification in two steps: the family first, then the language within it.

Families are told apart by one linear support vector machine each (the family against all others). Within
the winning family one machine for every two languages votes. All machines read the same features: counts
of letters and letter trigrams of the whole text, in lower case, hashed into a fixed number of cells, square
roots taken, brought to length one. Only the text is read for a prediction.

The machines are fitted on a bounded sample: at most ``most_rows`` labelled documents altogether, and the
same number from each language, drawn by a hash of their ids. Their features (up to ``CELLS`` numbers each, without zeros) are all
that reaches the driver, where they are laid out once, in one matrix that all machines read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache, cmp_to_key
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import in_tasks

CELLS = 4096
UNKNOWN = "und"

# Families of languages by ISO 639-1 code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "semitic": ("ar", "he", "mt", "am"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"),
    "celtic": ("ga", "cy", "gd", "br"),
    "baltic": ("lt", "lv"),
}

_CHARS = 1 << 20
#: Rows that a machine's step widens at once.
_ROWS = 128


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _cells(text: str) -> np.ndarray:
    """The cells of all letters and trigrams of a text; a stretch without letters counts as one blank."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    kept = letter | np.concatenate([[True], letter[:-1]])
    c = np.where(letter, points, 0)[kept].astype(np.uint64)
    single = c[c > 0] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)
    mixed = (c[:-2] * np.uint64(0x1000193) ^ c[1:-1]) * np.uint64(0x1000193) ^ c[2:]
    return np.concatenate([single, mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(52)]).astype(np.int64)


def features(text: str | None) -> np.ndarray | None:
    """Length-one vector of a whole text; None without any letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    counts = np.zeros(CELLS)
    for at in range(0, len(text), _CHARS):
        counts += np.bincount(_cells(text[max(0, at - 2): at + _CHARS] if at else text[:_CHARS]), minlength=CELLS)
    root = np.sqrt(counts)
    return (root / np.linalg.norm(root)).astype(np.float32)


def fit_machine(rows: np.ndarray, positive: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, both classes weighted alike.

    ``rows`` are features with a one last. Steps in double precision widen ``_ROWS`` of them at a time, never all.
    """
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w = ahead = np.zeros(rows.shape[1], np.float32)
    step, momentum = 1 / (4 + penalty), 1.0
    for _ in range(rounds):  # accelerated gradient steps
        slope, most = np.zeros(rows.shape[1], ahead.dtype), len(rows) if ahead.dtype == rows.dtype else _ROWS
        for at in range(0, len(rows), most):
            part, here = rows[at: at + most].astype(ahead.dtype, copy=False), slice(at, at + most)
            slack = np.maximum(0, 1 - y[here] * (part @ ahead))
            slope += part.T @ (2 * (share[here] * y[here] * slack))
        new = ahead - step * (penalty * ahead - slope)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / following * (new - w), new, following
    return w.astype(np.float32)


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * margin))


@dataclass
class Model:
    """Families with their languages, a machine per family, a machine per pair of languages of a family."""

    families: list[list[str]] = field(default_factory=list)
    of_family: np.ndarray = field(default_factory=lambda: np.zeros((0, CELLS + 1), np.float32))
    of_pair: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, langs: list[str], rows: np.ndarray) -> Model:
        """From the languages of ``rows``: features with a one last."""
        known = {lang: family for family, members in FAMILIES.items() for lang in members}
        names = np.array([known.get(lang, lang) for lang in langs])
        labels = np.array(langs)
        families = [sorted({str(x) for x in labels[names == f]}) for f in sorted(set(names))]
        machines = [fit_machine(rows, names == f) for f in sorted(set(names))] if len(families) > 1 else [np.append(np.zeros(CELLS), 1)] * len(families)
        pairs = {}
        for a, b in (pair for members in families for pair in combinations(members, 2)):
            both = (labels == a) | (labels == b)
            pairs[a, b] = fit_machine(rows[both], labels[both] == a)
        return cls(families, np.array(machines, np.float32).reshape(-1, CELLS + 1), pairs)

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text) if self.families else None
        if x is None:
            return UNKNOWN, 0.0
        chances = _chance(self.of_family[:, :-1] @ x + self.of_family[:, -1])
        best = int(np.argmax(chances))
        members = self.families[best]
        votes, sure = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            w = self.of_pair[a, b]
            p = float(_chance(w[:-1] @ x + w[-1]))
            votes[a if p >= 0.5 else b] += 1
            sure[a] += p
            sure[b] += 1 - p
        lang = max(members, key=lambda m: (votes[m], sure[m], m))
        return lang, float(chances[best]) * (sure[lang] / (len(members) - 1) if len(members) > 1 else 1.0)


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features as the cells that are not zero and their values: a fraction of all cells reaches the driver."""
    for batch in batches:
        rows = [(lang, at.astype("<u2").tobytes(), x[at].astype("<f4").tobytes())
                for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                if (x := features(t)) is not None for at in (np.flatnonzero(x),)]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()),
        ], ["lang", "cells", "x"])


def _filled(row: tuple, into: np.ndarray) -> np.ndarray:
    into[np.frombuffer(row[1], "<u2")] = np.frombuffer(row[2], "<f4")
    return into


def _by_features(a: tuple, b: tuple) -> int:
    """Compares rows of one language by the bytes of all their cells, which are made for one comparison at a time."""
    left, right = (_filled(r, np.zeros(CELLS, "<f4")).tobytes() for r in (a, b))
    return (left > right) - (left < right)


def _matrix(found: list[tuple]) -> tuple[list[str], np.ndarray]:
    """Languages and rows for :meth:`Model.fit`, in an order that does not depend on that of ``found``, which is emptied."""
    found.sort(key=cmp_to_key(_by_features))
    found.sort(key=lambda r: r[0])
    langs, rows = [r[0] for r in found], np.zeros((len(found), CELLS + 1), np.float32)
    rows[:, -1] = 1
    for i, row in enumerate(found):
        _filled(row, rows[i])
    found.clear()
    return langs, rows


def fit_model(docs: DataFrame, most_rows: int = 2000, most_langs: int = 200) -> Model:
    """A model from ``doc_id, text, lang`` of the rows with a lang; none of them gives a model without languages."""
    labelled = docs.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")).alias("draw"))
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    if not counts:
        return Model()
    each = max(1, most_rows // len(counts))
    share = F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], min(1.0, 1.2 * each / r["count"]))))
    drawn = labelled.where(F.pmod("draw", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    first = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))
    drawn = drawn.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= each).select("lang", "text")
    found = in_tasks(drawn, _featured, "lang string, cells binary, x binary").collect()
    if not found:
        return Model()
    return Model.fit(*_matrix(found))


def _predictor(model: Model, text_column: str) -> Callable:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(batch.schema.names.index(text_column))]
            added = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) last; existing columns of these names are replaced.

    A null text, an empty one and one without any letter are ``und`` with score 0, and so is every text
    under a model without languages. Equal texts get equal predictions. Null ids, null langs and repeated
    rows make no difference. An empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return in_tasks(docs, _predictor(model, "text"), f"{schema}, lang_pred string, score double")
