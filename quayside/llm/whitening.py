"""Embedding whitening: leading principal components by block Jacobi-Davidson.

The covariance is never formed. Vectors are written once as chunks of integers; a product of the covariance
with a block of vectors is one Spark job in which every task sums ``Y'(Y U)`` over its chunks of exactly
centred vectors ``Y``. The driver holds blocks of as many numbers as a vector has, never rows of data.

Each outer step takes the best approximations from the search space (Rayleigh-Ritz), locks those whose
residuals have reached double precision, solves the others' projected correction equations by a few steps of
MINRES, all of them in the same products, and adds the corrections to the search space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import in_tasks, written

#: Fixed values of the integer form: x = floor(64 * c) + 1000000.
SCALE, SHIFT = 64.0, 1_000_000

_CHUNK_BYTES = 4 << 20
_LARGEST = 1 << 60
_EPS = float(np.finfo(float).eps)
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- the eigenproblem, given products only -------------------------------------------------------------

def _without(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``x`` made orthogonal to the orthonormal columns of ``q``, twice for rounding."""
    for _ in range(2):
        x = x - q @ (q.T @ x)
    return x


def _new_directions(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what ``x`` has beyond the span of ``q``."""
    found = np.zeros((len(x), 0))
    for column in x.T:
        basis = np.hstack([q, found])
        before = np.linalg.norm(column)
        rest = _without(basis, column[:, None]) if before > 0 else column[:, None]
        if basis.shape[1] < len(x) and before > 0 and np.linalg.norm(rest) > 1e-10 * before:
            rest = _without(basis, rest / np.linalg.norm(rest))
            found = np.hstack([found, rest / np.linalg.norm(rest)])
    return found


def minres(product: Callable, right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of ``A t = right``, one MINRES recurrence a column, all columns in one product a step."""
    beta = np.linalg.norm(right, axis=0)
    live = beta > 0
    v_old, v = np.zeros_like(right), right / np.where(live, beta, 1.0)
    t, eta = np.zeros_like(right), beta.copy()
    d_old, d_older = np.zeros_like(right), np.zeros_like(right)
    c, c_old, s, s_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        p = product(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        following = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * beta
        rho = np.hypot(delta, following)
        live &= rho > 1e-300
        over = np.where(live, rho, 1.0)
        rho2, rho3 = s * alpha + c_old * c * beta, s_old * beta
        c_old, s_old, c, s = c, s, np.where(live, delta / over, 1.0), np.where(live, following / over, 0.0)
        d = np.where(live, (v - rho3 * d_older - rho2 * d_old) / over, 0.0)
        t = t + c * eta * d
        eta = np.where(live, -s * eta, 0.0)
        d_older, d_old, v_old = d_old, d, v
        live &= following > 1e-300
        v, beta = np.where(live, p / np.where(live, following, 1.0), 0.0), following
    return t


def leading_pairs(product: Callable, size: int, wanted: int, inner: int = 6, most_outer: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric semidefinite matrix.

    ``product`` multiplies it with a block of columns. Every pair's residual is at most ``16 eps sqrt(size)`` times the
    largest eigenvalue, by a product made for that check.
    """
    wanted = min(wanted, size)
    guard = min(size, wanted + 8)
    largest = min(size, 4 * guard)
    draw = np.random.default_rng(7).standard_normal
    space = np.linalg.qr(draw((size, guard)))[0]
    image = product(space)
    locked, locked_image = np.zeros((size, 0)), np.zeros((size, 0))
    for _ in range(most_outer):
        values, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        turn = turn[:, np.argsort(-values, kind="stable")]
        values = np.sort(values)[::-1]
        ritz, ritz_image = space @ turn, image @ turn
        scale = max([abs(float(values[0])) if len(values) else 0.0, *np.linalg.norm(locked_image, axis=0)])
        bound = 16 * _EPS * np.sqrt(size) * scale
        left = wanted - locked.shape[1]
        residual = _without(locked, ritz_image[:, :left] - ritz[:, :left] * values[:left])
        good = np.linalg.norm(residual, axis=0) <= bound
        done = int(np.argmin(good)) if not good.all() else left
        locked, locked_image = np.hstack([locked, ritz[:, :done]]), np.hstack([locked_image, ritz_image[:, :done]])
        space, image = ritz[:, done:], ritz_image[:, done:]
        if locked.shape[1] == wanted:
            fresh = product(locked)
            values, turn = np.linalg.eigh((locked.T @ fresh + fresh.T @ locked) / 2)
            order = np.argsort(-values, kind="stable")
            values, vectors, fresh = values[order], locked @ turn[:, order], fresh @ turn[:, order]
            if (np.linalg.norm(fresh - vectors * values, axis=0) <= 4 * bound).all():
                return values, vectors
            space, image = np.hstack([vectors, space]), np.hstack([fresh, image])
            locked, locked_image = np.zeros((size, 0)), np.zeros((size, 0))
            continue
        open_ = ~good[done:]
        shifts, residual = values[done:left][open_], residual[:, done:][:, open_]
        if space.shape[1] > largest - left:  # begin anew from the best directions
            space, image = space[:, :guard], image[:, :guard]
        fixed = np.hstack([locked, space[:, : left - done]])

        def corrected(x: np.ndarray, fixed: np.ndarray = fixed, shifts: np.ndarray = shifts) -> np.ndarray:
            x = _without(fixed, x)
            return _without(fixed, product(x) - shifts * x)

        correction = minres(corrected, -_without(fixed, residual), inner) if fixed.shape[1] < size else residual[:, :0]
        added = _new_directions(np.hstack([locked, space]), correction)
        if not added.shape[1] and locked.shape[1] + space.shape[1] < size:
            added = _new_directions(np.hstack([locked, space]), draw((size, 1)))
        if added.shape[1]:
            space, image = np.hstack([space, added]), np.hstack([image, product(added)])
        else:  # the search space is the whole space: only rounding is left to be removed
            space = np.linalg.qr(_without(locked, space))[0]
            image = product(space)
    raise ArithmeticError(f"{locked.shape[1]} of {wanted} components after {most_outer} steps")


# --- vectors in Spark ------------------------------------------------------------------------------------

def usable(vector: Column) -> Column:
    """Whether a vector and all its entries are there and finite."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


@dataclass(frozen=True)
class Fit:
    """What is known of the fit list: its vectors' number, length, exact sums and mean (whole part and rest)."""

    n: int
    size: int
    sums: list[int]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)

    def integers(self, blob: pa.Scalar) -> np.ndarray:
        return np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, self.size)

    def centred(self, blob: pa.Scalar) -> np.ndarray:
        return (self.integers(blob) - self.whole) - self.rest / self.n


def _chunked(size: int) -> Callable:
    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, _CHUNK_BYTES // (8 * size))
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, size)
            x = np.clip(np.floor(SCALE * values), -_LARGEST, _LARGEST).astype(np.int64) + SHIFT
            for at in range(0, len(x), most):
                part = x[at: at + most]
                ids = pa.array([batch.column(0)[at: at + most].to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([part.tobytes()], pa.binary())], ["ids", "x"])

    return chunked


def _summed(chunks: DataFrame, of_chunk: Callable, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all chunks of the matrices that ``of_chunk`` makes of them; tasks add theirs up first."""
    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(shape), False
        for batch in batches:
            for blob in batch.column(0):
                total += of_chunk(blob)
                seen = True
        if seen:
            yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size, dtype=np.int64), "value": total.ravel()})

    rows = in_tasks(chunks.select("x"), partial_sums, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(shape[0] * shape[1])
    for row in rows:
        out[row["cell"]] = row["value"]
    return out.reshape(shape)


def _integer_sums(size: int) -> Callable:
    """Counts and sums as two halves of 31 bits and more, so that no sum overflows."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                x = np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, size)
                yield pa.RecordBatch.from_pydict({
                    "dimension": np.arange(size, dtype=np.int64), "rows": np.full(size, len(x)), "high": (x >> 31).sum(axis=0), "low": (x & 0x7FFFFFFF).sum(axis=0),
                })

    return sums


def _fit(chunks: DataFrame, size: int) -> Fit:
    found = in_tasks(chunks.select("x"), _integer_sums(size), "dimension long, rows long, high long, low long").groupBy("dimension").agg(
        F.sum("rows").alias("rows"), *(F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low"))).collect()
    sums = {r["dimension"]: (int(r["high"]) << 31) + int(r["low"]) for r in found}
    return Fit(found[0]["rows"], size, [sums[i] for i in range(size)])


def _times(fit: Fit, block: np.ndarray, blob: pa.Scalar) -> np.ndarray:
    y = fit.centred(blob)
    return y.T @ (y @ block)


def _squares(fit: Fit, blob: pa.Scalar) -> np.ndarray:
    return np.square(fit.centred(blob)).sum(axis=0, keepdims=True)


def _moments(fit: Fit, axes: np.ndarray, blob: pa.Scalar) -> np.ndarray:
    """Sums (first row) and sums of products of whitened coordinates."""
    w = fit.centred(blob) @ axes
    return np.vstack([w.sum(axis=0), w.T @ w])


def _deviations(fit: Fit, x: np.ndarray) -> pa.Array:
    """Sums over the dimensions of (n x - S)^2; null where it is no long."""
    near = x - fit.whole
    held = np.square(near.astype(float) * fit.n - fit.rest).sum(axis=1) < 9.2e18
    exact = np.where(held[:, None], near, 0) * np.int64(fit.n) - np.where(held[:, None], fit.rest, 0)
    return pa.array(np.square(exact).sum(axis=1), pa.int64(), mask=~held)


def _whitened(fit: Fit, axes: np.ndarray, explained: np.ndarray, error: float) -> Callable:
    k = axes.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blob in zip(batch.column(0), batch.column(1), strict=True):
                x, w = fit.integers(blob), fit.centred(blob) @ axes
                for at in range(0, len(x), 4096):
                    each = np.repeat(np.arange(len(x[at: at + 4096])), k)
                    m = len(each)
                    yield pa.RecordBatch.from_arrays([
                        ids.values.slice(at, 4096).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m // k)), pa.array(np.full(m, fit.n)),
                        _deviations(fit, x[at: at + 4096]).take(pa.array(each)), pa.array(w[at: at + 4096].ravel()), pa.array(np.tile(explained, m // k)), pa.array(np.full(m, error)),
                    ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """A row per usable row of ``vectors`` (``vec_id, embedding``) and component: see ``RESULT``.

    Rows whose vector is null or holds null or non-finite entries are left out, and so are vectors of another
    length than most have (of equally common lengths the largest counts) and those of length zero. Repeated
    rows, equal and null ids are rows like any other. Components whose eigenvalue is not above 1e-9 of the
    largest cannot be whitened in doubles and are left out; so equal vectors, a single one or an empty table
    give no rows. ``deviation`` is null where it exceeds a long; entries beyond 2^60 / 64 count as that.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding")))
    commonest = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if commonest is None:
        return spark.createDataFrame([], RESULT)
    size = commonest["size"]
    chunks = written(in_tasks(rows.where(F.size("embedding") == size), _chunked(size), "ids array<long>, x binary"), "vector-chunks")
    fit = _fit(chunks, size)
    trace = float(_summed(chunks, partial(_squares, fit), (1, size)).sum()) / fit.n
    if trace == 0:
        return spark.createDataFrame([], RESULT)

    def product(block: np.ndarray) -> np.ndarray:
        return _summed(chunks, partial(_times, fit, block), block.shape) / fit.n

    values, vectors_ = leading_pairs(product, size, components)
    kept = values > 1e-9 * values[0]
    values, vectors_ = values[kept], vectors_[:, kept]
    signs = np.sign(vectors_[np.abs(vectors_).argmax(axis=0), np.arange(len(values))])
    axes = vectors_ * signs / np.sqrt(values)
    moments = _summed(chunks, partial(_moments, fit, axes), (len(values) + 1, len(values))) / fit.n
    error = float(np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(len(values))).max())
    return in_tasks(chunks, _whitened(fit, axes, values / trace, error), RESULT)
