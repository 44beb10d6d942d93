"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

The scatter is summed by Spark over the distinct vectors, from whole numbers less a whole centre near the mean, so its
sums are exact while they are below 2^53. With A = L L^T, plane rotations make the columns of L orthogonal: their squared
norms are then the eigenvalues of A and the normalised columns its eigenvectors. Only matrices of dims x dims are on the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.store import kept
from tidewatch.llm.text import map_batches
from tidewatch.llm.vectors import finite, matrix, whole

COMPONENTS, SCALE = 4, 256
SWEEPS = 60


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L L^T, lower triangular up to the order of its rows, one column for every rank of `a`.

    The row of the greatest remaining diagonal entry comes next; what rounding leaves of a diagonal counts as nothing.
    """
    dims = len(a)
    rest, out = a.astype(np.float64).copy(), np.zeros((dims, dims))
    least = dims * np.finfo(float).eps * max(float(np.diag(rest).max(initial=0.0)), 0.0)
    for k in range(dims):
        pivot = int(np.argmax(np.diag(rest)))
        top = rest[pivot, pivot]
        if not top > least:
            return out[:, :k]
        column = rest[:, pivot] / np.sqrt(top)
        out[:, k] = column
        rest -= np.outer(column, column)
        rest[pivot, :] = rest[:, pivot] = 0.0
    return out


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of factor factor^T, falling, and their unit eigenvectors as columns.

    Rounds of disjoint column pairs, as in a tournament, are rotated at once until all columns are orthogonal.
    """
    columns = factor.T.copy()                                   # a row for every column
    count = len(columns)
    if count == 0:
        return np.zeros(0), np.zeros((len(factor), 0))
    seats = np.arange(count + count % 2)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(seats) - 1):
            p, q = seats[:len(seats) // 2], seats[::-1][:len(seats) // 2]
            real = (p < count) & (q < count)
            p, q = p[real], q[real]
            x, y = columns[p], columns[q]
            a, b, c = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            size = np.sqrt(a * b)
            cosine = np.divide(np.abs(c), size, out=np.zeros_like(c), where=size > 0)
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > np.finfo(float).eps
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                zeta = (b - a) / (2 * c)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turn, t, 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            sin = cos * t
            columns[p] = cos[:, None] * x - sin[:, None] * y
            columns[q] = sin[:, None] * x + cos[:, None] * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= 4 * np.finfo(float).eps * len(factor):
            break
    values = (columns * columns).sum(1)
    order = np.argsort(-values, kind="stable")
    vectors = (columns[order] / np.sqrt(values[order])[:, None]).T
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(count)])
    return values[order], vectors * signs


@dataclass
class Whitening:
    """n vectors with sums S; a vector x becomes ((x - centre) - offset) @ vectors / sqrt(values)."""

    n: int
    sums: list[int]
    centre: np.ndarray
    offset: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(np.float64) - self.offset) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 for every row, exactly; null beyond 64 bits."""
        centre = [int(c) for c in self.centre]
        rest = [s - self.n * c for s, c in zip(self.sums, centre)]
        moved = x - self.centre
        most = self.n * int(np.abs(moved).max(initial=0)) + max(map(abs, rest), default=0)
        kind = np.int64 if max(1, len(rest)) * most * most < 1 << 63 else object
        parts = moved.astype(kind) * self.n - np.array(rest, kind)
        return [int(v) if v < 1 << 63 else None for v in (parts * parts).sum(axis=1)]


def _sums(fit: DataFrame, dims: int, width: int, part, kind: str) -> np.ndarray:
    """Sums over all rows of `fit` of part(x), a matrix of dims x width, where it is not zero."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + part(matrix(batch.column(0), dims))
        i, j = np.nonzero(total) if np.ndim(total) else ([], [])
        yield {"i": i, "j": j, "value": total[i, j].tolist() if len(i) else []}

    rows = map_batches(fit, add, "i int, j int, value double" if kind == "double" else "i int, j int, value long")
    out = np.zeros((dims, width), float if kind == "double" else object)
    value = F.sum("value") if kind == "double" else F.sum(F.col("value").cast("decimal(20,0)"))
    for row in rows.groupBy("i", "j").agg(value.alias("value")).collect():      # dims x width rows at most
        out[row.i, row.j] = row.value if kind == "double" else int(row.value)
    return out


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening learned from every distinct vector of `vectors` (v array<long>), or None without a variance."""
    size = vectors.agg(F.max(F.size("v"))).first()[0]
    if not size:
        return None
    fit = kept(vectors.select("v").distinct(), "vectors")
    n = fit.count()
    sums = [int(s) for s in _sums(fit, size, 1, lambda x: x.sum(axis=0, dtype=np.int64)[:, None], "long")[:, 0]]
    centre = np.array([s // n for s in sums], np.int64)
    offset = np.array([float(Fraction(s, n) - s // n) for s in sums])

    def scatter(x: np.ndarray) -> np.ndarray:
        moved = (x - centre).astype(np.float64)
        return moved.T @ moved

    covariance = _sums(fit, size, size, scatter, "double") / n - np.outer(offset, offset)
    values, axes = jacobi(pivoted_cholesky(covariance))
    chosen = int((values > 0).sum())
    if not chosen:
        return None
    out = Whitening(n, sums, centre, offset, values[:components], axes[:, :components], float(np.trace(covariance)))
    width = len(out.values)

    def spread(x: np.ndarray) -> np.ndarray:
        white = out.project(x)
        return np.concatenate([white.T @ white, white.sum(axis=0)[:, None]], axis=1)

    own = _sums(fit, size, width + 1, lambda x: np.pad(spread(x), ((0, size - width), (0, 0))), "double")[:width] / n
    mean = own[:, width]                                # of numbers that are centred already, so next to nothing
    out.identity_error = float(np.abs(own[:, :width] - np.outer(mean, mean) - np.eye(width)).max())
    return out


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every row of `rows` and component.

    Needs vec_id and embedding; other columns are ignored. Rows whose vector is null or has a null or non-finite component
    are left out; a null vec_id keeps its rows. Components become floor(scale * x). Every distinct vector counts once in
    the fit, repeated rows are each returned. A vector shorter than the longest is followed by zeros. Components without
    variance are not returned: a table of equal vectors, like an empty one, gives no rows. Vectors point so that
    their greatest component is positive. deviation is null where it does not fit 64 bits.
    """
    vectors = rows.where(finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), whole("embedding", scale).alias("v"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit_whitening(vectors, components)
    if model is None:
        return vectors.limit(0).select(
            "vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (part.split() for part in schema.split(", ")[1:])])
    count = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = matrix(batch.column(1), len(model.sums))
            times = batch.num_rows
            yield {"vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(times), count))),
                   "component": np.tile(np.arange(1, count + 1), times), "n": np.full(times * count, model.n),
                   "deviation": [d for d in model.deviations(x) for _ in range(count)],
                   "whitened": model.project(x).ravel(), "explained": np.tile(model.values / model.trace, times),
                   "identity_error": np.full(times * count, model.identity_error)}

    return map_batches(vectors, run, schema)
