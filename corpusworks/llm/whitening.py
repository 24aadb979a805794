"""Embedding whitening with components from QDWH spectral divide and conquer.

Sums and covariance are aggregates over all distinct vectors; what reaches the driver is one vector and one
square matrix of the embedding's dimension. There the polar factor of the shifted covariance gives the projector
on the eigenvectors above the shift, which splits the space in two; the parts are split again until they hold
one eigenvalue each. The components go back to the tasks, which whiten every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusworks.llm.common import materialise

#: Embedding components become whole numbers of this fraction.
SCALE = 256
#: Vectors multiplied at once in a task.
ROWS = 1024
_EPS = float(np.finfo(float).eps)


# --- spectral divide and conquer --------------------------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley steps."""
    d = len(a)
    x, low = a / np.linalg.norm(a), _EPS  # the Frobenius norm bounds the largest singular value, low the smallest
    for _ in range(12):
        square = low * low
        g = np.cbrt(4 * (1 - square) / square**2) if low < 1 else 0.0
        root = np.sqrt(1 + g)
        wa = root + np.sqrt(max(8 - 4 * g + 8 * (2 - square) / (square * root), 0.0)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(d)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:d] @ q[d:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        if moved <= _EPS ** (1 / 3) and abs(low - 1) < 10 * _EPS:
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the eigenvectors above and below a shift inside the spectrum."""
    d, mean = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(d)) / np.sqrt(d)
    draw, best = np.random.default_rng(20240601), None
    for step in (0.0, 0.31, -0.27, 0.11, -0.13, 0.53, -0.47):  # an eigenvalue at the shift has no side: shift again
        projector = (polar(a - (mean + step * spread) * np.eye(d)) + np.eye(d)) / 2
        rank = round(np.trace(projector))
        if not 0 < rank < d:
            continue
        base = draw.standard_normal((d, rank))
        for _ in range(3):
            base, _ = np.linalg.qr(projector @ base)
        full, _ = np.linalg.qr(base, mode="complete")
        left = np.linalg.norm(full[:, rank:].T @ a @ full[:, :rank])
        if best is None or left < best[0]:
            best = (left, full[:, :rank], full[:, rank:])
        if left <= 8 * d * _EPS * scale:
            break
    if best is None:
        raise ArithmeticError("no shift splits the spectrum")
    return best[1], best[2]


def leading(a: np.ndarray, most: int, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``most`` eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    d = len(a)
    scale = float(np.linalg.norm(a)) if scale is None else scale
    mean = np.trace(a) / d
    if d == 1 or np.linalg.norm(a - mean * np.eye(d)) <= 4 * d * _EPS * scale:  # one eigenvalue: any basis is one of eigenvectors
        order = np.argsort(-np.diag(a), kind="stable")[:most]
        return np.diag(a)[order], np.eye(d)[:, order]
    values, vectors = [], []
    for base in _split(a, scale):
        wanted = most - sum(map(len, values))
        if wanted > 0:
            part = base.T @ a @ base
            e, v = leading((part + part.T) / 2, wanted, scale)
            values.append(e)
            vectors.append(base @ v)
    return np.concatenate(values), np.hstack(vectors)


# --- aggregates over the distinct vectors -------------------------------------------------------------------------------


def codes(embedding: Column) -> Column:
    """Whole numbers floor(256 c), as longs; those beyond a long become the nearest long."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(embedding) > 0) & finite, F.lit(False))


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and their sum per dimension, exact: the halves of each number are summed apart."""

    def run(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in _matrices(batches, d):
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    parts = fit.mapInArrow(run, "i long, n long, high long, low long")
    total = parts.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]).collect()
    rows = sorted(total, key=lambda r: r.i)
    return (int(rows[0].n), [(int(r.high) << 32) + int(r.low) for r in rows]) if rows else (0, [0] * d)


@dataclass
class Centre:
    """The mean S / n, kept as whole part and rest so that centring loses no digit."""

    n: int
    sums: list[int]

    def of(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], dtype=object)
        rest = np.array([s % self.n / self.n for s in self.sums])
        if max(map(abs, whole), default=0) < 1 << 51 and np.abs(x.astype(float)).max(initial=0) < 1 << 51:
            return (x - whole.astype(np.int64)).astype(float) - rest
        return (x.astype(object) - whole).astype(float) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 per row, exact; null beyond a long."""
        top = self.n * int(np.abs(x.astype(float)).max(initial=0) + 1) + max(map(abs, self.sums), default=0)
        if top * top * x.shape[1] < 1 << 62:
            return ((x * self.n - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((x.astype(object) * self.n - np.array(self.sums, dtype=object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]


def _moments(fit: DataFrame, d: int, centre: Centre, basis: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the centred vectors, or of their products with ``basis``."""
    size = d if basis is None else basis.shape[1]

    def run(batches):
        total = np.zeros((size + 1, size))
        for _, x in _matrices(batches, d):
            y = centre.of(x) if basis is None else centre.of(x) @ basis
            total[:-1] += y.T @ y
            total[-1] += y.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    out = np.zeros((size + 1, size))
    for row in fit.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row.i, row.j] = row.v / centre.n
    mean = out[-1]
    covariance = out[:-1] - np.outer(mean, mean)
    return mean, (covariance + covariance.T) / 2


# --- operator -----------------------------------------------------------------------------------------------------------


def whiten(embeddings: DataFrame, most: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error per usable row and leading component.

    Rows take no part if the vector is null, empty, holds a null, NaN or infinite entry, or has another length
    than most usable vectors (ties: the shorter). Copies count once in the fit, but each row gets its result, a
    null or repeated vec_id too. Components without variance are left out: one vector alone, or copies of it,
    give no rows. Other columns are ignored. The driver holds a matrix of dimension x dimension.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable(F.col("embedding")))
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    d = length.d
    coded = rows.where(F.size("embedding") == d).select("vec_id", codes(F.col("embedding")).alias("x"))
    fit = materialise(coded.select("x").distinct(), "whitening-fit")
    n, sums = _sums(fit, d)
    centre = Centre(n, sums)
    _, covariance = _moments(fit, d, centre)
    trace = float(np.trace(covariance))
    values, vectors = leading(covariance, min(most, d)) if trace > 0 else (np.empty(0), np.empty((d, 0)))
    kept = values > d * _EPS * max(values, default=0.0)
    values, basis = values[kept], vectors[:, kept] / np.sqrt(values[kept])
    error = float(np.abs(_moments(fit, d, centre, basis)[1] - np.eye(len(values))).max(initial=0.0))
    shared = embeddings.sparkSession.sparkContext.broadcast((centre, basis))

    def run(batches):
        centre, basis = shared.value
        k = basis.shape[1]
        for part, x in _matrices(batches, d):
            columns = [
                pa.array(np.repeat(part.column("vec_id").to_numpy(zero_copy_only=False), k) if part.column("vec_id").null_count == 0
                         else [i for i in part.column("vec_id").to_pylist() for _ in range(k)], pa.int64()),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, centre.n)),
                pa.array([v for v in centre.deviations(x) for _ in range(k)], pa.int64()),
                pa.array((centre.of(x) @ basis).ravel()),
                pa.array(np.tile(values / trace, len(x))),
                pa.array(np.full(len(x) * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return coded.mapInArrow(run, schema)
