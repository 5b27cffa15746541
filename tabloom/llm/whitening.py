"""Whitening of embeddings; the covariance is diagonalised by QDWH spectral divide and conquer.

The polar factor U of a shifted covariance V - s I (dynamically weighted Halley iteration) has the eigenvalues
+1 and -1, so (U + I) / 2 projects onto the components above the shift. Orthonormal bases of its range and of the
complement cut the matrix into two smaller ones, which are split in the same way until each is a multiple of the
identity. Only this d x d matrix reaches the driver, with d at most ``MAX_DIMENSIONS``; counts, sums, both
covariances and the whitening itself run over all rows in Arrow batches, with the components broadcast.

Vectors are whole numbers: floor(64 c) + 1000000 of every entry, so sums and deviations are exact.

Nulls and odd rows: a vector that is null or holds a null, non-finite or huge entry (2**46 or more, whose
64-fold no double counts in ones) is dropped. All vectors must have one length; that is the most frequent one (of equally frequent
ones the longest), others are dropped too. Components without variance (rank below d, a single row, equal rows)
have explained 0 and whitened null. A deviation that does not fit a long is null. Without rows the result is
empty. Ids may repeat or be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DIMENSIONS = 1_024
SCALE, BASE, HUGE = 64, 1_000_000, float(1 << 46)
EPS = np.finfo(np.float64).eps


def polar(a: np.ndarray) -> np.ndarray:
    """Unitary polar factor of the symmetric matrix ``a``: inverse-free Halley steps, then Cholesky-sized solves."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 0.9 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(n))  # below the smallest singular value
    except np.linalg.LinAlgError:
        low = EPS
    low, eye = min(max(low, EPS), 1 - EPS), np.eye(n)
    for _ in range(40):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        w = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
        b = (w - 1) ** 2 / 4
        c = w + b - 1
        if c > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))[0]
            new = b / c * x + (w - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        else:
            new = b / c * x + (w - b / c) * np.linalg.solve(eye + c * x.T @ x, x.T).T
        new = (new + new.T) / 2
        low = min(low * (w + b * low**2) / (1 + c * low**2), 1 - EPS)
        step = np.linalg.norm(new - x)
        x = new
        if step <= np.cbrt(EPS) / 10 and 1 - low <= 1e-6 or step <= 10 * EPS:  # cubic: this step was the last that counts
            break
    return x


def _halves(a: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the components above and below a shift; None if all eigenvalues are equal."""
    n, middle = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - middle * np.eye(n))
    if spread <= tolerance:
        return None
    low, high, shift = middle - spread, middle + spread, float(np.median(np.diag(a)))
    start = np.random.default_rng(n).normal(size=(n, n))
    for attempt in range(200):
        p = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(float(np.trace(p))))
        if np.linalg.norm(p @ p - p) > 1e-10 * n:  # the shift is an eigenvalue
            shift += (high - low) * 1e-4 * (1 + attempt)
            continue
        if 0 < k < n:
            q = np.linalg.qr(p @ start[:, :k])[0]
            q = np.linalg.qr(np.linalg.qr(p @ q)[0], mode="complete")[0]
            return q[:, :k], q[:, k:]
        low, high = (shift, high) if k == n else (low, shift)
        shift = (low + high) / 2
    return None


def spectral(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; eigenvectors as columns) of the symmetric matrix ``a``."""
    a = (a + a.T) / 2
    tolerance = 4 * EPS * np.linalg.norm(a)
    stack, found = [(a, np.eye(len(a)))], []
    while stack:
        part, basis = stack.pop()
        halves = _halves(part, tolerance) if len(part) > 1 else None
        if halves is None:
            found.append(basis)
        else:
            stack += [(q.T @ part @ q, basis @ q) for q in halves]
    vectors = np.linalg.qr(np.hstack(found))[0]
    values = np.einsum("ji,jk,ki->i", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    return values[order], vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))] < 0, -1.0, 1.0)


def whole_numbers(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x array<bigint>) of the rows that take part."""
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < HUGE))  # NaN is above every number
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + BASE)
    return df.where(F.col(vector).isNotNull()).where(F.coalesce(fine, F.lit(False))).select(key, x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, d)


def _counts_and_sums(rows: DataFrame) -> DataFrame:
    """(d, i, s): sums by length d and dimension i; the row count at i = -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column("x")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                m = _matrix(column.filter(pa.array(lengths == d)), d) if d else np.zeros((int((lengths == 0).sum()), 0), np.int64)
                sums[d] = sums.get(d, np.zeros(d + 1, np.int64)) + np.concatenate(([len(m)], m.sum(axis=0)))
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d, np.int32)), pa.array(np.arange(-1, d, dtype=np.int32)), pa.array(s)], ["d", "i", "s"])

    return rows.select("x").mapInArrow(run, "d int, i int, s bigint").groupBy("d", "i").agg(F.sum("s").alias("s"))


def _gram(rows: DataFrame, d: int, deviations, width: int) -> np.ndarray:
    """Sum of the outer products of ``deviations(x block)`` (rows x width), added up inside the tasks first."""
    i, j = np.tril_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = deviations(_matrix(batch.column("x"), d))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    out = np.zeros((width, width))
    for r in rows.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # width squared rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


@dataclass
class Whitening:
    """What is fitted: row count, sums, unit components (columns), their variances, the total variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; columns without variance are NaN."""
        scale = np.sqrt(np.where(self.variances > 0, self.variances, np.nan))
        return self.deviations(x) @ self.components / scale


def fit(rows: DataFrame, components: int = 32) -> Whitening | None:
    """Fit on ``rows`` (x); None if there is nothing to fit."""
    totals = _counts_and_sums(rows)
    totals.cache()
    most = totals.where("i = -1").orderBy(F.desc("s"), F.desc("d")).first()
    if most is None or most["d"] == 0:
        totals.unpersist()
        return None
    d, n = most["d"], most["s"]
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries; the covariance on the driver is limited to {MAX_DIMENSIONS}")
    sums = np.array([r["s"] for r in totals.where((F.col("d") == d) & (F.col("i") >= 0)).orderBy("i").collect()], np.int64)
    totals.unpersist()
    rows, m = rows.where(F.size("x") == d), min(components, d)
    out = Whitening(n, sums, np.eye(d), np.ones(d), 1.0)
    covariance = _gram(rows, d, out.deviations, d) / n
    values, vectors = spectral(covariance)
    values = np.where(values > d * EPS * max(values[0], 0.0), values, 0.0)
    out.components, out.variances, out.total = vectors[:, :m], values[:m], float(np.trace(covariance))
    there = int((out.variances > 0).sum())
    if there:
        shared = rows.sparkSession.sparkContext.broadcast(out)
        white = _gram(rows, d, lambda x: shared.value.project(x)[:, :there], there) / n  # deviations sum to zero exactly
        out.identity_error = float(np.abs(white - np.eye(there)).max())
    return out


SCHEMA = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact sums over dimensions of (n x - sums)**2."""
    off = n * x - sums
    top = int(np.abs(off).max(initial=0))
    if top * top * off.shape[1] < 1 << 63:
        return pa.array((off * off).sum(axis=1))
    exact = [sum(v * v for v in row) for row in off.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) per remaining row and component, numbered from 1.

    ``deviation`` is the exact sum over dimensions of (n x - sums)**2, ``explained`` the component's share of the
    variance, ``identity_error`` the largest entry of the whitened rows' covariance minus the identity.
    """
    rows = whole_numbers(df, key, vector)
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, {SCHEMA}"
    model = fit(rows, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    d, m = model.components.shape
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        explained = w.variances / w.total if w.total > 0 else np.zeros(m)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            at = pa.array(np.repeat(np.arange(len(x)), m))
            white = w.project(x).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), w.n)),
                _deviation(x, w.n, w.sums).take(at), pa.array(white, mask=np.isnan(white)), pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(at), w.identity_error))], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == d).mapInArrow(run, schema)
