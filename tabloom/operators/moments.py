"""Cross-validated regressions from sums: one scan gives the second moments of every fold.

The training sums of a fold are the total minus its own, so every fold is solved in closed form (lasso: by coordinate
descent) from matrices of (terms + 2)**2 numbers, and its errors follow from its own moments. Tasks add up their rows first;
only matrices are shuffled and reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import col

MAX_TERMS = 1_024
HEAD_ROWS = 1_000  # rows that give the shift and scale; they only keep the sums small
SLICE_CELLS = 4_000_000


def powers(n: int, degree: int) -> list[tuple[int, ...]]:
    """Products of up to ``degree`` of n features, as positions."""
    return [p for d in range(1, degree + 1) for p in combinations_with_replacement(range(n), d)]


def fold_moments(data: DataFrame, fold: str, features: list[str], target: str, degree: int = 1, scaled: bool = False) -> dict[int, np.ndarray]:
    """{fold: sums of z z'} with z = (1, terms, target); features are shifted, the target too, and scaled if wanted. Rows must be complete."""
    terms = powers(len(features), degree)
    if len(terms) > MAX_TERMS:
        raise ValueError(f"{len(terms)} terms; second moments are limited to {MAX_TERMS}")
    width = len(terms) + 2
    rows = data.select(col(fold).cast("int").alias("fold"), F.array(*[col(c).cast("double") for c in [*features, target]]).alias("z"))
    head = np.array([r["z"] for r in rows.select("z").limit(HEAD_ROWS).collect()], dtype=np.float64).reshape(-1, len(features) + 1)
    shift = head.mean(axis=0) if len(head) else np.zeros(len(features) + 1)
    spread = head.std(axis=0) if scaled and len(head) else np.ones(len(features) + 1)
    spread[-1] = 1.0
    spread = np.where(spread > 0, spread, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            m = (batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(len(folds), -1) - shift) / spread
            step = max(1, SLICE_CELLS // width)
            for s in range(0, len(m), step):
                x = m[s:s + step]
                z = np.column_stack([np.ones(len(x)), *[x[:, list(p)].prod(axis=1) for p in terms], x[:, -1]])
                for f in np.unique(folds[s:s + step]).tolist():
                    own = z[folds[s:s + step] == f]
                    sums[f] = sums.get(f, 0.0) + own.T @ own
        i, j = np.tril_indices(width)
        for f, g in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), f, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])], ["fold", "i", "j", "s"])

    added = rows.mapInArrow(run, "fold int, i int, j int, s double").groupBy("fold", "i", "j").agg(F.sum("s").alias("s")).toArrow()
    out: dict[int, np.ndarray] = {}
    for f, i, j, s in zip(*(added.column(c).to_pylist() for c in ("fold", "i", "j", "s"))):
        g = out.setdefault(f, np.zeros((width, width)))
        g[i, j] = g[j, i] = s
    return out


def solve(g: np.ndarray, choice: str, alpha: float) -> np.ndarray:
    """(intercept, coefficients) from the moments of the training rows."""
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    s = g[1:, 1:] - n * np.outer(mean, mean)
    xx, xy = s[:-1, :-1], s[:-1, -1]
    if choice == "lasso":
        w, norms = np.zeros(len(xy)), np.diag(xx)
        for _ in range(10_000):
            old = w.copy()
            for j in np.flatnonzero(norms > 0):
                rest = xy[j] - xx[j] @ w + norms[j] * w[j]
                w[j] = np.sign(rest) * max(abs(rest) - n * alpha, 0.0) / norms[j]
            if np.abs(w - old).max(initial=0) <= 1e-12 * max(1.0, np.abs(w).max(initial=0)):
                break
    else:
        w = np.linalg.lstsq(xx + (alpha if choice == "ridge" else 0.0) * np.eye(len(xy)), xy, rcond=None)[0]
    return np.concatenate(([mean[-1] - mean[:-1] @ w], w))


def errors(g: np.ndarray, w: np.ndarray) -> tuple[float | None, float | None]:
    """(r2, rmse) of the rows behind the moments ``g``; r2 is null where the target does not vary."""
    c = np.concatenate((-w, [1.0]))
    n, sse = g[0, 0], max(float(c @ g @ c), 0.0)
    total = float(g[-1, -1] - g[0, -1] ** 2 / n)
    return (1 - sse / total if total > 0 else None), float(sse / n) ** 0.5


def cross_validate(data: DataFrame, features: list[str], target: str, choice: str, alpha: float, degree: int, k: int, fold: str = "fold") -> DataFrame:
    """(fold, r2, rmse) for the folds 0..k-1 of ``data``; a fold without rows, or without rows to train on, has nulls."""
    grams = fold_moments(data, fold, features, target, degree if choice == "polynomial" else 1, choice in ("linear", "polynomial"))
    total = sum(grams.values()) if grams else None
    rows = []
    for f in range(k):
        own = grams.get(f)
        fine = own is not None and total[0, 0] - own[0, 0] > 0.5
        rows.append((f, *(errors(own, solve(total - own, choice, alpha)) if fine else (None, None))))
    return data.sparkSession.createDataFrame(rows, "fold int, r2 double, rmse double")
