"""K-Means for many k and many starts at once: every Lloyd round is one scan for all models still moving.

Each task adds up counts, costs and sums of all models for its rows and returns them once, so what is shuffled and
what reaches the driver depends on models, clusters and dimensions (at most ``MAX_CELLS`` numbers), not on rows.
Starts are k-means++ draws from at most ``SEED_ROWS`` rows chosen by hash (a documented bound of the seeding only);
assignment, means, costs and silhouettes cover all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED_ROWS, SEED_CELLS = 20_000, 8_000_000
MAX_CELLS = 20_000_000
SLICE_CELLS = 4_000_000


def _rows(column: pa.Array, shift: np.ndarray) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, len(shift)) - shift


def _slices(batches: Iterator[pa.RecordBatch], shift: np.ndarray, width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        m = _rows(batch.column(0), shift)
        step = max(1, SLICE_CELLS // max(width, 1))
        for s in range(0, len(m), step):
            yield m[s:s + step]


def _squared(m: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((m * m).sum(axis=1)[:, None] - 2 * m @ centers.T + (centers * centers).sum(axis=1), 0.0)


def plus_plus(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k starting centres, each drawn with odds by the squared distance to those drawn before."""
    r = np.random.default_rng(seed)
    chosen = [points[r.integers(len(points))]]
    far = _squared(points, np.array(chosen))[:, 0]
    while len(chosen) < k:
        total = far.sum()
        at = r.choice(len(points), p=far / total) if total > 0 else r.integers(len(points))
        chosen.append(points[at])
        far = np.minimum(far, _squared(points, points[at][None])[:, 0])
    return np.array(chosen)


class Models:
    """Centres of several models, stacked; rows are shifted by ``shift`` to keep the squares small."""

    def __init__(self, centers: list[np.ndarray], shift: np.ndarray):
        self.centers, self.shift = centers, shift
        self.first = np.cumsum([0] + [len(c) for c in centers])

    def totals(self, data: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, cost, sum of squares, sums) per cluster of each model, in one scan of ``data`` (v)."""
        d, k = len(self.shift), int(self.first[-1])
        if k * (d + 3) > MAX_CELLS:
            raise ValueError(f"{k} clusters of {d} dimensions in all models exceed {MAX_CELLS} sums")
        shared = data.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models = shared.value
            every, out = np.vstack(models.centers), np.zeros((k, d + 3))
            for m in _slices(batches, models.shift, k):
                near, norm = _squared(m, every), (m * m).sum(axis=1)
                for a, b in zip(models.first, models.first[1:]):
                    best = near[:, a:b].argmin(axis=1)
                    hot = np.zeros((b - a, len(m)))
                    hot[best, np.arange(len(m))] = 1.0
                    out[a:b, 0] += hot.sum(axis=1)
                    out[a:b, 1] += hot @ near[np.arange(len(m)), a + best]
                    out[a:b, 2] += hot @ norm
                    out[a:b, 3:] += hot @ m
            i, j = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(out[i, j])], ["i", "j", "s"])

        table = data.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
        out = np.zeros((k, d + 3))
        out[table.column("i").to_numpy(), table.column("j").to_numpy()] = table.column("s").to_numpy()
        return [(x[:, 0], x[:, 1], x[:, 2], x[:, 3:]) for x in (out[a:b] for a, b in zip(self.first, self.first[1:]))]

    def silhouettes(self, data: DataFrame, totals) -> list[float]:
        """Mean squared Euclidean silhouette of each model, from sums per cluster, in one scan."""
        shared = data.sparkSession.sparkContext.broadcast((self, totals))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, sums = shared.value
            out = np.zeros(len(models.centers))
            for m in _slices(batches, models.shift, int(models.first[-1])):
                norm = (m * m).sum(axis=1)
                for x, (center, (n, _, squares, total)) in enumerate(zip(models.centers, sums)):
                    own, at = _squared(m, center).argmin(axis=1), np.arange(len(m))
                    all_to = norm[:, None] * n + squares - 2 * m @ total.T  # sums of squared distances to a cluster's rows
                    a = all_to[at, own] / np.maximum(n[own] - 1, 1)
                    mean = np.where(n > 0, all_to / np.maximum(n, 1), np.inf)
                    mean[at, own] = np.inf
                    b = mean.min(axis=1, initial=np.inf)
                    top = np.maximum(a, b)
                    fine = (n[own] > 1) & np.isfinite(b) & (top > 0)
                    out[x] += np.where(fine, (b - a) / np.where(fine, top, 1.0), 0.0).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["i", "s"])

        found = data.select("v").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # a row per model
        out = {r["i"]: r["s"] for r in found}
        return [out[x] / max(totals[x][0].sum(), 1) for x in range(len(totals))]


def fit_all(data: DataFrame, ks: list[int], seed: int = 42, n_init: int = 10, max_iter: int = 300, tol: float = 1e-4) -> dict[int, tuple[np.ndarray, float, float]]:
    """{k: (centres, cost, silhouette)} of the cheapest start for each k. ``data`` has ``id`` and ``v`` of one length; store it first."""
    head = data.select(F.size("v")).first()
    if head is None:
        raise ValueError("nothing to cluster")
    most = max(min(SEED_ROWS, SEED_CELLS // max(1, head[0])), max(ks))
    sample = np.array([r["v"] for r in data.select("v").orderBy(F.xxhash64("id"), "id").limit(most).collect()], dtype=np.float64)
    shift = sample.mean(axis=0)
    centers = {(k, s): plus_plus(sample - shift, k, seed + s) for k in ks for s in range(n_init)}
    moving = list(centers)
    for _ in range(max_iter):
        found = Models([centers[m] for m in moving], shift).totals(data)
        still = []
        for m, (n, _, _, sums) in zip(moving, found):
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers[m])  # a cluster without rows stays
            if ((new - centers[m]) ** 2).sum(axis=1).max() > tol**2:
                still.append(m)
            centers[m] = new
        moving = still
        if not moving:
            break
    every = Models(list(centers.values()), shift)
    totals = dict(zip(centers, every.totals(data)))
    best = {k: min((m for m in centers if m[0] == k), key=lambda m: (totals[m][1].sum(), m)) for k in ks}
    chosen = Models([centers[m] for m in best.values()], shift)
    scores = chosen.silhouettes(data, [totals[m] for m in best.values()])
    return {k: (centers[m] + shift, float(totals[m][1].sum()), float(s)) for (k, m), s in zip(best.items(), scores)}
