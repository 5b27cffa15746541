"""K-Means in shared scans against numpy and Spark's own silhouette."""

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator

from tabloom.operators import cluster, kmeans


def frame(spark, pts):
    return spark.createDataFrame([(i, [float(c) for c in p]) for i, p in enumerate(pts)], "id bigint, v array<double>").repartition(3)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(2)
    return np.vstack([rng.normal(c, 0.5, (40, 3)) for c in (0, 10, 20, 30)]) + 1e5


def test_one_scan_adds_up(spark, blobs):
    rng = np.random.default_rng(3)
    shift = blobs.mean(axis=0)
    centers = [rng.normal(0, 10, (k, 3)) for k in (2, 5, 7)]
    for c, (n, cost, squares, sums) in zip(centers, kmeans.Models(centers, shift).totals(frame(spark, blobs))):
        d = ((blobs - shift)[:, None] - c) ** 2
        near = d.sum(-1).argmin(1)
        for x in range(len(c)):
            own = (blobs - shift)[near == x]
            assert n[x] == len(own) and sums[x] == pytest.approx(own.sum(axis=0), abs=1e-6)
            assert cost[x] == pytest.approx(((own - c[x]) ** 2).sum(), abs=1e-6) and squares[x] == pytest.approx((own**2).sum(), abs=1e-6)


def test_all_k_and_starts(spark, blobs):
    df = frame(spark, blobs)
    fits = cluster.k_means_all(df, [2, 3, 4, 5], features="v", key="id")
    assert max(fits, key=lambda k: fits[k].silhouette) == 4
    for k, fit in fits.items():
        d = ((blobs[:, None] - fit.centers) ** 2).sum(-1)
        assert fit.inertia == pytest.approx(d.min(1).sum(), rel=1e-9)
        for x in range(k):  # settled: every centre is the mean of its rows
            assert fit.centers[x] == pytest.approx(blobs[d.argmin(1) == x].mean(axis=0), abs=1e-3)
        labelled = fit.transform(cluster.from_arrays(df, "v"))
        assert fit.silhouette == pytest.approx(ClusteringEvaluator(predictionCol="cluster").evaluate(labelled), abs=1e-6)
    costs = [fits[k].inertia for k in (2, 3, 4, 5)]
    assert costs == sorted(costs, reverse=True)
    assert cluster.k_means(cluster.from_arrays(df, "v"), 4).inertia == pytest.approx(fits[4].inertia, rel=1e-6)  # an ML vector does too


def test_few_distinct_rows(spark):
    fits = cluster.k_means_all(frame(spark, [[1.0, 1.0]] * 20 + [[2.0, 2.0]]), [2, 3], features="v", key="id")
    assert fits[2].inertia == pytest.approx(0.0, abs=1e-9) and all(np.isfinite(f.silhouette) for f in fits.values())
    with pytest.raises(ValueError):
        cluster.k_means(frame(spark, []), 2, features="v")


def test_curve_and_choice(spark, blobs):
    curve = cluster.elbow_curve(frame(spark, blobs), "id", "v")
    assert sorted(r.k for r in curve.collect()) == list(range(2, 12))
    assert cluster.decide_k(curve)["k"] == 4
