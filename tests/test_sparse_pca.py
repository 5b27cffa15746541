"""Components of long sparse rows against a dense solution."""

import numpy as np
import pytest

from tabloom.operators import reduce


def sparse(n, d, seed=3, flat=False):
    r = np.random.default_rng(seed)
    x = r.random((n, d)) * (r.random((n, d)) < 0.15)
    if not flat:
        x[:, :3] += (r.random((n, 3)) < 0.3) * np.array([6.0, 4.0, 2.5])
    x[:4] = 0  # documents without terms
    return x


def long_rows(spark, x):
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return spark.createDataFrame(rows, "doc_id long, index int, weight double").repartition(5)


def dense(x, k):
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / (len(x) - 1))
    return values[::-1][:k] / values.sum(), reduce._signed(vectors[:, ::-1][:, :k]), c


@pytest.mark.parametrize("flat,basis", [(False, None), (True, None), (True, 60 * 24)])
def test_like_the_dense_solution(spark, monkeypatch, flat, basis):
    if basis:
        monkeypatch.setattr(reduce, "MAX_BASIS", basis)  # restarts
    monkeypatch.setattr(reduce, "PIECE", 400)  # many pieces in a batch
    x, k = sparse(220, 60, flat=flat), 4
    rows = reduce.sparse_rows(long_rows(spark, x))
    fit = reduce.fit_sparse_pca(rows, len(x), 60, k, oversample=4, tolerance=1e-8)
    shares, loadings, centred = dense(x, k)
    assert np.allclose(fit.shares, shares, rtol=1e-9)
    angles = np.linalg.svd(np.array(fit.loadings).T @ loadings)[1]
    assert angles.min() > 1 - 1e-9
    assert np.allclose(fit.loadings, loadings, atol=1e-5) and np.allclose(fit.means, x.mean(axis=0))
    docs = spark.range(len(x)).withColumnRenamed("id", "doc_id")
    got = sorted(map(tuple, reduce.sparse_scores(rows, docs, fit).collect()))
    assert len(got) == len(x) and np.allclose(np.array(got)[:, 1:], centred @ np.array(fit.loadings))


def test_fewer_components_than_asked(spark):
    x = np.outer(np.arange(1.0, 9.0), [1.0, 0, 2, 0, 3])
    fit = reduce.fit_sparse_pca(reduce.sparse_rows(long_rows(spark, x)), len(x), 5, 3)
    assert np.allclose(fit.shares, [1.0]) and np.allclose(np.array(fit.loadings)[:, 0], np.array([1, 0, 2, 0, 3]) / np.sqrt(14))


def test_bounds(spark):
    rows = reduce.sparse_rows(long_rows(spark, sparse(10, 6)))
    with pytest.raises(ValueError):
        reduce.fit_sparse_pca(rows, 10, 1_000_000, 2)
    with pytest.raises(ValueError):
        reduce.fit_sparse_pca(rows, 1, 6, 2)
