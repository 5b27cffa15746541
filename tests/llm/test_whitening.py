"""Whitening against numpy's eigen solver, and awkward vectors."""

import math

import numpy as np
import pytest

from tabloom.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA)


def check(got, rows, components=32):
    """``got`` rows against exact integers and numpy."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    v = ((n * x - sums).astype(float) / n)
    cov = v.T @ v / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    m = min(components, x.shape[1])
    assert len(got) == n * m and {r.component for r in got} == set(range(1, m + 1))
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(m):
        white = v @ basis[:, k] / math.sqrt(values[k])
        mine = np.array([by[i, k + 1].whitened for i, _ in rows])
        assert min(np.abs(mine - white).max(), np.abs(mine + white).max()) < 1e-8
        assert by[rows[0][0], k + 1].explained == pytest.approx(values[k] / cov.trace(), rel=1e-9)
    for (i, _), exact in zip(rows, ((n * x - sums) ** 2).sum(axis=1)):
        assert by[i, 1].deviation == exact and by[i, 1].n == n
    assert all(r.identity_error < 1e-9 for r in got)


def test_against_numpy(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(c) for c in r.normal(size=9) * (1 + np.arange(9))]) for i in range(150)]
    odd = [(900, None), (901, [1.0] * 8 + [None]), (902, [math.nan] * 9), (903, [math.inf] + [0.0] * 8), (904, [1.0, 2.0]), (905, []), (906, [3e38] * 9)]
    got = whitening.whiten(vectors(spark, rows + odd)).collect()
    assert not {x.vec_id for x in got} & {i for i, _ in odd}
    check(got, rows)
    check(whitening.whiten(vectors(spark, rows), components=4).collect(), rows, 4)


def test_rank_below_dimension(spark):
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0, 0.0]), (2, [3.0, 6.0, 0.0]), (2, [2.0, 4.0, 0.0]), (None, [1.0, 2.0, 0.0])])).collect()
    assert len(got) == 12
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True), (3, True)}
    assert all(r.explained == (pytest.approx(1.0) if r.component == 1 else 0.0) and r.identity_error < 1e-9 for r in got)
    for rows in ([(5, [1.0, 2.0])], [(5, [1.0, 2.0])] * 3):
        got = whitening.whiten(vectors(spark, rows)).collect()
        assert len(got) == 2 * len(rows) and all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in got)


def test_nothing_to_fit(spark):
    for rows in ([], [(1, None), (2, [math.nan]), (3, [])]):
        df = whitening.whiten(vectors(spark, rows))
        assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_divide_and_conquer(d):
    r = np.random.default_rng(d)
    q = np.linalg.qr(r.normal(size=(d, d)))[0]
    for spectrum in (r.uniform(size=d), np.repeat([3.0, 1.0], [d - d // 2, d // 2]), np.logspace(0, -12, d), np.zeros(d), np.arange(d) - d / 2.0):
        a = (q * spectrum) @ q.T
        values, basis = whitening.spectral(a)
        top = max(np.abs(spectrum).max(), 1e-300)
        assert np.abs(values - np.sort(spectrum)[::-1]).max() <= 1e-13 * top
        assert np.abs(a @ basis - basis * values).max() <= 1e-13 * top and np.abs(basis.T @ basis - np.eye(d)).max() < 1e-13


def test_exact_beyond_a_long():
    x = np.array([[2**40, 0], [0, 0], [5, 7]])
    off = 3 * x - x.sum(axis=0)
    want = [int(a) ** 2 + int(b) ** 2 for a, b in off.tolist()]
    assert whitening._deviation(x, 3, x.sum(axis=0)).to_pylist() == [w if w < 1 << 63 else None for w in want]
