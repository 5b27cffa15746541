"""Cross-validation from moments against fits of every fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import metrics, models, moments
from tabloom.operators.split import k_fold


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 3)) * [1, 20, 0.1] + [0, 500, 3]
    y = x @ [2.0, -0.3, 5.0] + 0.4 * x[:, 0] ** 2 + rng.normal(size=90)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, y double").cache()


@pytest.mark.parametrize("choice,alpha", [("linear", 1.0), ("ridge", 7.0), ("lasso", 0.3), ("polynomial", 1.0)])
def test_same_as_fits(data, choice, alpha):
    got = {r.fold: r for r in models.cross_validate_regression(data, "id", ["a", "b", "c"], "y", choice, alpha, k=3).collect()}
    folds = k_fold(data, "id", 3).cache()
    for i in range(3):
        fit = models.fit_regression(folds.where(F.col("fold") != i), ["a", "b", "c"], "y", choice, alpha)
        want = metrics.regression_metrics(fit.transform(folds.where(F.col("fold") == i)), "y").first()
        assert got[i].r2 == pytest.approx(want["r2"], rel=1e-4) and got[i].rmse == pytest.approx(want["rmse"], rel=1e-4)


def test_odd_tables(spark, data):
    assert [tuple(r) for r in models.cross_validate_regression(data.limit(0), "id", ["a"], "y", k=2).collect()] == [(0, None, None), (1, None, None)]
    flat = data.withColumn("y", F.lit(3.0)).withColumn("b", F.lit(1.0))
    assert all(r.r2 is None and r.rmse == pytest.approx(0, abs=1e-9) for r in models.cross_validate_regression(flat, "id", ["a", "b"], "y", k=3).collect())
    with pytest.raises(ValueError):
        moments.fold_moments(k_fold(data, "id", 2), "fold", ["a"] * 60, "y", degree=2)
    with pytest.raises(ValueError):
        models.cross_validate_regression(data, "id", ["a"], "y", "other")
