"""The paths for large inputs, forced on small ones and checked against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import quantiles, ranking


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    a = np.round(rng.normal(size=5000) * 50, 2)
    b = np.where(rng.random(5000) < 0.4, 7.0, np.round(rng.exponential(10, 5000), 3))
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "id bigint, a double, b double").repartition(4).cache(), a, b


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("limit", [10, 300, 10**6])
def test_quantiles_match_numpy(numbers, limit):
    df, a, b = numbers
    got = quantiles.column_quantiles(df, ["a", "b"], PROBS, single_task_rows=limit)
    for name, values in (("a", a), ("b", b)):
        assert [got[name][p] for p in PROBS] == pytest.approx(list(np.quantile(values, PROBS)), abs=1e-9)


def test_quantiles_two_heavy_values(spark):
    df = spark.createDataFrame([(float(i % 2),) for i in range(1000)], "a double")
    got = quantiles.column_quantiles(df, ["a"], [0.25, 0.4995, 0.5, 0.75], single_task_rows=5)["a"]
    want = np.quantile([i % 2 for i in range(1000)], [0.25, 0.4995, 0.5, 0.75])
    assert [got[p] for p in (0.25, 0.4995, 0.5, 0.75)] == pytest.approx(list(want))


def test_row_number_by_ranges(numbers):
    df, a, _ = numbers
    out = ranking.global_row_number(df, [F.col("a"), F.col("id")], single_task_rows=10, partitions=7).orderBy("row_number").collect()
    assert [r["row_number"] for r in out] == list(range(5000))
    assert [r["id"] for r in out] == sorted(range(5000), key=lambda i: (a[i], i))


def test_running_share_by_slices(spark):
    rows = [(g, float(i), i % 7) for g in ("x", "y") for i in range(800)]
    df = spark.createDataFrame(rows, "g string, o double, w bigint")
    out = {(r["g"], r["o"]): r["before"] for r in ranking.running_share(df, ["g"], "o", "w", buckets=16, single_task_rows=10).collect()}
    total = np.concatenate([[0], np.cumsum([i % 7 for i in range(800)])[:-1]])
    assert all(out[(g, float(i))] == total[i] for g in ("x", "y") for i in range(800))


def test_hash_rank_is_a_permutation_per_group(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 10 < 8, "hot").otherwise("cold"))
    out = ranking.hash_rank(df, "id", 7, "g", bucket_digits=1)
    for g, n in (("hot", 2400), ("cold", 600)):
        assert sorted(r["rank"] for r in out.where(F.col("g") == g).collect()) == list(range(n))
    again = {r["id"]: r["rank"] for r in ranking.hash_rank(df.repartition(5), "id", 7, "g", bucket_digits=3).collect()}
    assert again == {r["id"]: r["rank"] for r in out.collect()}


def brute_tau(x, y):
    n, c, d, tx, ty = len(x), 0, 0, 0, 0
    for i in range(n):
        for j in range(i):
            s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
            c, d = c + (s > 0), d + (s < 0)
            tx, ty = tx + (x[i] == x[j]), ty + (y[i] == y[j])
    n0 = n * (n - 1) / 2
    return (c - d) / ((n0 - tx) * (n0 - ty)) ** 0.5


@pytest.mark.parametrize("bits", [2, 10])
def test_kendall_and_spearman(spark, bits):
    from tabloom.operators.association import kendall_pairs, spearman_pairs

    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, 300).astype(float)
    y = np.where(rng.random(300) < 0.3, 5.0, x + rng.integers(0, 30, 300))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, float("nan"))], "x double, y double")
    assert kendall_pairs(df, ["x", "y"], slice_bits=bits).first()["r"] == pytest.approx(brute_tau(x, y), abs=1e-12)

    def ranks(v):
        return np.array([(np.sum(v < a) + np.sum(v <= a) + 1) / 2 for a in v])

    assert spearman_pairs(df, ["x", "y"]).first()["r"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-12)
