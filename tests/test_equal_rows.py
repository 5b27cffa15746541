"""DBSCAN where most rows have copies: the decided radius is zero."""

from tabloom.operators import cluster, density


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_radius_of_zero_joins_equal_rows(spark):
    data = [(i, float(i % 3), -0.0 if i % 2 else 0.0) for i in range(18)] + [(50, 9.0, 9.0), (51, 9.0, 9.0)]
    out = density.dbscan(spark.createDataFrame(data, "id bigint, x double, y double"), "id", ["x", "y"], 0.0, 6)
    assert rows(out) == [(i, i % 3, True) for i in range(18)] + [(50, -1, False), (51, -1, False)]


def test_auto_dbscan_of_equal_rows(spark):
    data = [(i, float(i % 4), float(i % 2)) for i in range(40)] + [(99, 77.0, 3.0)]
    found = cluster.auto_cluster(spark.createDataFrame(data, "id bigint, x double, y double"), "id", ["x", "y"], "dbscan")
    assert found["decision"]["eps"] == 0.0
    assert rows(found["labels"]) == [(i, i % 4, True) for i in range(40)] + [(99, -1, False)]
