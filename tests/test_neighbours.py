"""Neighbour joins, components and density clusters against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import cluster, components, density, neighbors


def points_df(spark, pts, labels=None):
    rows = [(i, [float(x) for x in p], None if labels is None else int(labels[i])) for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, "id bigint, v array<double>, payload bigint").repartition(3)


def brute_dbscan(pts, eps, k):
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    near = d <= eps
    core = near.sum(1) >= k
    label = np.full(len(pts), -1)
    c = 0
    for i in range(len(pts)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], c
            while todo:
                j = todo.pop()
                for m in np.nonzero(near[j] & core & (label < 0))[0]:
                    label[m] = c
                    todo.append(m)
            c += 1
    out = label.copy()
    for i in np.nonzero(~core)[0]:
        hits = label[near[i] & core]
        out[i] = hits.min() if len(hits) else -1
    return out, core


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(5)
    dense = rng.normal(0, 0.15, (250, 2))
    strip = np.c_[np.linspace(1, 6, 120), rng.normal(0, 0.05, 120)]
    noise = rng.uniform(-8, 8, (60, 2))
    copies = np.repeat([[4.0, 4.0]], 40, axis=0)
    pts = np.vstack([dense, strip, noise, copies])
    return pts[rng.permutation(len(pts))]


@pytest.mark.parametrize("eps,k", [(0.3, 5), (0.1, 4), (1.0, 8), (0.05, 2)])
@pytest.mark.parametrize("direct", [10**6, 0])
def test_dbscan_grid(spark, blobs, eps, k, direct):
    want, core = brute_dbscan(blobs, eps, k)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(blobs)], "id bigint, x double, y double")
    got = {r["id"]: (r["cluster"], r["core"]) for r in density.dbscan(df, "id", ["x", "y"], eps, k, direct_pairs=direct).collect()}
    assert [got[i][0] for i in range(len(blobs))] == list(want)
    assert [got[i][1] for i in range(len(blobs))] == list(core)


def test_dbscan_blocks(spark):
    rng = np.random.default_rng(6)
    pts = np.vstack([rng.normal(c, 0.4, (40, 6)) for c in (0, 2, 5)])
    want, _ = brute_dbscan(pts, 1.2, 5)
    df = points_df(spark, pts)
    got = {r["id"]: r["cluster"] for r in density.dbscan_vectors(df, "id", "v", 6, 1.2, 5).collect()}
    assert [got[i] for i in range(len(pts))] == list(want)


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(90)] + [(2000, 2000 + i) for i in range(50)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {a: find(a) for a in list(parent)}


def test_nearest_and_kth_distance_in_blocks(spark):
    rng = np.random.default_rng(8)
    pts = rng.integers(-9, 9, (150, 3)).astype(float)
    df = points_df(spark, pts)
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    out = neighbors.nearest(df, df, 4, exclude_self=True, block_rows=40).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append(r["neighbour"])
    for i in range(150):
        want = sorted((j for j in range(150) if j != i), key=lambda j: (d[i, j], j))[:4]
        assert got[i] == want
    kth = {r["id"]: r["distance"] for r in neighbors.kth_distance(df, 5).collect()}
    assert all(kth[i] == pytest.approx(np.sort(d[i])[4]) for i in range(150))


def test_silhouette_single_member_cluster(spark):
    pts = np.array([[0.0], [0.1], [5.0], [5.2], [9.0]])
    labels = [0, 0, 1, 1, 2]
    got = {r["id"]: r["s"] for r in neighbors.silhouette(points_df(spark, pts, labels)).collect()}
    assert got[4] == 0.0
    assert got[0] == pytest.approx((5.1 - 0.1) / 5.1)


def test_range_pairs_match_brute_force(spark, blobs):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(blobs)], "id bigint, x double, y double")
    got = {(r["left_id"], r["right_id"]) for r in density.range_pairs(df, df.select(F.col("id").alias("k"), F.col("x").alias("p"), F.col("y").alias("q")), ["x", "y"], ["p", "q"], "id", "k", 0.2).collect()}
    d2 = ((blobs[:, None] - blobs[None]) ** 2).sum(-1)
    assert got == set(zip(*map(lambda a: a.tolist(), np.nonzero(d2 <= 0.2 * 0.2))))


def test_lloyd_matches_numpy(spark):
    rng = np.random.default_rng(9)
    pts = rng.normal(size=(80, 2))
    centres = [[0.0, 0.0], [1.0, 1.0], [-1.0, 0.5]]
    near = ((pts[:, None] - np.array(centres)[None]) ** 2).sum(-1).argmin(1)
    rows = cluster.lloyd_step(points_df(spark, pts), "v", centres).collect()
    for r in rows:
        assert r["value"] == pytest.approx(pts[near == r["cluster"]].mean(0)[r["position"]])


@pytest.mark.parametrize("block_rows", [25, 60])
def test_pivots_keep_all_neighbours(spark, monkeypatch, block_rows):
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 12)
    rng = np.random.default_rng(10)
    pts = np.vstack([rng.integers(-6, 6, (120, 4)) + c for c in (0, 40, 90)] + [np.full((60, 4), 40)]).astype(float)
    df = points_df(spark, pts, np.arange(len(pts)))
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    got = {}
    for r in sorted(neighbors.nearest(df, df, 3, block_rows=block_rows).collect(), key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert all(got[i] == sorted(range(len(pts)), key=lambda j: (d[i, j], j))[:3] for i in range(len(pts)))
    counts = {r["id"]: r["n"] for r in neighbors.neighbour_counts(df, 5.0, block_rows).collect()}
    assert [counts[i] for i in range(len(pts))] == list((d <= 5.0).sum(1))
    least = {r["id"]: r["label"] for r in neighbors.least_label_within(df, df.withColumn("label", F.col("payload")), 5.0, block_rows).collect()}
    assert [least[i] for i in range(len(pts))] == [int(np.nonzero(d[i] <= 5.0)[0].min()) for i in range(len(pts))]


def test_pivots_rule_out_far_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 20)
    rng = np.random.default_rng(12)
    pts = np.vstack([rng.normal(c, 1, (100, 3)) for c in (0, 500, 1000, 1500)])
    df = points_df(spark, pts)
    tree, placed = neighbors.plant(df, 400)
    m = np.array(pts)
    far = np.full(400, np.inf)
    visits = tree.visits(m, far, 3, np.zeros(400))
    assert tree.rows.sum() == 400 == placed.count()
    assert sum(int(tree.rows[leaves].sum()) for leaves, _ in visits) <= 400 * 100


@pytest.mark.parametrize("exclude", [False, True])
def test_tree_in_many_dimensions(spark, monkeypatch, exclude):
    """Rounds over a tree of two levels give the exact neighbours, ties by id, in 24 dimensions and with copies."""
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 20)
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(12, 24)) * 4
    pts = np.vstack([rng.normal(c, 0.3, (50, 24)) for c in centres] + [np.repeat(centres[:1], 30, axis=0), rng.normal(size=(40, 24)) * 5])
    pts = pts[rng.permutation(len(pts))]
    df = points_df(spark, pts)
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    got = {}
    for r in sorted(neighbors.nearest(df, df, 4, exclude_self=exclude, block_rows=60).collect(), key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append((r["neighbour"], r["distance"]))
    for i in range(len(pts)):
        want = sorted((j for j in range(len(pts)) if not (exclude and i == j)), key=lambda j: (d[i, j], j))[:4]
        assert [n for n, _ in got[i]] == want and [x for _, x in got[i]] == pytest.approx(d[i, want])


def test_rows_moved_grow_slowly(monkeypatch):
    """Rows compared per query in clustered 64-dimensional data: 16 times the rows, a small factor more."""
    rng, per_query = np.random.default_rng(14), []
    centres = rng.normal(size=(400, 64)) * 2
    for n in (5_000, 80_000):
        pts = centres[rng.integers(0, 400, n)] + 0.2 * rng.normal(size=(n, 64))
        tree = neighbors.PivotTree.of(pts[:4_000], neighbors.PivotTree.wanted(n, 64) * 4)
        leaf, r, top = tree.place(pts)
        tree.rows = np.bincount(leaf, minlength=len(tree.leaves))
        np.maximum.at(tree.radius, leaf, r)
        np.maximum.at(tree.top_radius, np.searchsorted(tree.first, leaf, side="right") - 1, top)
        q = pts[:200]
        near = [np.sort(np.sqrt(((pts[leaf == tree.visits(x[None], np.full(1, np.inf), 5, np.zeros(1))[0][0][0]] - x) ** 2).sum(axis=1)))[:5] for x in q]
        reach = np.array([x[-1] if len(x) == 5 else np.inf for x in near])
        per_query.append(np.mean([tree.rows[leaves].sum() for leaves, _ in tree.visits(q, reach, 5, np.zeros(len(q)))]))
    assert per_query[1] < 8 * per_query[0], per_query


def test_queries_travel_once_per_bundle(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 10)
    rng = np.random.default_rng(12)
    pts = rng.normal(size=(600, 32))  # nothing can be ruled out
    answers, real = [], neighbors._at_leaves

    def counted(*args):
        found = real(*args)
        answers.append(found.count())
        return found

    monkeypatch.setattr(neighbors, "_at_leaves", counted)
    got = {(r["id"], r["rank"]): r["neighbour"] for r in neighbors.nearest(points_df(spark, pts), points_df(spark, pts), 8, block_rows=300).collect()}
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    want = np.argsort(d, axis=1, kind="stable")[:, :8]
    assert got == {(i, j + 1): int(want[i, j]) for i in range(600) for j in range(8)}
    assert answers[-1] < 600 * 8 * 12  # 60 leaves with 8 rows each before


def test_range_join_broadcasts_nothing(spark):
    df = spark.range(10).selectExpr("id AS k", "id AS x", "id AS y")
    plan = density.range_pairs(df, df, ["x", "y"], ["x", "y"], "k", "k", 2.0)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
