"""Neighbour joins (J7-J9), reduction (R1-R4) and clustering (K1-K10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import query, table
from tabloom.operators import cluster, density, neighbors, profile, reduce
from tabloom.operators.clean import scale_for_clustering
from tabloom.operators.split import train_test_split
from tabloom.plans.store import VersionStore
from tabloom.session import cut_lineage
from tabloom.sources.files import scratch_path

DIST = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)))"
SPLIT = "t AS (SELECT *, row_number() OVER (ORDER BY md5(vec_id::VARCHAR || '-42'), vec_id) <= ceil(0.2 * count(*) OVER ()) AS test FROM embeddings)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("bigint").alias("payload"))


def parts(spark, d):
    both = train_test_split(vectors(spark, d), "id", 0.2)
    return both.where("split = 'test'").drop("split"), both.where("split = 'train'").drop("split")


@query("j7_assign_nearest", f"""WITH {SPLIT} SELECT a.vec_id AS id, arg_min(b.label, {{'d': {DIST.format('a.embedding', 'b.embedding')}, 'i': b.vec_id}})::BIGINT AS label, round(min({DIST.format('a.embedding', 'b.embedding')}), 6) AS distance
FROM t a JOIN t b ON a.test AND NOT b.test GROUP BY 1""")
def assign_nearest(spark, d):
    new, train = parts(spark, d)
    return neighbors.assign_nearest(new, train).withColumn("distance", F.round("distance", 6))


@query("j8_knn_join", f"""WITH {SPLIT}, p AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, {DIST.format('a.embedding', 'b.embedding')} AS dd FROM t a JOIN t b ON a.test AND NOT b.test)
SELECT id, neighbour, round(dd, 6) AS distance, row_number() OVER (PARTITION BY id ORDER BY dd, neighbour)::INT AS rank FROM p QUALIFY rank <= 5""")
def knn_join(spark, d):
    new, train = parts(spark, d)
    return neighbors.nearest(new, train, 5).withColumn("distance", F.round("distance", 6))


@query("j9_range_join", """SELECT a.s_suppkey AS left_id, b.c_custkey AS right_id, round(sqrt((a.s_acctbal - b.c_acctbal) ** 2 + (a.s_nationkey - b.c_nationkey) ** 2), 6) AS distance
FROM supplier a JOIN customer b ON (a.s_acctbal - b.c_acctbal) ** 2 + (a.s_nationkey - b.c_nationkey) ** 2 <= 2500""")
def range_join(spark, d):
    out = density.range_pairs(table(spark, d, "supplier"), table(spark, d, "customer"), ["s_acctbal", "s_nationkey"], ["c_acctbal", "c_nationkey"], "s_suppkey", "c_custkey", 50.0)
    return out.withColumn("distance", F.round("distance", 6))


@query("r1_pca_scores")
def pca_scores(spark, d):
    return reduce.pca_columns(table(spark, d, "lineitem").withColumn("row", F.monotonically_increasing_id()), "row", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2)[0]


TWO = """s AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)"""


@query("r1_pca_two_columns", """WITH s AS (SELECT avg(l_quantity) AS ma, stddev_pop(l_quantity) AS sa, avg(l_extendedprice) AS mb, stddev_pop(l_extendedprice) AS sb, sign(corr(l_quantity, l_extendedprice)) AS g FROM lineitem)
SELECT l_orderkey, l_partkey, round(((l_quantity - ma) / sa + g * (l_extendedprice - mb) / sb) / sqrt(2), 4) AS pc1 FROM lineitem, s""")
def pca_two(spark, d):
    li = table(spark, d, "lineitem").withColumn("row", F.struct("l_orderkey", "l_partkey"))
    out, _ = reduce.pca_columns(li, "row", ["l_quantity", "l_extendedprice"], 1)
    return out.select("row.l_orderkey", "row.l_partkey", F.round("pc1", 4).alias("pc1"))


@query("r2_explained_variance", f"""WITH {TWO} SELECT 1::INT AS component, round((1 + r) * 50, 2) AS explained_pct, round((1 + r) * 50, 2) AS cumulative_pct FROM s
UNION ALL SELECT 2, round((1 - r) * 50, 2), round(round((1 + r) * 50, 2) + round((1 - r) * 50, 2), 2) FROM s""")
def explained(spark, d):
    _, fit = reduce.pca_columns(table(spark, d, "lineitem"), "l_orderkey", ["l_quantity", "l_extendedprice"], 2)
    return fit.explained(spark).withColumn("cumulative_pct", F.round("cumulative_pct", 2))


@query("r3_loadings", "SELECT unnest(['l_quantity', 'l_extendedprice']) AS feature, unnest([round(1 / sqrt(2), 6), round(1 / sqrt(2), 6) * sign(corr(l_quantity, l_extendedprice))]) AS pc1 FROM lineitem")
def loadings(spark, d):
    _, fit = reduce.pca_columns(table(spark, d, "lineitem"), "l_orderkey", ["l_quantity", "l_extendedprice"], 1)
    return fit.loading_table(spark).withColumn("pc1", F.round("pc1", 6))


@query("r4_restore_features", "SELECT p_partkey, p_size, p_retailprice FROM part")
def restore(spark, d):
    store = VersionStore(spark, scratch_path(spark, "restore"))
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    before = store.save(p, "features")
    store.save(reduce.pca_columns(p, "p_partkey", ["p_size", "p_retailprice"], 1)[0], "reduced", before)
    parent = store.versions().where(F.col("version") == store.latest("reduced")).first()["source_version"]
    return store.read(parent)


def part_vectors(spark, d):
    scaled, _ = scale_for_clustering(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"])
    return scaled


@query("k1_k_means")
def k_means(spark, d):
    data = cluster.from_arrays(vectors(spark, d), "v").persist()
    out = cut_lineage(cluster.k_means(data, 10).transform(data).select("id", "cluster"))
    data.unpersist()
    return out


CENTRES = [[5.0, 20000.0], [25.0, 40000.0], [45.0, 80000.0]]
LLOYD = "a AS (SELECT l_quantity AS x, l_extendedprice AS y, list_position(ds, list_min(ds)) - 1 AS cluster FROM (SELECT *, [" + ", ".join(f"(l_quantity - {x}) ** 2 + (l_extendedprice - {y}) ** 2" for x, y in CENTRES) + "] AS ds FROM lineitem))"


@query("k1a_lloyd_step", f"""WITH {LLOYD} SELECT cluster::INT AS cluster, count(*) AS rows, 0::INT AS position, round(avg(x), 4) AS value FROM a GROUP BY 1 UNION ALL SELECT cluster::INT, count(*), 1, round(avg(y), 4) FROM a GROUP BY 1""")
def lloyd(spark, d):
    li = table(spark, d, "lineitem").select(F.array("l_quantity", "l_extendedprice").alias("v"))
    return cluster.lloyd_step(li, "v", CENTRES).withColumn("value", F.round("value", 4))


@query("k2_elbow_curve")
def elbow(spark, d):
    return cluster.elbow_curve(vectors(spark, d), "id", "v")


SIL = f"""p AS (SELECT a.vec_id, a.label AS own, b.label AS c, sum({DIST.format('a.embedding', 'b.embedding')}) AS s FROM embeddings a, embeddings b GROUP BY 1, 2, 3),
n AS (SELECT label AS c, count(*) AS n FROM embeddings GROUP BY 1),
ab AS (SELECT vec_id, max(CASE WHEN own = c AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> c THEN s / n END) AS b FROM p JOIN n USING (c) GROUP BY 1),
sil AS (SELECT vec_id, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


@query("k3_silhouette", f"WITH {SIL} SELECT vec_id AS id, round(s, 6) AS s FROM sil")
def silhouette(spark, d):
    return neighbors.silhouette(vectors(spark, d)).withColumn("s", F.round("s", 6))


@query("k3_silhouette_score", f"WITH {SIL} SELECT round(avg(s), 6) AS silhouette FROM sil")
def silhouette_score(spark, d):
    return neighbors.silhouette_score(vectors(spark, d)).withColumn("silhouette", F.round("silhouette", 6))


def dbscan_sql(source, eps, k):
    return f"""WITH RECURSIVE pts AS (SELECT {source}), e AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM pts a JOIN pts b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {eps} * {eps}),
core AS MATERIALIZED (SELECT u AS id FROM e GROUP BY u HAVING count(*) >= {k}),
ce AS MATERIALIZED (SELECT u, v FROM e WHERE u IN (SELECT id FROM core) AND v IN (SELECT id FROM core)),
reach AS (SELECT id, id AS root FROM core UNION SELECT ce.v, r.root FROM reach r JOIN ce ON ce.u = r.id WHERE ce.v > r.root),
lab AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM lab)),
border AS (SELECT e.u AS id, min(lab.root) AS root FROM e JOIN lab ON lab.id = e.v WHERE e.u NOT IN (SELECT id FROM core) GROUP BY 1),
every AS (SELECT id, root, true AS core FROM lab UNION ALL SELECT id, root, false FROM border)"""


SUPP = "s_suppkey AS id, s_acctbal / 1000 AS x, s_nationkey::DOUBLE AS y FROM supplier"


@query("k4_dbscan", dbscan_sql(SUPP, 1.5, 4) + " SELECT pts.id, coalesce(cluster, -1)::INT AS cluster, coalesce(core, false) AS core FROM pts LEFT JOIN every USING (id) LEFT JOIN num USING (root)")
def dbscan(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return density.dbscan(s, "id", ["x", "y"], 1.5, 4)


@query("k4_dbscan_vectors")
def dbscan_vectors(spark, d):
    e = table(spark, d, "embeddings")
    return density.dbscan_vectors(e, "vec_id", "embedding", 64, 0.9, 5)


@query("k5_cluster_counts", dbscan_sql(SUPP, 1.5, 4) + " SELECT (SELECT count(*) FROM num) AS clusters, (SELECT count(*) FROM pts WHERE id NOT IN (SELECT id FROM every)) AS noise, count(*) AS rows FROM pts")
def cluster_counts(spark, d):
    return density.cluster_counts(dbscan(spark, d))


@query("k5_noise_free_silhouette", f"""WITH v AS (SELECT * FROM embeddings WHERE label <> 0), {SIL.replace('embeddings', 'v')} SELECT round(avg(s), 6) AS silhouette FROM sil""")
def noise_free(spark, d):
    pts = vectors(spark, d).withColumn("payload", F.when(F.col("payload") == 0, -1).otherwise(F.col("payload")))
    return cluster.noise_free_silhouette(pts).withColumn("silhouette", F.round("silhouette", 6))


@query("k6_decide_k")
def decide_k(spark, d):
    out = cluster.decide_k(elbow(spark, d))
    return spark.createDataFrame([(out["k"], out["silhouette"])], "k int, silhouette double")


@query("k7_decide_dbscan", f"""WITH p AS (SELECT a.vec_id, {DIST.format('a.embedding', 'b.embedding')} AS dd FROM embeddings a, embeddings b),
k AS (SELECT vec_id, dd FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dd) = 128) SELECT round(median(dd), 4) AS eps, 128::INT AS min_samples FROM k""")
def decide_dbscan(spark, d):
    cols = [f"e{i}" for i in range(64)]
    e = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    out = cluster.decide_dbscan(e, "vec_id", cols)
    return spark.createDataFrame([(out["eps"], out["min_samples"])], "eps double, min_samples int")


@query("k8_assign_new", """WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM customer)
SELECT s_suppkey, (list_position(ds, list_min(ds)) - 1)::INT AS cluster FROM (SELECT s_suppkey, list_transform([-1.0, 0.0, 1.0], lambda c: ((s_acctbal - m) / sd - c) ** 2) AS ds FROM supplier, s)""")
def assign_new(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    _, scaler = scale_for_clustering(c, ["balance"])
    new = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"))
    return cluster.assign_new("kmeans", new, "s_suppkey", ["balance"], scaler, centroids=[[-1.0], [0.0], [1.0]])


@query("k8_assign_new_dbscan", """WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM customer), c AS (SELECT c_custkey, (c_acctbal - m) / sd AS b, CASE WHEN c_acctbal < 0 THEN -1 ELSE c_nationkey % 3 END AS cluster FROM customer, s),
n AS (SELECT s_suppkey, (s_acctbal - m) / sd AS b FROM supplier, s) SELECT s_suppkey, arg_min(cluster, {'d': abs(n.b - c.b), 'k': c_custkey})::INT AS cluster FROM n, c GROUP BY 1""")
def assign_new_dbscan(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.when(F.col("c_acctbal") < 0, -1).otherwise(F.col("c_nationkey") % 3).alias("cluster"))
    scaled, scaler = scale_for_clustering(c, ["balance"])
    new = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"))
    return cluster.assign_new("dbscan", new, "s_suppkey", ["balance"], scaler, train=scaled, train_key="c_custkey")


@query("k9_cluster_sizes", f"WITH {LLOYD} SELECT cluster::INT AS cluster, count(*) AS rows FROM a GROUP BY 1")
def sizes(spark, d):
    li = table(spark, d, "lineitem").select(F.array("l_quantity", "l_extendedprice").alias("v"))
    return cluster.cluster_sizes(cluster.assign_to_centroids(li, "v", CENTRES))


@query("k9_cluster_means", f"WITH {LLOYD} SELECT cluster::INT AS cluster, round(avg(x), 3) AS l_quantity, round(avg(y), 3) AS l_extendedprice FROM a GROUP BY 1")
def means(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", F.array("l_quantity", "l_extendedprice").alias("v"))
    return profile.grouped_means(cluster.assign_to_centroids(li, "v", CENTRES), "cluster", ["l_quantity", "l_extendedprice"])


@query("k10_auto_k_means")
def auto_k_means(spark, d):
    p = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("nation"))
    return cluster.auto_cluster(p, "s_suppkey", ["s_acctbal", "nation"])["labels"]


@query("k10_auto_dbscan")
def auto_dbscan(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), "p_retailprice")
    return cluster.auto_cluster(p, "p_partkey", ["size", "p_retailprice"], "dbscan")["labels"]
