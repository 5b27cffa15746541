"""K-Means and friends: fits of many starts in shared scans, relational scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import col
from tabloom.operators import density, kmeans
from tabloom.operators.clean import scale_for_clustering
from tabloom.operators.neighbors import assign_nearest, kth_distance, silhouette_score, vectorised
from tabloom.operators.quantiles import column_quantiles
from tabloom.plans.recipe import Recipe
from tabloom.session import cut_lineage

MAX_CENTROIDS = 1_000


def assembled(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error").transform(df)


def from_arrays(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(col(array).cast("array<double>")))


@dataclass
class KMeansFit:
    """Centres, cost and mean squared Euclidean silhouette of the best start; ``features`` is the column it was fitted on."""

    centers: np.ndarray
    inertia: float
    silhouette: float = 0.0
    features: str = "features"

    def centroids(self) -> list[list[float]]:
        return [[float(x) for x in c] for c in self.centers]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``cluster``: the closest centre, the smallest index on ties."""
        centers = self.centers

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            m, step = np.vstack(v), max(1, 4_000_000 // centers.size)
            at = [((m[s:s + step, None, :] - centers) ** 2).sum(axis=2).argmin(axis=1) for s in range(0, len(m), step)]
            return pd.Series(np.concatenate(at).astype("int32"))

        return df.withColumn("cluster", nearest(_array(df, self.features)))


def _array(df: DataFrame, features: str) -> Column:
    """A feature column as an array of doubles; it may be one already."""
    return vector_to_array(col(features)) if isinstance(df.schema[features].dataType, VectorUDT) else col(features).cast("array<double>")


def k_means_all(df: DataFrame, ks, seed: int = 42, n_init: int = 10, max_iter: int = 300, features: str = "features", key: str | None = None) -> dict[int, KMeansFit]:
    """Best of ``n_init`` starts for every k; all of them share the scans (see ``kmeans``)."""
    v = _array(df, features)
    data = cut_lineage(df.select((col(key) if key else F.xxhash64(v)).alias("id"), v.alias("v")))
    return {k: KMeansFit(c, cost, s, features) for k, (c, cost, s) in kmeans.fit_all(data, list(ks), seed, n_init, max_iter).items()}


def k_means(df: DataFrame, k: int, seed: int = 42, n_init: int = 10, max_iter: int = 300, features: str = "features") -> KMeansFit:
    """Best of ``n_init`` starts by cost."""
    return k_means_all(df, [k], seed, n_init, max_iter, features)[k]


def _distance(v: Column, centroid: list[float]) -> Column:
    c = F.array(*[F.lit(float(x)) for x in centroid])
    return F.aggregate(F.zip_with(v, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def assign_to_centroids(df: DataFrame, vector: str, centroids: list[list[float]], out: str = "cluster") -> DataFrame:
    """Index of the closest centroid (smallest index on ties); the centroids are literals of the plan."""
    if len(centroids) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids: use neighbors.assign_nearest")
    v = col(vector).cast("array<double>")
    best = F.array_min(F.array(*[F.struct(_distance(v, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)]))
    return df.withColumns({out: best["i"], f"{out}_d2": best["d"]})


def lloyd_step(df: DataFrame, vector: str, centroids: list[list[float]]) -> DataFrame:
    """(cluster, position, value, rows): the means of the rows assigned to each centroid, one per dimension."""
    assigned = assign_to_centroids(df, vector, centroids)
    dims = len(centroids[0])
    means = [F.avg(col(vector)[i].cast("double")).alias(f"m{i}") for i in range(dims)]
    wide = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), *means)
    return wide.select("cluster", "rows", F.posexplode(F.array(*[F.col(f"m{i}") for i in range(dims)])).alias("position", "value"))


def elbow_curve(df: DataFrame, key: str, vector: str, ks: range | None = None, seed: int = 42, n_init: int = 10, exact: bool = False) -> DataFrame:
    """(k, inertia, silhouette). The silhouette is Spark's squared Euclidean one, from sums per cluster;
    ``exact`` takes the Euclidean one, which compares all rows by blocks and so costs their square.
    """
    return _curve(df, key, vector, ks, seed, n_init, exact)[0]


def _curve(df: DataFrame, key: str, vector: str, ks, seed: int, n_init: int, exact: bool) -> tuple[DataFrame, dict[int, KMeansFit]]:
    data = cut_lineage(df.select(col(key).alias("id"), col(vector).cast("array<double>").alias("v")))
    ks = list(ks or range(2, min(11, data.count() - 1) + 1))
    fits = k_means_all(data, ks, seed, n_init, features="v", key="id") if ks else {}
    score = {k: f.silhouette for k, f in fits.items()}
    if exact:
        score = {k: silhouette_score(f.transform(data).select("id", "v", F.col("cluster").alias("payload"))).first()[0] for k, f in fits.items()}
    rows = [(int(k), f.inertia, float(score[k])) for k, f in fits.items()]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double"), fits


def decide_k(curve: DataFrame) -> dict:
    best = curve.orderBy(F.desc("silhouette"), "k").first()
    if best is None:
        return {"k": None, "silhouette": None, "description": "fewer than three rows: nothing to cluster"}
    return {"k": best["k"], "silhouette": round(best["silhouette"], 4), "description": f"k = {best['k']}: highest silhouette ({best['silhouette']:.4f})"}


def decide_dbscan(df: DataFrame, key: str, cols: list[str], min_samples: int | None = None) -> dict:
    """min_samples = max(2 d, 5); eps = median distance to the min_samples-th row, the row itself counted."""
    points = vectorised(df, cols, key)
    n = df.agg(F.count(F.lit(1))).first()[0]
    k = min(min_samples or max(2 * len(cols), 5), max(n - 1, 1))
    eps = column_quantiles(kth_distance(points, k), ["distance"], [0.5])["distance"][0.5]
    return {"eps": round(eps, 4), "min_samples": k, "description": f"eps {eps:.4f}: median distance to neighbour {k}"}


def assign_new(kind: str, new: DataFrame, key: str, cols: list[str], scaler: Recipe, train: DataFrame | None = None,
               label: str = "cluster", centroids: list | None = None, train_key: str | None = None) -> DataFrame:
    """Clusters for new rows: fitted scaling, then the closest centroid, or the closest training row for DBSCAN."""
    scaled = scaler.transform(new)
    points = vectorised(scaled, cols, key)
    if kind == "kmeans":
        return assign_to_centroids(points, "v", centroids).select(F.col("id").alias(key), "cluster")
    return assign_nearest(points, vectorised(train, cols, train_key or key, label)).select(F.col("id").alias(key), F.col("label").alias("cluster"))


def noise_free_silhouette(points: DataFrame) -> DataFrame:
    """Silhouette over clustered rows only (payload >= 0)."""
    return silhouette_score(points.where("payload >= 0"))


def auto_cluster(df: DataFrame, key: str, cols: list[str], method: str = "kmeans", missing_rule: str = "mean", seed: int = 42,
                 ks: range | None = None, n_init: int = 10, exact: bool = False) -> dict:
    """Scale, choose parameters, fit: labels, decision, scaler (and centroids for K-Means). ``exact`` as in ``elbow_curve``."""
    scaled, scaler = scale_for_clustering(df, cols, missing_rule)
    if method == "dbscan":
        d = decide_dbscan(scaled, key, cols)
        labels = density.dbscan(scaled, key, cols, d["eps"], d["min_samples"])
        return {"labels": labels, "decision": d, "scaler": scaler, "centroids": None, "scaled": scaled}
    points = vectorised(scaled, cols, key)
    curve, fits = _curve(points, "id", "v", ks, seed, n_init, exact)
    d = decide_k(curve)
    if d["k"] is None:
        raise ValueError(d["description"])
    data, fit = points, fits[d["k"]]
    labels = fit.transform(data).select(F.col("id").alias(key), "cluster")
    return {"labels": labels, "decision": d, "scaler": scaler, "centroids": fit.centroids(), "scaled": scaled}


def cluster_sizes(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    return labels.groupBy(cluster).agg(F.count(F.lit(1)).alias("rows"))


