"""Fusion of table, text and image features; versions, replayable recipes and training runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.columns import col, numeric_columns
from tabloom.operators import clean, cluster, models
from tabloom.operators.explore import column_utility
from tabloom.operators.relational import build_combined, match_records, missing_files
from tabloom.plans import store as st
from tabloom.plans.recipe import Recipe, replay_chain

RUNS = (
    "run int, version int, task_type string, target string, features array<string>, model_choice string, "
    "metric_name string, metric_value double, log array<string>"
)
TASKS = ("regression", "classification", "clustering")

# A text pipeline maps (id, text) to (id, features...); an image pipeline maps (id, image) likewise.
Pipeline = Callable[[DataFrame], DataFrame]


def default_features(df: DataFrame, exclude: list[str] = (), id_col: str | None = None) -> list[str]:
    """Numeric columns without excluded ones, both copies of the id, near-constant and id-like columns."""
    banned = {*exclude, *([id_col, f"struct__{id_col}"] if id_col else [])}
    cols = [c for c in numeric_columns(df) if c not in banned]
    return [c for c, useful, _, _ in column_utility(df, cols) if useful] if cols else []


def wide_terms(long: DataFrame, vocabulary: DataFrame, ids: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """Long term weights to one column per term (absent terms 0), for vocabularies of column size."""
    terms = [r["term"] for r in vocabulary.orderBy("index").select("term").collect()]
    if len(terms) > 2_000:
        raise ValueError("too many terms for columns: keep the long or the vector form")
    wide = long.groupBy("doc_id").pivot("term", terms).agg(F.first("weight"))
    named = wide.select(F.col("doc_id").alias(key), *[F.coalesce(col(t), F.lit(0.0)).alias(prefix + t) for t in terms])
    return ids.select(key).join(named, key, "left").fillna(0.0, [prefix + t for t in terms])


class FusionSession:
    """Versions of the combined table, the recipe behind each of them, and the runs trained on them."""

    def __init__(self, spark: SparkSession, root: str, id_col: str):
        self.spark, self.root, self.id_col = spark, root.rstrip("/"), id_col
        self.store = st.VersionStore(spark, root)
        self.fits: dict[int, dict] = {}

    # ---- data ----

    def combine(self, struct: DataFrame, text: DataFrame | None = None, image: DataFrame | None = None, text_pipeline: Pipeline | None = None,
                image_pipeline: Pipeline | None = None, label: str = "combined") -> int:
        text = text_pipeline(text) if text_pipeline and text is not None else text
        image = image_pipeline(image) if image_pipeline and image is not None else image
        return self.store.save(build_combined(struct, self.id_col, text, image), label)

    def preprocess(self, version: int, algorithm: str = "linear_regression", target: str | None = None, drop_threshold: float = 0.55) -> tuple[int, clean.Outcome]:
        """A new version plus its recipe; id columns and the target are left alone by the scaler."""
        exclude = [self.id_col, f"struct__{self.id_col}", *([target] if target else [])]
        out = clean.auto_preprocess(self.store.read(version), algorithm, drop_threshold, exclude)
        new = self.store.save(out.df, "preprocessed", version)
        params = out.recipe.to_df(self.spark).withColumn("version", F.lit(new))
        params.write.mode("append").parquet(f"{self.root}/recipes")
        return new, out

    def recipe(self, version: int) -> Recipe:
        try:
            params = self.spark.read.parquet(f"{self.root}/recipes").where(F.col("version") == version)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return Recipe()
        return Recipe.from_df(params)

    def recipe_chain(self, version: int) -> list[Recipe] | None:
        """Recipes from the root version to this one; none when the chain is broken."""
        path = st.chain(self.store.versions(), version)
        return None if path is None else [self.recipe(v) for v in path]

    def replay(self, version: int, new: DataFrame) -> DataFrame:
        chain = self.recipe_chain(version)
        if chain is None:
            raise ValueError(f"version {version} has no complete chain of recipes")
        return replay_chain(chain, new)

    def rebuild(self, version: int, struct: DataFrame, text: DataFrame | None = None, image: DataFrame | None = None, features: list[str] = (),
                files: DataFrame | None = None, file_column: str | None = None) -> DataFrame:
        """New rows in the shape of ``version``: checked, prefixed, joined on the id and replayed."""
        if files is not None and file_column:
            n = missing_files(struct, file_column, files).first()[0]
            if n:
                raise ValueError(f"{n} new row(s) name a file that is not there")
        out = self.replay(version, build_combined(struct, self.id_col, text, image))
        absent = [f for f in features if f not in out.columns]
        if absent:
            raise ValueError(f"new data lacks the features {absent}")
        return out

    # ---- training ----

    def train(self, version: int, target: str | None, task_type: str, features: list[str] | None = None, **kw) -> dict:
        if task_type not in TASKS:
            raise ValueError(f"{task_type!r} is none of {TASKS}")
        if task_type != "clustering" and not target:
            raise ValueError(f"{task_type} needs a target column")
        df = self.store.read(version)
        features = features or default_features(df, [target] if target else [], self.id_col)
        if task_type == "regression":
            result = models.auto_train_regression(df, self.id_col, features, target, **kw)
        elif task_type == "classification":
            result = models.auto_train_classification(df, self.id_col, features, target, **kw)
        else:
            result = cluster.auto_cluster(df, self.id_col, features, **kw)
            d = result["decision"]
            result.update(model_choice=kw.get("method", "kmeans"), metric_name="silhouette", metric_value=d.get("silhouette"), log=[d["description"]])
        result.update(features=features, target=target, task_type=task_type, version=version)
        result["run"] = self.record(result)
        self.fits[result["run"]] = result
        return result

    def runs(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{RUNS}, logged_at timestamp").parquet(f"{self.root}/runs")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{RUNS}, logged_at timestamp")

    def record(self, result: dict) -> int:
        """Append one run; also for results of the plain fitting functions."""
        run = (self.runs().agg(F.max("run")).first()[0] or 0) + 1
        value = result.get("metric_value")
        row = (run, result["version"], result["task_type"], result["target"] if result["task_type"] != "clustering" else None, list(result["features"]),
               result.get("model_choice"), result.get("metric_name"), None if value is None else float(value), [str(x) for x in result.get("log", [])])
        self.spark.createDataFrame([row], RUNS).withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/runs")
        return run

    def predict(self, run: int, struct: DataFrame, text: DataFrame | None = None, image: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows with a prediction, distribution of the predicted classes or clusters; mean for regression)."""
        fit = self.fits[run]
        rows = self.rebuild(fit["version"], struct, text, image, fit["features"])
        if fit["task_type"] == "regression":
            scored, _ = models.predict_regression(fit["fit"], rows)
            return scored, scored.agg(F.avg("prediction").alias("mean_prediction"), F.count(F.lit(1)).alias("rows"))
        if fit["task_type"] == "classification":
            scored = models.predict_classes(fit["fit"], rows, fit["mapping"])
            return scored, scored.groupBy(F.col("predicted_label").alias("class")).agg(F.count(F.lit(1)).alias("count"))
        kind = "kmeans" if fit["centroids"] else "dbscan"
        train = fit["scaled"].join(fit["labels"].select(self.id_col, "cluster"), self.id_col) if kind == "dbscan" else None
        scored = cluster.assign_new(kind, rows, self.id_col, fit["features"], fit["scaler"], train, centroids=fit["centroids"])
        return scored, cluster.cluster_sizes(scored)


def leaderboard(runs: DataFrame) -> DataFrame:
    """Best run per task and target."""
    best = F.max_by(F.struct("run", "model_choice", "metric_name"), "metric_value")
    return runs.groupBy("task_type", "target").agg(best.alias("b"), F.max("metric_value").alias("metric_value")).select("task_type", "target", "b.*", "metric_value")


def match_report(records: DataFrame, files: DataFrame, column: str, file_column: str = "filename") -> DataFrame:
    matched, unmatched = match_records(records, files, column, file_column)
    counts = matched.agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit("matched"))
    return counts.unionByName(unmatched.agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit("unmatched")))
