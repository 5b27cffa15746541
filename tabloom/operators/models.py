"""Regression and classification: Spark ML fits with the penalties scaled to the textbook objectives."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import col, missing, present
from tabloom.operators import metrics, moments
from tabloom.operators.association import max_pairwise_correlation
from tabloom.operators.neighbors import knn_vote, vectorised
from tabloom.operators.split import complete_cases, decide_split, encode_target, k_fold, train_test_split
from tabloom.session import cut_lineage

REGRESSORS = ("linear", "ridge", "lasso", "polynomial")
CLASSIFIERS = ("logistic", "knn", "svm_rbf", "linear_svc", "decision_tree", "random_forest", "naive_bayes")


@dataclass
class Fitted:
    """A fitted model; ``transform`` adds ``prediction`` (a double) to rows that carry the features."""

    kind: str
    features: list[str]
    model: object
    params: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.kind == "knn":
            votes = knn_vote(vectorised(df, self.features, self.params["key"]), self.params["train"], self.params["k"])
            return df.join(votes.select(F.col("id").alias(self.params["key"]), F.col("prediction").cast("double").alias("prediction")), self.params["key"])
        if self.kind == "naive_bayes":
            return self.model.transform(df)
        out = self.model.transform(df)
        return out.drop(*[c for c in ("features", "poly", "rff", "rawPrediction", "probability") if c in out.columns and c not in df.columns])


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


# ---- regression ------------------------------------------------------------------------------------------

def fit_regression(train: DataFrame, features: list[str], target: str, choice: str = "linear", alpha: float = 1.0, degree: int = 2) -> Fitted:
    """linear, ridge, lasso or polynomial; rows must be complete.

    Spark divides the squared loss by n and rescales by the label's deviation, hence the factors.
    """
    lr = LinearRegression(labelCol=target, featuresCol="features", predictionCol="prediction", standardization=False, maxIter=1000, tol=1e-10)
    steps = [_assembler(features)]
    normal = len(features) <= 4096 and choice in ("linear", "ridge")
    if choice == "ridge":
        # The normal-equation solver rescales by the population deviation, the other one by the sample's.
        y = col(target).cast("double")
        n, sd = train.agg(F.count(F.lit(1)), F.stddev_pop(y) if normal else F.stddev_samp(y)).first()
        lr = lr.setRegParam(alpha / n * (sd or 0.0)).setElasticNetParam(0.0)
    elif choice == "lasso":
        lr = lr.setRegParam(alpha).setElasticNetParam(1.0)
    elif choice == "polynomial":
        steps.append(PolynomialExpansion(degree=degree, inputCol="features", outputCol="poly"))
        lr = lr.setFeaturesCol("poly")
    elif choice != "linear":
        raise ValueError(choice)
    if normal:
        lr = lr.setSolver("normal")
    return Fitted(choice, features, Pipeline(stages=[*steps, lr]).fit(train))


def coefficients(spark, fit: Fitted) -> DataFrame | None:
    """(feature, coefficient) with the intercept; none for polynomial models."""
    if fit.kind not in ("linear", "ridge", "lasso"):
        return None
    lr = fit.model.stages[-1]
    rows = [(f, float(c)) for f, c in zip(fit.features, lr.coefficients)] + [("(intercept)", float(lr.intercept))]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def cross_validate_regression(df: DataFrame, key: str, features: list[str], target: str, choice: str = "linear", alpha: float = 1.0,
                              degree: int = 2, k: int = 5, seed: int = 42) -> DataFrame:
    """(fold, r2, rmse) of all folds from one scan (see ``moments``); summary statistics are an aggregate of it."""
    if choice not in REGRESSORS:
        raise ValueError(choice)
    return moments.cross_validate(k_fold(df, key, k, seed), features, target, choice, alpha, degree, k)


def cv_summary(scores: DataFrame) -> DataFrame:
    cols = [c for c in ("r2", "rmse", "accuracy") if c in scores.columns]
    return scores.agg(*[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_pop(c).alias(f"{c}_std") for c in cols])


def decide_regression_model(df: DataFrame, features: list[str], threshold: float = 0.8) -> dict:
    top = 0.0
    if len(features) > 1:
        top = max_pairwise_correlation(df, features).first()["max_abs_r"] or 0.0
    choice = "ridge" if top > threshold else "linear"
    return {"model_choice": choice, "alpha": 1.0, "max_abs_r": top, "description": f"{choice}: largest correlation between features {top:.2f}"}


def auto_train_regression(df: DataFrame, key: str, features: list[str], target: str, seed: int = 42) -> dict:
    decision = decide_regression_model(df, features)
    data = cut_lineage(complete_cases(df.select(key, *features, target), [*features, target]))
    n = data.count()
    plan = decide_split(n)
    parts = train_test_split(data, key, plan["test_size"], seed)
    fit = fit_regression(parts.where("split = 'train'"), features, target, decision["model_choice"], decision["alpha"])
    scored = fit.transform(parts.where("split = 'test'"))
    out = {"fit": fit, "scored": scored, "metrics": metrics.regression_metrics(scored, target), "coefficients": coefficients(df.sparkSession, fit),
           "log": [decision["description"], plan["description"]], "cv": None, "model_choice": decision["model_choice"], "metric_name": "r2"}
    if plan["use_cv"]:
        out["cv"] = cross_validate_regression(data, key, features, target, decision["model_choice"], decision["alpha"], k=plan["cv_folds"], seed=seed)
    out["metric_value"] = out["metrics"].first()["r2"]
    return out


# ---- classification ----------------------------------------------------------------------------------------

@dataclass
class NaiveBayesFit:
    """Multinomial model as (class, log prior, log probabilities): classes x features numbers."""

    features: list[str]
    rows: list[tuple]

    def table(self, spark) -> DataFrame:
        out = [(float(c), prior, f, t) for c, prior, theta in self.rows for f, t in zip(self.features, theta)]
        return spark.createDataFrame(out, "class double, log_prior double, feature string, log_probability double")

    def transform(self, df: DataFrame) -> DataFrame:
        scores = []
        for c, prior, theta in self.rows:
            s = F.lit(prior)
            for f, t in zip(self.features, theta):
                s = s + col(f).cast("double") * F.lit(t)
            scores.append(F.struct(s.alias("s"), F.lit(-float(c)).alias("c")))
        return df.withColumn("prediction", -F.array_max(F.array(*scores))["c"])


def is_non_negative(df: DataFrame, features: list[str]) -> bool:
    return not df.agg(*[F.min(present(df, c)).alias(f"m{i}") for i, c in enumerate(features)]).where(
        " OR ".join(f"m{i} < 0" for i in range(len(features)))).count()


def fit_naive_bayes(train: DataFrame, features: list[str], target: str, smoothing: float = 1.0) -> NaiveBayesFit:
    """One aggregate: class sizes and feature sums per class."""
    if not is_non_negative(train, features):
        raise ValueError("multinomial naive Bayes needs non-negative features")
    sums = train.groupBy(col(target).alias("_c")).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(col(f).cast("double")).alias(f"s{i}") for i, f in enumerate(features)])
    rows = sums.orderBy("_c").collect()
    n, d, out = sum(r["_n"] for r in rows), len(features), []
    for r in rows:
        total = sum(r[f"s{i}"] for i in range(d)) + smoothing * d
        out.append((r["_c"], math.log(r["_n"] / n), [math.log((r[f"s{i}"] + smoothing) / total) for i in range(d)]))
    return NaiveBayesFit(features, out)


class RandomFourier:
    """cos(w x + b) features whose inner products approximate the RBF kernel (Rahimi and Recht, 2007)."""

    def __init__(self, gamma: float, dims: int, components: int = 256, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(scale=math.sqrt(2 * gamma), size=(dims, components))
        self.b = rng.uniform(0, 2 * math.pi, size=components)

    def transform(self, df: DataFrame) -> DataFrame:
        w, b = self.w, self.b

        @F.pandas_udf("array<double>")
        def lift(v: pd.Series) -> pd.Series:
            x = np.vstack(v.to_numpy()) if len(v) else np.empty((0, len(w)))
            return pd.Series(list(math.sqrt(2.0 / len(b)) * np.cos(x @ w + b)))

        return df.withColumn("rff", array_to_vector(lift(vector_to_array("features"))))


@dataclass
class RbfSvm:
    assembler: VectorAssembler
    fourier: RandomFourier
    svm: object

    def transform(self, df: DataFrame) -> DataFrame:
        return self.svm.transform(self.fourier.transform(self.assembler.transform(df)))


def _scale_gamma(train: DataFrame, features: list[str]) -> float:
    """1 / (number of features * variance of all cells)."""
    row = train.select(F.explode(F.array(*[col(f).cast("double") for f in features])).alias("x")).agg(F.var_pop("x")).first()
    return 1.0 / (len(features) * (row[0] or 1.0))


def fit_classifier(train: DataFrame, features: list[str], target: str, choice: str = "logistic", key: str | None = None, k: int = 5,
                   c: float = 1.0, tree_depth: int = 5, trees: int = 100, forest_depth: int = 5, seed: int = 42,
                   logistic_iterations: int = 1000, svc_iterations: int = 1000) -> Fitted:
    """``target`` holds dense codes 0..m-1 (see ``encode_target``); rows must be complete."""
    if choice == "naive_bayes":
        return Fitted(choice, features, fit_naive_bayes(train, features, target))
    if choice == "knn":
        if key is None:
            raise ValueError("k-NN needs the key of the rows")
        return Fitted(choice, features, None, {"key": key, "k": k, "train": vectorised(train, features, key, target)})
    n, classes = train.agg(F.count(F.lit(1)), F.count_distinct(target)).first()
    assembler = _assembler(features)
    names = {"labelCol": target, "featuresCol": "features", "predictionCol": "prediction"}
    if choice == "logistic":
        est = LogisticRegression(maxIter=logistic_iterations, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, tol=1e-8, **names)
    elif choice == "decision_tree":
        est = DecisionTreeClassifier(maxDepth=tree_depth, seed=seed, **names)
    elif choice == "random_forest":
        est = RandomForestClassifier(numTrees=trees, maxDepth=forest_depth, seed=seed, **names)
    elif choice in ("linear_svc", "svm_rbf"):
        feats = "features" if choice == "linear_svc" else "rff"
        svc = LinearSVC(maxIter=svc_iterations, tol=1e-4, regParam=1.0 / (c * n), labelCol=target, featuresCol=feats, predictionCol="prediction")
        est = svc if classes <= 2 else OneVsRest(classifier=svc, labelCol=target, featuresCol=feats, predictionCol="prediction")
        if choice == "svm_rbf":
            fourier = RandomFourier(_scale_gamma(train, features), len(features), seed=seed)
            lifted = fourier.transform(assembler.transform(train)).persist()
            fit = est.fit(lifted)
            lifted.unpersist()
            return Fitted(choice, features, RbfSvm(assembler, fourier, fit))
    else:
        raise ValueError(f"{choice!r} is none of {CLASSIFIERS}")
    return Fitted(choice, features, Pipeline(stages=[assembler, est]).fit(train))


def cross_validate_classifier(df: DataFrame, key: str, features: list[str], target: str, choice: str = "logistic", k: int = 5, seed: int = 42, **kw) -> DataFrame:
    """(fold, accuracy) over stratified folds."""
    data = k_fold(df, key, k, seed, target).persist()
    rows = []
    for i in range(k):
        fit = fit_classifier(data.where(F.col("fold") != i), features, target, choice, key, seed=seed, **kw)
        rows.append((i, metrics.accuracy(fit.transform(data.where(F.col("fold") == i)), target).first()["accuracy"]))
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, accuracy double")


def feature_importances(spark, fit: Fitted) -> DataFrame | None:
    if fit.kind not in ("decision_tree", "random_forest"):
        return None
    values = fit.model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(fit.features, values)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def decide_classification_model(n: int, threshold: int = 150) -> dict:
    choice = "logistic" if n < threshold else "random_forest"
    return {"model_choice": choice, "description": f"{choice}: {n} rows against a threshold of {threshold}"}


def auto_train_classification(df: DataFrame, key: str, features: list[str], target: str, seed: int = 42) -> dict:
    data = complete_cases(df.select(key, *features, target), [*features, target])
    encoded, mapping = encode_target(data, target, "_code")
    encoded = cut_lineage(encoded.drop(target).withColumn("label", F.col("_code").cast("double")).drop("_code"))
    n = encoded.count()
    decision, plan = decide_classification_model(n), decide_split(n)
    parts = train_test_split(encoded, key, plan["test_size"], seed, "label")
    fit = fit_classifier(parts.where("split = 'train'"), features, "label", decision["model_choice"], key, seed=seed)
    scored = fit.transform(parts.where("split = 'test'"))
    out = {"fit": fit, "mapping": mapping, "scored": scored, "report": metrics.classification_report(scored), "confusion": metrics.confusion(scored),
           "importances": feature_importances(df.sparkSession, fit), "log": [decision["description"], plan["description"]], "cv": None,
           "model_choice": decision["model_choice"], "metric_name": "accuracy", "metric_value": metrics.accuracy(scored).first()["accuracy"]}
    if plan["use_cv"]:
        out["cv"] = cross_validate_classifier(encoded, key, features, "label", decision["model_choice"], plan["cv_folds"], seed)
    return out


# ---- prediction -----------------------------------------------------------------------------------------------

def fill_features(df: DataFrame, features: list[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({f: F.when(missing(df, f), F.lit(value)).otherwise(col(f).cast("double")) for f in features})


def predict_classes(fit: Fitted, df: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Missing features count as 0; codes are decoded to ``predicted_label`` when a mapping is given."""
    scored = fit.transform(fill_features(df, fit.features))
    if mapping is None:
        return scored
    names = mapping.select(F.col("code").cast("double").alias("prediction"), F.col("label").alias("predicted_label"))
    return scored.join(names, "prediction", "left")


def predict_regression(fit: Fitted, df: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(scored rows, metrics when the target is known)."""
    scored = fit.transform(fill_features(df, fit.features))
    return scored, metrics.regression_metrics(scored, target) if target and target in df.columns else None
