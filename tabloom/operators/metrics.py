"""Scores as relational aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(scored: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """R2, RMSE and MAE in one pass."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    agg = scored.agg(F.sum((y - p) * (y - p)).alias("sse"), F.var_pop(y).alias("v"), F.count(y).alias("n"), F.avg(F.abs(y - p)).alias("mae"))
    return agg.select(
        (1 - F.col("sse") / F.when(F.col("v") > 0, F.col("v") * F.col("n"))).alias("r2"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae", F.col("n").alias("rows"),
    )


def residuals(scored: DataFrame, key: str, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    return scored.select(key, F.col(actual).alias("actual"), F.col(predicted).alias("predicted"), (F.col(actual) - F.col(predicted)).alias("residual"))


def confusion(scored: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """(actual, predicted, count); only classes that occur."""
    return scored.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))


def accuracy(scored: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    return scored.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("rows"))


def correct_flags(scored: DataFrame, key: str, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    return scored.select(key, F.col(actual).alias("actual"), F.col(predicted).alias("predicted"), (F.col(actual) == F.col(predicted)).alias("correct"))


def classification_report(scored: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """Rows per class (as text) plus ``macro avg`` and ``weighted avg``: precision, recall, f1, support.

    Everything after the first aggregate works on the confusion table.
    """
    c = confusion(scored, actual, predicted)
    rows = c.select(F.inline(F.array(
        F.struct(F.col("actual").cast("string").alias("class"), F.col("count").alias("support"), F.lit(0).cast("bigint").alias("chosen"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0).alias("hits")),
        F.struct(F.col("predicted").cast("string").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("count").alias("chosen"), F.lit(0).cast("bigint").alias("hits")),
    )))
    per = rows.groupBy("class").agg(F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hits").alias("hits"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    per = per.withColumns({"precision": ratio("hits", "chosen"), "recall": ratio("hits", "support")})
    p, r = F.col("precision"), F.col("recall")
    per = per.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).select("class", "precision", "recall", "f1", "support")
    names = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(m).alias(m) for m in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *names, "support")
    weighted = per.agg(*[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in names], F.sum("support").alias("support")).select(
        F.lit("weighted avg").alias("class"), *names, "support")
    return reduce(lambda a, b: a.unionByName(b), [per, macro, weighted])


def class_distribution(scored: DataFrame, predicted: str = "prediction") -> DataFrame:
    return scored.groupBy(F.col(predicted).alias("class")).agg(F.count(F.lit(1)).alias("count"))
