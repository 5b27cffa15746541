"""Extension beyond the batch operators: the daily series and fitted recipes on streaming input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import col
from tabloom.plans.recipe import Recipe


def daily_counts(events: DataFrame, ts: str, value: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Rows (and the mean of ``value``) per day; events later than ``lateness`` are left out by the watermark."""
    timed = events.withColumn("_ts", col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    aggs = [F.count(F.lit(1)).alias("count")] + ([F.avg(col(value)).alias("mean")] if value else [])
    days = timed.groupBy(F.window("_ts", "1 day").alias("w")).agg(*aggs)
    return days.select(F.to_date("w.start").alias("day"), *[a for a in days.columns if a != "w"])


def apply_recipe(stream: DataFrame, recipe: Recipe) -> DataFrame:
    """A fitted recipe is a projection: no state, no watermark."""
    return recipe.transform(stream)
