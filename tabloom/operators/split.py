"""Train/test splits and folds by hash rank: the same rows for the same seed on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import col, missing, present
from tabloom.operators.ranking import hash_rank


def stratified_quota(counts: DataFrame, test_size: float) -> DataFrame:
    """(class, quota) from (class, n): proportional, largest remainders rounded up; the total is ceil(test_size * rows).

    The window runs over one row per class.
    """
    n = counts.agg(F.sum("n")).first()[0] or 0
    wanted = math.ceil(test_size * n)
    shares = counts.withColumn("share", F.col("n") * F.lit(wanted) / F.lit(max(n, 1))).withColumn("whole", F.floor("share").cast("bigint"))
    given = shares.agg(F.sum("whole")).first()[0] or 0
    order = Window.orderBy((F.col("share") - F.col("whole")).desc(), F.coalesce(F.col("class").cast("string"), F.lit("None")))
    more = F.when(F.row_number().over(order) <= wanted - given, 1).otherwise(0)
    return shares.select("class", (F.col("whole") + more).cast("bigint").alias("quota"))


def train_test_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, stratify: str | None = None, out: str = "split") -> DataFrame:
    """Adds ``split`` = train / test. Stratified when every class has two rows, else plain."""
    counts = df.groupBy(col(stratify).alias("class")).agg(F.count(F.lit(1)).alias("n")) if stratify else None
    if counts is not None and (counts.agg(F.min("n")).first()[0] or 0) >= 2:
        ranked = hash_rank(df, key, seed, stratify, "_rank")
        quotas = stratified_quota(counts, test_size).select(F.col("class").alias("_class"), F.col("quota").alias("_quota"))
        ranked = ranked.join(quotas, col(stratify).eqNullSafe(F.col("_class"))).drop("_class")
        limit = F.col("_quota")
    else:
        n = df.agg(F.count(F.lit(1))).first()[0]
        ranked = hash_rank(df, key, seed, None, "_rank")
        limit = F.lit(math.ceil(test_size * n))
    return ranked.withColumn(out, F.when(F.col("_rank") < limit, "test").otherwise("train")).drop("_rank", "_quota")


def k_fold(df: DataFrame, key: str, k: int = 5, seed: int = 42, stratify: str | None = None, out: str = "fold") -> DataFrame:
    """Adds ``fold`` 0..k-1; sizes differ by at most one (per class when stratified)."""
    ranked = hash_rank(df, key, seed, stratify, "_rank")
    return ranked.withColumn(out, (F.col("_rank") % k).cast("int")).drop("_rank")


def decide_split(n: int) -> dict:
    """Small tables test on more rows and cross-validate; large ones hold out 15 per cent once."""
    for limit, test_size, use_cv, folds in ((100, 0.3, True, 3), (500, 0.2, True, 5)):
        if n < limit:
            break
    else:
        test_size, use_cv, folds = 0.15, False, 5
    how = f"{folds}-fold cross-validation" if use_cv else "no cross-validation"
    return {"test_size": test_size, "use_cv": use_cv, "cv_folds": folds, "description": f"{n} rows: test share {test_size}, {how}"}


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    cond = ~missing(df, cols[0])
    for c in cols[1:]:
        cond &= ~missing(df, c)
    return df.where(cond)


def encode_target(df: DataFrame, target: str, out: str = "label") -> tuple[DataFrame, DataFrame]:
    """(rows with a dense integer label, mapping (label text, code)). Numbers are coded in numeric order."""
    from tabloom.functions.columns import numeric_columns
    from tabloom.operators.clean import label_encode
    from tabloom.operators.ranking import global_row_number

    if target not in numeric_columns(df):
        return label_encode(df, target, out)
    values = df.select(present(df, target).alias("_v")).where("_v IS NOT NULL").distinct()
    mapping = global_row_number(values, [F.col("_v")], "code").select(F.col("_v").alias("label"), "code")
    side = mapping.select(F.col("label").alias("_v"), F.col("code").alias(out))
    return df.join(side, col(target) == F.col("_v"), "left").drop("_v"), mapping
