"""Type conversion that reports bad values as missing instead of failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import col, dtype_of, present

TARGETS = ("numeric_float", "numeric_int", "string", "datetime", "category", "boolean")


def converted(df: DataFrame, name: str, target: str, truthy: bool = True) -> Column:
    c, dtype = present(df, name), dtype_of(df, name)
    if target == "numeric_float":
        return c.try_cast("double")
    if target == "numeric_int":
        number = c.try_cast("double")
        return F.when(number == F.floor(number), number.try_cast("bigint"))
    if target in ("string", "category"):
        return c.cast("string")
    if target == "datetime":
        return c.try_cast("timestamp_ntz") if isinstance(dtype, T.StringType) else c.cast("timestamp_ntz")
    if target == "boolean":
        if not truthy:
            return c.try_cast("boolean")
        if isinstance(dtype, T.StringType):
            return F.coalesce(c != "", F.lit(True))  # any non-empty text and missing count as true
        return F.coalesce(c.cast("double") != 0, F.lit(True))
    raise ValueError(f"unknown target {target!r}; one of {TARGETS}")


def convert_dtypes(df: DataFrame, columns: list[str], target: str, truthy: bool = True) -> DataFrame:
    return df.withColumns({c: converted(df, c, target, truthy) for c in columns})


def conversion_failures(df: DataFrame, column: str, target: str) -> DataFrame:
    """Distinct texts that do not convert, with counts."""
    bad = col(column).isNotNull() & converted(df, column, target, truthy=False).isNull()
    return df.where(bad).groupBy(col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
