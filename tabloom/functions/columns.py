"""Type families, missing-ness and name hints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fragments of column names that decide the rules below.
ID_HINTS = ("id", "uuid", "guid", "_pk", "primarykey", "key")
NON_NEGATIVE_HINTS = (
    "price", "cost", "amount", "age", "count", "qty", "quantity",
    "weight", "height", "salary", "income", "revenue", "duration",
    "distance", "population", "size", "volume", "fee", "score", "rating",
    "units", "stock", "inventory", "length", "width", "area",
)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns without booleans."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType)]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def is_numeric_like(dtype: T.DataType) -> bool:
    """Numeric or boolean."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def col(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The value, with NaN of floating columns turned into null."""
    c = col(name)
    if is_fractional(dtype_of(df, name)):
        return F.when(~F.isnan(c), c)
    return c


def missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    if is_fractional(dtype_of(df, name)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise NaN to null in every floating column."""
    fractional = [f.name for f in df.schema.fields if is_fractional(f.dataType)]
    return df.withColumns({c: present(df, c) for c in fractional}) if fractional else df


def name_matches(name: str, hints: tuple[str, ...], word_boundary: bool = False) -> bool:
    """Does the column name contain one of the hints (optionally only as a whole word)?"""
    lowered = name.lower()
    if word_boundary:
        words = set(re.split(r"[^a-z0-9]+", lowered))
        return any(h.strip("_") in words for h in hints)
    return any(h in lowered for h in hints)


def hints_identifier(name: str, word_boundary: bool = False) -> bool:
    return name_matches(name, ID_HINTS, word_boundary)


def hints_non_negative(name: str, hints: tuple[str, ...] = NON_NEGATIVE_HINTS, word_boundary: bool = False) -> bool:
    return name_matches(name, hints, word_boundary)


def column_families(df: DataFrame) -> DataFrame:
    """One row per column with its type family."""
    rows = []
    for pos, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, T.BooleanType):
            family = "boolean"
        elif isinstance(f.dataType, T.NumericType):
            family = "numeric"
        elif is_datetime(f.dataType):
            family = "datetime"
        elif isinstance(f.dataType, T.StringType):
            family = "categorical"
        else:
            family = "other"
        rows.append((pos, f.name, family))
    return df.sparkSession.createDataFrame(rows, "position int, column string, family string")
