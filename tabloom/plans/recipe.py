"""A recipe is an ordered list of fitted steps; applying it is one projection, batch or streaming."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import missing, present
from tabloom.functions.scalars import clip

SCHEMA = "step int, kind string, column string, text string, a double, b double"


@dataclass(frozen=True)
class Step:
    """``kind``: fill (text), drop, clip (a = low, b = high), scale (a = centre, b = divisor)."""

    kind: str
    column: str
    text: str | None = None
    a: float | None = None
    b: float | None = None


@dataclass
class Recipe:
    steps: list[Step] = field(default_factory=list)

    def __add__(self, other: "Recipe") -> "Recipe":
        return Recipe([*self.steps, *other.steps])

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, s.kind, s.column, s.text, s.a, s.b) for i, s in enumerate(self.steps)]
        return spark.createDataFrame(rows, SCHEMA)

    @staticmethod
    def from_df(params: DataFrame) -> "Recipe":
        """Parameters of one recipe: a row per step and column."""
        rows = params.orderBy("step").collect()
        return Recipe([Step(r["kind"], r["column"], r["text"], r["a"], r["b"]) for r in rows])

    @property
    def scales(self) -> bool:
        return any(s.kind == "scale" for s in self.steps)

    def transform(self, df: DataFrame) -> DataFrame:
        """Replay per column; steps for columns that are absent are skipped."""
        for s in self.steps:
            if s.column not in df.columns:
                continue
            if s.kind == "drop":
                df = df.drop(s.column)
                continue
            dtype = df.schema[s.column].dataType
            c = present(df, s.column)
            if s.kind == "fill":
                if isinstance(dtype, T.IntegralType) and s.text is not None and not s.text.lstrip("-").isdigit():
                    c, dtype = c.cast("double"), T.DoubleType()  # an integer column filled by a fraction turns floating
                value = F.when(missing(df, s.column), F.lit(s.text).cast(dtype)).otherwise(c)
            elif s.kind == "clip":
                value = clip(c.cast("double"), s.a, s.b) if not isinstance(dtype, T.IntegralType) or _fractional(s) else clip(c, s.a, s.b).cast(dtype)
            elif s.kind == "scale":
                value = (c.cast("double") - F.lit(s.a)) / F.lit(s.b)
            else:
                raise ValueError(s.kind)
            df = df.withColumn(s.column, value)
        return df


def _fractional(s: Step) -> bool:
    return any(x is not None and x != int(x) for x in (s.a, s.b))


def replay_chain(recipes: list[Recipe], df: DataFrame) -> DataFrame:
    for r in recipes:
        df = r.transform(df)
    return df


