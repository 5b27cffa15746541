"""CSV, JSON and text readers, nested-record flattening, and writers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import col
from tabloom.session import checkpoint_dir

MAX_FLAT_COLUMNS = 5_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- readers -------------------------------------------------------------------------------------

def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Header and inferred types; pass ``schema`` to spare the inference pass over large inputs.

    Files are split between tasks; ``multiLine=True`` reads quoted line breaks, but each file in one task.
    """
    reader = spark.read.options(header=True, escape='"', **options)
    return reader.schema(schema).csv(path) if schema else reader.csv(path, inferSchema=True)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One record per line: splittable, the form to use for large inputs."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def json_records(documents: DataFrame, text: str = "value") -> DataFrame:
    """JSON documents to one variant per record; one scan and one explode.

    A list gives its items; an object gives the items of its first list-valued key (in document
    order), or itself as the only record when it has none.
    """
    raw = documents.select(col(text).alias("_text"), F.try_parse_json(col(text)).alias("_doc"))
    kind = F.schema_of_variant("_doc")
    fields = F.when(kind.startswith("OBJECT"), F.from_json("_text", "map<string,variant>"))
    is_list = lambda k: F.schema_of_variant(F.element_at("_map", k)).startswith("ARRAY")
    first = F.get(F.filter(F.json_object_keys("_text"), is_list), F.lit(0))
    opened = raw.withColumn("_map", fields).withColumn("_list", F.when(F.col("_map").isNotNull(), F.element_at("_map", first)))
    items = F.when(kind.startswith("ARRAY"), F.variant_get("_doc", "$", "array<variant>")).when(F.col("_list").isNotNull(), F.variant_get("_list", "$", "array<variant>"))
    return opened.where(kind.startswith("ARRAY") | kind.startswith("OBJECT")).select(F.explode(F.coalesce(items, F.array("_doc"))).alias("record"))


def parse_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """One JSON record per row as a variant; rows that do not parse give a null record."""
    return lines.select(F.try_parse_json(col(text)).alias("record"))


def typed_records(records: DataFrame, column: str = "record") -> DataFrame:
    """Variants to columns by the merged schema of all records (one aggregation pass)."""
    merged = records.agg(F.schema_of_variant_agg(column)).first()[0]
    ddl = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", merged.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING"))
    return records.select(F.variant_get(F.col(column), "$", ddl).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents (one per file) as records; use ``read_json_lines`` for large inputs."""
    return typed_records(json_records(spark.read.text(path, wholetext=True)))


def _leaves(name: str, c: Column, dtype: T.DataType, sizes: dict, sep: str) -> list[tuple[str, Column]]:
    if isinstance(dtype, T.StructType):
        out = []
        for f in dtype.fields:
            out += _leaves(f"{name}{sep}{f.name}" if name else f.name, c.getField(f.name) if name else col(f.name), f.dataType, sizes, sep)
        return out
    if isinstance(dtype, T.ArrayType) and name in sizes:
        out = []
        for i in range(sizes[name]):
            out += _leaves(f"{name}{sep}{i}", F.get(c, F.lit(i)), dtype.elementType, sizes, sep)
        return out
    return [(name, c)]


def flatten_nested(df: DataFrame, sep: str = "__") -> DataFrame:
    """Structs and lists to ``a__b__0`` columns; list widths come from the data, level by level."""
    while True:
        leaves = _leaves("", F.lit(None), df.schema, {}, sep)
        df = df.select(*[c.alias(n) for n, c in leaves])
        arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
        if not arrays:
            return df
        row = df.agg(*[F.max(F.size(col(a))).alias(f"s{i}") for i, a in enumerate(arrays)]).first()
        sizes = {a: max(0, row[i] or 0) for i, a in enumerate(arrays)}
        if sum(sizes.values()) > MAX_FLAT_COLUMNS:
            raise ValueError(f"flattening needs {sum(sizes.values())} columns; explode the lists {arrays} instead")
        flat = _leaves("", F.lit(None), df.schema, sizes, sep)
        df = df.select(*[c.alias(n) for n, c in flat])


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per non-blank line, trimmed."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("text"))
    return lines.where(F.col("text") != "")


# ---- writers -------------------------------------------------------------------------------------

def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).options(header=True, quoteAll=False, escape='"').csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


def write_xml(df: DataFrame, path: str, root_tag: str = "records", row_tag: str = "record", mode: str = "errorifexists") -> str:
    df.write.mode(mode).format("xml").options(rootTag=root_tag, rowTag=row_tag).save(path)
    return path


def write_parts(df: DataFrame, path: str, rows_per_part: int, fmt: str = "json", **options) -> str:
    """Files of at most ``rows_per_part`` rows, written by all executors."""
    df.write.options(maxRecordsPerFile=rows_per_part, **options).format(fmt).save(path)
    return path


# ---- ingest log -----------------------------------------------------------------------------------

def log_ingest(docs: DataFrame, path: str, source: str = "source") -> DataFrame:
    """Append one row (filename, n_docs, logged_at) per source to the log table at ``path``."""
    rows = docs.groupBy(col(source).alias("filename")).agg(F.count(F.lit(1)).alias("n_docs")).withColumn("logged_at", F.current_timestamp())
    rows.write.mode("append").parquet(path)
    return docs.sparkSession.read.parquet(path)


def latest_ingests(log: DataFrame, n: int = 8) -> DataFrame:
    return log.orderBy(F.desc("logged_at"), "filename").limit(n)
