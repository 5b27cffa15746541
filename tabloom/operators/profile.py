"""Whole-table profiles: one aggregation job per profile, never one per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import (
    categorical_columns,
    col,
    is_datetime,
    missing,
    numeric_columns,
    present,
)
from tabloom.operators.quantiles import column_quantiles, quantiles_by_key

COLUMNS_PER_PASS = 200  # keeps one aggregate's generated code within bounds


def _chunks(items: list, size: int = COLUMNS_PER_PASS):
    for i in range(0, len(items), size):
        yield items[i : i + size]


def _as_rows(df: DataFrame, structs: list[Column], aggregates: list[Column]) -> DataFrame:
    """One aggregate row turned into long form (one row per struct)."""
    return df.agg(*aggregates).select(F.inline(F.array(*structs)))


def _per_column(df: DataFrame, cols: list[str], make) -> DataFrame:
    """``make(pos, name) -> (aggregates, struct over their aliases)``; passes of bounded width."""
    parts = []
    for chunk in _chunks(list(enumerate(cols))):
        aggs, structs = [F.count(F.lit(1)).alias("_n")], []
        for pos, name in chunk:
            a, s = make(pos, name)
            aggs += a
            structs.append(s)
        parts.append(_as_rows(df, structs, aggs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def type_name(dtype: T.DataType) -> str:
    return dtype.simpleString()


def shape_card(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric and categorical column counts, total missing cells."""
    miss = [F.count_if(missing(df, c)) for c in df.columns]
    total = miss[0]
    for m in miss[1:]:
        total = total + m
    return df.agg(F.count(F.lit(1)).alias("rows"), total.alias("missing_cells")).select(
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric"),
        F.lit(len(categorical_columns(df))).cast("bigint").alias("categorical"),
        "missing_cells",
    )


def _pct(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0)), digits)


def _digest(df: DataFrame, c: str) -> Column:
    """What stands for a value where only equality matters: itself as text, long texts as their digest."""
    v = present(df, c)
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        v = F.when(v == 0, F.lit(0.0)).otherwise(v)  # both zeros
    text = v.cast("string")
    return F.when(F.length(text) > 32, F.md5(text)).otherwise(text) if isinstance(df.schema[c].dataType, T.StringType) else text


def dataset_overview(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column, dtype, unique (without missing), missing, missing_pct (1 digit).

    Exact counts take the long form (column, value) once: equal values combine before the shuffle and
    long texts travel as digests. The group of missing cells gives the missing counts.
    """
    if approximate:
        def make(i, c):
            aggs = [F.approx_count_distinct(present(df, c)).alias(f"u{i}"), F.count(present(df, c)).alias(f"p{i}")]
            miss = F.col("_n") - F.col(f"p{i}")
            return aggs, F.struct(F.lit(c).alias("column"), F.lit(type_name(df.schema[c].dataType)).alias("dtype"), F.col(f"u{i}").alias("unique"),
                                  miss.alias("missing"), _pct(miss, F.col("_n"), 1).alias("missing_pct"))

        return _per_column(df, df.columns, make)
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), _digest(df, c).alias("value")) for i, c in enumerate(df.columns)])))
    counts = cells.groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("i").agg(F.count("value").alias("unique"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.sum("n").alias("n"))
    names = df.sparkSession.createDataFrame([(i, c, type_name(df.schema[c].dataType)) for i, c in enumerate(df.columns)], "i int, column string, dtype string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return names.join(per, "i", "left").select("column", "dtype", zero("unique").alias("unique"), zero("missing").alias("missing"), _pct(zero("missing"), zero("n"), 1).alias("missing_pct"))


def column_types(df: DataFrame) -> DataFrame:
    """column, dtype, non_null, null_pct (2 digits)."""

    def make(i, c):
        miss = F.col("_n") - F.col(f"p{i}")
        return [F.count(present(df, c)).alias(f"p{i}")], F.struct(
            F.lit(c).alias("column"),
            F.lit(type_name(df.schema[c].dataType)).alias("dtype"),
            F.col(f"p{i}").alias("non_null"),
            _pct(miss, F.col("_n"), 2).alias("null_pct"),
        )

    return _per_column(df, df.columns, make)


def missing_value_summary(df: DataFrame) -> DataFrame:
    """Only the columns that have missing cells: count and percent (2 digits)."""

    def make(i, c):
        return [F.count_if(missing(df, c)).alias(f"m{i}")], F.struct(
            F.lit(c).alias("column"),
            F.col(f"m{i}").alias("missing"),
            _pct(F.col(f"m{i}"), F.col("_n"), 2).alias("missing_pct"),
        )

    return _per_column(df, df.columns, make).where(F.col("missing") > 0)


def value_frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value as text, n) without missing cells; hot values combine before the shuffle."""
    parts = [F.struct(F.lit(c).alias("column"), present(df, c).cast("string").alias("value")) for c in cols]
    return (
        df.select(F.inline(F.array(*parts)))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def describe_all(df: DataFrame) -> DataFrame:
    """count, unique, top, freq for text and boolean columns; mean, std, min, quartiles, max for numeric and date columns.

    Dates count in seconds since 1970 and have no standard deviation. Frequencies of all texts are one
    long form; all moments are one aggregate.
    """
    dates = [c for c in df.columns if is_datetime(df.schema[c].dataType)]
    numbers = numeric_columns(df)
    texts = [c for c in df.columns if c not in dates and c not in numbers]
    null_d = F.lit(None).cast("double")
    out = None
    if texts:
        # Only digests are counted; the text of the winner is looked up among the rows that have its digest.
        parts = [F.struct(F.lit(c).alias("column"), _digest(df, c).alias("value"), F.substring(present(df, c).cast("string"), 1, 32).alias("start")) for c in texts]
        freq = df.select(F.inline(F.array(*parts))).groupBy("column", "value", "start").agg(F.count(F.lit(1)).alias("n"))
        known = F.col("value").isNotNull()
        tops = freq.groupBy("column").agg(
            F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("count"), F.count("value").alias("unique"), F.max(F.when(known, F.col("n"))).alias("freq"))
        best = freq.where(known).join(tops.select(F.col("column").alias("_c"), "freq"), (F.col("column") == F.col("_c")) & (F.col("n") == F.col("freq")))
        # Of equally frequent values the smallest: by its start, among equal starts by the text itself.
        first = best.groupBy("column").agg(F.min("start").alias("start"))
        tied = best.join(first, ["column", "start"]).select("column", "value")
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _digest(df, c).alias("value"), present(df, c).cast("string").alias("text")) for c in texts])))
        top = long.where("value IS NOT NULL").join(tied, ["column", "value"]).groupBy("column").agg(F.min("text").alias("top"))
        out = tops.join(top, "column", "left").select(
            "column", "count", "unique", "top", "freq",
            *[null_d.alias(x) for x in ("mean", "std", "min", "q25", "q50", "q75", "max")],
        )
    measured = [c for c in df.columns if c in numbers or c in dates]
    if measured:
        seconds = lambda c: F.unix_micros(df[c].cast("timestamp")) / 1e6
        work = df.select(*[(seconds(c) if c in dates else F.col(f"`{c}`")).alias(c) for c in measured])
        quart = column_quantiles(work, measured, [0.25, 0.5, 0.75])

        def make(i, c):
            v = present(work, c).cast("double")
            aggs = [
                F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"),
                F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
            ]
            return aggs, F.struct(
                F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
                F.lit(None).cast("bigint").alias("unique"), F.lit(None).cast("string").alias("top"),
                F.lit(None).cast("bigint").alias("freq"),
                F.col(f"a{i}").alias("mean"), (null_d if c in dates else F.col(f"s{i}")).alias("std"), F.col(f"lo{i}").alias("min"),
                *[F.lit(quart[c][p]).cast("double").alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))],
                F.col(f"hi{i}").alias("max"),
            )

        nums = _per_column(work, measured, make)
        out = nums if out is None else out.unionByName(nums)
    return out


def value_counts(df: DataFrame, column: str, top_n: int | None = 20) -> DataFrame:
    """Counts without missing values, most frequent first; ties in value order."""
    counts = (
        df.where(~missing(df, column)).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("value"))
    )
    return counts.limit(top_n) if top_n else counts


def group_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Row count per group; the group of missing keys is kept."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), *by)


def grouped_means(df: DataFrame, by: str, cols: list[str], digits: int = 3) -> DataFrame:
    return df.where(~missing(df, by)).groupBy(by).agg(*[F.round(F.avg(present(df, c)), digits).alias(c) for c in cols])


def tag_summary(df: DataFrame, tag: str, text: str) -> DataFrame:
    """Rows and rows with non-blank text per tag."""
    return df.groupBy(tag).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.trim(F.coalesce(col(text), F.lit(""))) != "").alias("with_text")
    )


def pivot_mean(df: DataFrame, index: str, columns: str, value: str, levels: list, digits: int | None = None) -> DataFrame:
    """Mean of ``value`` by ``index`` rows and ``columns`` columns; levels are given, so one job."""
    m = F.avg(value) if digits is None else F.round(F.avg(value), digits)
    return df.groupBy(index).pivot(columns, levels).agg(m)


def sturges_bins(n: int) -> int:
    """Bin count used when the caller names none: ceil(log2 n) + 1."""
    return max(1, (max(n, 1) - 1).bit_length() + 1)


def histogram(df: DataFrame, column: str, bins: int | None = 50) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed, empty bins kept: (bin, lo, hi, count)."""
    v = present(df, column).cast("double")
    lo, hi, n = df.agg(F.min(v), F.max(v), F.count(v)).first()
    bins = bins or sturges_bins(n)
    spark = df.sparkSession
    if n == 0:
        return spark.createDataFrame([], "bin int, lo double, hi double, count bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    slot = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    hits = df.where(v.isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(hits), "bin", "left").select(  # hits: one row per bin
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def box_summary(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 IQR) and outlier count, per optional group."""
    key = col(by) if by else F.lit("all")
    long = df.select(key.alias("key"), present(df, value).cast("double").alias("value")).where(
        F.col("value").isNotNull() & F.col("key").isNotNull()
    )
    q = quantiles_by_key(long, [0.25, 0.5, 0.75]).groupBy("key").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("quantile"))
    q = q.select("key", F.col("`0.25`").alias("q1"), F.col("`0.5`").alias("median"), F.col("`0.75`").alias("q3"))
    low = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    high = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= low) & (F.col("value") <= high)
    return long.join(q, "key").groupBy("key", "q1", "median", "q3").agg(
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
        F.count(F.lit(1)).alias("count"),
    )


def daily_mean(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Mean per day; days without values are left out."""
    return (
        df.where(~missing(df, value)).groupBy(F.to_date(col(ts)).alias("day")).agg(F.avg(value).alias("mean"))
        .where(F.col("day").isNotNull())
    )


def daily_count(df: DataFrame, ts: str) -> DataFrame:
    """Rows per day; days without rows are kept as 0 (the calendar has one row per day)."""
    days = df.where(col(ts).isNotNull()).groupBy(F.to_date(col(ts)).alias("day")).agg(F.count(F.lit(1)).alias("count"))
    calendar = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day")
    )
    return calendar.join(days, "day", "left").select("day", F.coalesce("count", F.lit(0)).alias("count"))


def duplicate_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows after the first of each group of equal rows (missing cells equal)."""
    keys = subset or df.columns
    groups = df.groupBy(*[col(c) for c in keys]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def corpus_summary(corpus: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    from tabloom.functions.scalars import char_count, word_count

    return corpus.agg(
        F.count(F.lit(1)).alias("docs"), F.count_distinct(source).alias("sources"),
        F.avg(word_count(col(text))).alias("mean_words"), F.avg(char_count(col(text))).alias("mean_chars"),
    )


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, missing cells and removed columns between two versions of a table."""
    a = shape_card(before).select(F.col("rows").alias("rows_before"), F.col("missing_cells").alias("missing_before"))
    b = shape_card(after).select(F.col("rows").alias("rows_after"), F.col("missing_cells").alias("missing_after"))
    removed = sorted(set(before.columns) - set(after.columns))
    one = a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")  # two one-row tables
    return one.withColumn("columns_removed", F.lit(", ".join(removed)))
