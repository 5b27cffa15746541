"""Projection, filter, join, window, sort and set operators with explicit keys and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import col, missing, present
from tabloom.operators.ranking import global_row_number

COMPARISONS = {
    ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "==": lambda c, v: c == v,
    ">": lambda c, v: c > v, "<": lambda c, v: c < v, "!=": lambda c, v: (c != v) | c.isNull(),
}


# ---- projection and filter -------------------------------------------------------------

def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def search_text(df: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    """Rows where any chosen column, as text, matches the regular expression, whatever the case."""
    hits = [F.coalesce(col(c).cast("string").rlike("(?i)" + term), F.lit(False)) for c in columns or df.columns]
    return df.where(reduce(lambda a, b: a | b, hits))


def search_literal(df: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    hits = [F.coalesce(F.lower(col(c).cast("string")).contains(term.lower()), F.lit(False)) for c in columns or df.columns]
    return df.where(reduce(lambda a, b: a | b, hits))


def filter_numeric(df: DataFrame, column: str, op: str, value: float) -> DataFrame:
    return df.where(COMPARISONS[op](present(df, column), F.lit(value)))


def delete_by_key(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def null_rows(df: DataFrame, column: str, key: list[str]) -> DataFrame:
    return df.where(missing(df, column)).select(*key)


def by_prefix(df: DataFrame, prefixes: list[str], keep: list[str] = (), exclude: bool = False) -> DataFrame:
    """Columns whose names start (or, with ``exclude``, do not start) with a prefix, plus ``keep``."""
    starts = lambda c: any(c.startswith(p) for p in prefixes)
    names = [c for c in df.columns if c in keep or starts(c) != exclude]
    return df.select(*[col(c) for c in names])


def add_row_id(df: DataFrame, order_by: list[str], name: str = "row_id") -> DataFrame:
    """0..n-1 in the order of a stable key; ``order_by`` must identify rows."""
    return global_row_number(df, [F.asc_nulls_last(c) for c in order_by], name)


def melt(df: DataFrame, ids: list[str], values: list[str], var: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long; rows with any missing cell among the chosen columns are dropped first."""
    work = df.select(*ids, *[present(df, c).cast("double").alias(c) for c in values]).dropna()
    return work.unpivot(ids, values, var, value)


# ---- joins -------------------------------------------------------------------------------

def merge(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", suffixes=("_x", "_y")) -> DataFrame:
    """Equi-join where missing keys match each other; shared non-key columns get suffixes."""
    how = {"outer": "full_outer"}.get(how, how)
    shared = [c for c in left.columns if c in right.columns and c not in on]
    l = left.withColumnsRenamed({c: c + suffixes[0] for c in shared}) if shared else left
    r = right.withColumnsRenamed({c: c + suffixes[1] for c in shared}) if shared else right
    r = r.withColumnsRenamed({k: f"_r_{k}" for k in on})
    cond = reduce(lambda a, b: a & b, [col(k).eqNullSafe(col(f"_r_{k}")) for k in on])
    joined = l.join(r, cond, how)
    if how == "full_outer":
        keys = [F.coalesce(col(k), col(f"_r_{k}")).alias(k) for k in on]
    elif how == "right":
        keys = [col(f"_r_{k}").alias(k) for k in on]
    else:
        keys = [col(k) for k in on]
    key_of = dict(zip(on, keys))
    rest = [col(c) for c in r.columns if not c.startswith("_r_")]
    return joined.select(*[key_of.get(c, col(c)) if c in key_of else col(c) for c in l.columns], *rest)


def merge_all(frames: list[DataFrame], keys: list[list[str]], how: str = "inner") -> DataFrame:
    """Left fold of ``merge``: ``keys[i]`` joins the result so far with ``frames[i + 1]``."""
    out = frames[0]
    for frame, on in zip(frames[1:], keys):
        out = merge(out, frame, on, how)
    return out


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    names = set(right.columns)
    return [c for c in left.columns if c in names]


def match_records(records: DataFrame, files: DataFrame, column: str | None, file_column: str = "filename"):
    """(matched, unmatched) by file name; without a column every record is matched."""
    if column is None:
        return records, records.limit(0)
    names = files.select(col(file_column).alias("_f")).distinct()
    cond = col(column) == F.col("_f")
    return records.join(names, cond, "left_semi"), records.join(names, cond, "left_anti")


def build_combined(struct: DataFrame, key: str, text: DataFrame | None = None, image: DataFrame | None = None) -> DataFrame:
    """One table of prefixed struct, text and image features, joined on the id; a clean id is kept."""
    out = struct.select(col(key), *[col(c).alias(f"struct__{c}") for c in struct.columns])
    for part, prefix in ((text, "text__"), (image, "img__")):
        if part is not None:
            named = part.select(col(key), *[col(c).alias(prefix + c) for c in part.columns if c != key])
            out = out.join(named, key, "left")
    return out


def missing_files(records: DataFrame, column: str, files: DataFrame, file_column: str = "filename") -> DataFrame:
    """How many records name a file that is not there."""
    _, unmatched = match_records(records, files, column, file_column)
    return unmatched.agg(F.count(F.lit(1)).alias("missing_files"))


def compare_by_key(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Added / Removed / Changed keys between two tables."""
    l = left.select(col(key).alias("path"), col(value).alias("left"), F.lit(True).alias("_l"))
    r = right.select(col(key).alias("path"), col(value).alias("right"), F.lit(True).alias("_r"))
    change = (
        F.when(F.col("_l").isNull(), "Added").when(F.col("_r").isNull(), "Removed")
        .when(~F.col("left").eqNullSafe(F.col("right")), "Changed")
    )
    return l.join(r, "path", "full_outer").select("path", change.alias("change"), "left", "right").where("change is not null")


def map_labels(df: DataFrame, column: str, mapping: DataFrame, code: str = "code", label: str = "label", out: str | None = None) -> DataFrame:
    """Decode (or encode) through a (code, label) mapping; unknown codes become null."""
    m = mapping.select(col(code).alias("_code"), col(label).alias(out or f"{column}_label"))
    return df.join(m, col(column) == F.col("_code"), "left").drop("_code")


def attach(results: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """Bring original columns back to result rows by key, never by position."""
    extra = [c for c in originals.columns if c == key or c not in results.columns]
    return results.join(originals.select(*[col(c) for c in extra]), key, "left")


# ---- window-shaped -----------------------------------------------------------------------

def remove_duplicates(df: DataFrame, subset: list[str] | None, order_by: list[str], keep: str | bool = "first") -> DataFrame:
    """Keep the first or last row of equal ``subset`` values, or none of the copies (``False``).

    Written as an aggregate of the whole row rather than a window: copies of a hot key combine
    before the shuffle, so no task holds all of them.
    """
    keys = subset or [c for c in df.columns if c not in order_by]
    row = F.struct(*[col(c) for c in df.columns])
    rank = F.struct(*[col(c) for c in order_by])
    picked = (F.max_by if keep == "last" else F.min_by)(row, rank)
    groups = df.groupBy(*[col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(
        picked.alias("_row"), F.count(F.lit(1)).alias("_n")
    )
    if keep is False:
        groups = groups.where("_n = 1")
    return groups.select("_row.*")


def label_codes(df: DataFrame, column: str, missing_label: str = "nan") -> DataFrame:
    """(label, code): dense codes of the sorted distinct texts."""
    labels = df.select(F.coalesce(present(df, column).cast("string"), F.lit(missing_label)).alias("label")).distinct()
    return global_row_number(labels, [F.col("label")], "code")


def number_records(df: DataFrame, within: str, order_by: str, name: str = "record") -> DataFrame:
    """1..n in document order; documents are bounded by what one file can hold."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(within).orderBy(order_by)))


def running_total(df: DataFrame, order_by: str, value: str, name: str = "cumulative") -> DataFrame:
    """Running sum over a short table (components, days)."""
    w = Window.orderBy(order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w))


def best_per_group(df: DataFrame, by: str, score: str, pick: list[str], tie: str, largest: bool = True) -> DataFrame:
    """The row with the best score per group; ties go to the smallest ``tie``."""
    rank = F.struct((-F.col(score) if largest else F.col(score)).alias("s"), col(tie).alias("t"))
    row = F.struct(*[col(c) for c in pick], col(score))
    return df.groupBy(by).agg(F.min_by(row, rank).alias("_r")).select(by, "_r.*")


# ---- sort, limit, sets ---------------------------------------------------------------------

def sort_rows(df: DataFrame, column: str, ascending: bool = True, tie: list[str] = ()) -> DataFrame:
    """Missing values last in both directions."""
    value = present(df, column)
    order = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    return df.orderBy(order, *tie)


def head(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def top_k(df: DataFrame, weight: str, name: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(weight), F.asc(name)).limit(k)


def top_k_per_group(df: DataFrame, by: str, weight: str, name: str, k: int) -> DataFrame:
    """k heaviest rows per group. Spark limits each partition's group to k rows before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(weight), F.asc(name))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sort_by_category(df: DataFrame, column: str, order: list[str], tie: list[str] = ()) -> DataFrame:
    return df.orderBy(category_rank(column, order), *tie)


def category_rank(column: str, order: list[str]) -> Column:
    """Position of the value in ``order``; unknown values come last."""
    out = F.when(F.lit(False), F.lit(-1))
    for i, v in enumerate(order):
        out = out.when(col(column) == v, F.lit(i))
    return out.otherwise(F.lit(len(order)))


def append(top: DataFrame, bottom: DataFrame) -> DataFrame:
    return top.unionByName(bottom, allowMissingColumns=True)


def removed_names(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    return before.select(column).distinct().join(after.select(column), column, "left_anti")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
