"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of strptime formats and their datetime-pattern counterparts.
STRPTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh",
    "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%j": "DDD",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def title_case(x: Column | str) -> Column:
    """Upper-case the first letter of every run of letters and lower-case the rest.

    A run starts after any non-letter (``o'neil`` -> ``O'Neil``), unlike ``initcap``.
    """
    runs = F.regexp_extract_all(_c(x), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    cased = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 2147483647))))
    return F.array_join(cased, "")


def change_case(x: Column | str, mode: str) -> Column:
    return {"lower": F.lower, "upper": F.upper, "title": title_case}[mode](_c(x))


def collapse_whitespace(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"[\s\p{Z}]+", " "))


def regex_replace(x: Column | str, pattern: str, replacement: str = " ") -> Column:
    return F.regexp_replace(_c(x), pattern, replacement)


def words(x: Column | str) -> Column:
    """Whitespace-separated words without blanks."""
    return F.filter(F.split(_c(x), r"[\s\p{Z}]+"), lambda w: w != "")


def word_count(x: Column | str) -> Column:
    return F.size(words(F.coalesce(_c(x).cast("string"), F.lit("nan"))))


def char_count(x: Column | str) -> Column:
    return F.length(F.coalesce(_c(x).cast("string"), F.lit("nan")))


def preview(x: Column | str, n: int = 80) -> Column:
    return F.substring(_c(x), 1, n)


def java_date_format(strptime_format: str) -> str:
    """Translate a strptime format; literal letters are quoted."""
    out, i = "", 0
    while i < len(strptime_format):
        token = strptime_format[i : i + 2]
        if token in STRPTIME:
            out, i = out + STRPTIME[token], i + 2
        else:
            ch = strptime_format[i]
            out, i = out + (f"'{ch}'" if ch.isalpha() else ch), i + 1
    return out


def reformat_date(x: Column | str, source_format: str, target_format: str) -> Column:
    """Null where the text does not parse."""
    parsed = F.try_to_timestamp(_c(x), F.lit(java_date_format(source_format)))
    return F.date_format(parsed, java_date_format(target_format))


def quantize(x: Column | str, places: int) -> Column:
    """Decimal text with a fixed number of places, half-even; null where the text is no number."""
    number = _c(x).try_cast("decimal(38,18)")
    return F.bround(number, places).cast(f"decimal(38,{places})").cast("string")


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Keep values inside [low, high]; null stays null."""
    c = _c(x)
    out = c
    if high is not None:
        out = F.when(c > high, F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(c < low, F.lit(low)).otherwise(out)
    return out


def signed_log10(x: Column | str) -> Column:
    """-sign(x) * log10(|x|), 0 for 0."""
    c = _c(x)
    return F.when(c == 0, 0.0).otherwise(-F.signum(c) * F.log10(F.abs(c)))


def content_digest(x: Column | str) -> Column:
    return F.sha2(_c(x).cast("binary"), 256)


def table_signature(df):
    """One number for the content of a table, whatever the row order."""
    return df.agg(
        F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("signature"),
        F.count(F.lit(1)).alias("rows"),
    )


def local_name(tag: Column | str) -> Column:
    """Tag without its ``{namespace}``."""
    return F.regexp_replace(_c(tag), r"^.*\}", "")


def namespace_of(tag: Column | str) -> Column:
    return F.regexp_extract(_c(tag), r"^\{(.*)\}", 1)


def child_path(parent: Column | str, tag: Column | str, position: Column) -> Column:
    return F.concat(_c(parent), F.lit("/"), local_name(tag), F.lit("["), position.cast("string"), F.lit("]"))


def hex_colour(r: Column | str, g: Column | str, b: Column | str) -> Column:
    return F.format_string("#%02x%02x%02x", _c(r).cast("int"), _c(g).cast("int"), _c(b).cast("int"))


def map_lookup(attrs: Column | str, name: str) -> Column:
    """Attribute by local name from a map; null when absent."""
    hit = F.filter(F.map_entries(_c(attrs)), lambda e: local_name(e["key"]) == name)
    return F.get(hit, F.lit(0))["value"]
