"""Exact quantiles with linear interpolation, also for groups too large for one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer. That is fine
below ``SINGLE_TASK_ROWS``. For larger groups each wanted rank gets a bracket [lo, hi]; one pass
counts the rows of all brackets in equal-width bins (a small, map-side combined aggregate), the
bin that holds the rank becomes the next bracket, and the step repeats until the bracket is one
value or small enough to finish. The answer is exact and the number of groups is unlimited.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import present
from tabloom.session import broadcast_if_small, cut_lineage

SINGLE_TASK_ROWS = 2_000_000
BINS = 1_024
MAX_PASSES = 60


def melt_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """(key = column name, value double) for every non-missing numeric cell."""
    parts = [F.struct(F.lit(c).alias("key"), present(df, c).cast("double").alias("value")) for c in cols]
    return (
        df.select(F.inline(F.array(*parts))).where(F.col("value").isNotNull())
    )


def quantiles_by_key(long: DataFrame, probs: list[float], single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """``(key, value)`` -> ``(key, prob, quantile)``; missing values must be gone already."""
    counts = long.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    pct = [F.struct(F.lit(float(p)).alias("prob"), F.percentile("value", float(p)).alias("quantile")) for p in probs]
    if counts.where(F.col("n") > single_task_rows).limit(1).count() == 0:
        return long.groupBy("key").agg(F.array(*pct).alias("q")).select("key", F.inline("q"))
    sizes = cut_lineage(counts)
    hot = sizes.where(F.col("n") > single_task_rows)
    side = broadcast_if_small(hot.select("key"))
    small = long.join(side, "key", "left_anti").groupBy("key").agg(F.array(*pct).alias("q")).select("key", F.inline("q"))
    return small.unionByName(_narrow(long.join(side, "key", "left_semi"), hot, probs, single_task_rows))


def _narrow(long: DataFrame, sizes: DataFrame, probs: list[float], limit: int) -> DataFrame:
    """Quantiles of the hot keys from the two order statistics around each position."""
    wanted = sizes.select("key", "n", "lo", "hi", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    wanted = wanted.withColumn("pos", F.col("prob") * (F.col("n") - 1))
    base = F.floor("pos")
    ranks = wanted.select("key", "prob", (F.col("pos") - base).alias("frac"), "n", "lo", "hi",
                          F.posexplode(F.array(base, F.least(base + 1, F.col("n") - 1))).alias("upper", "rank"))
    ranks = cut_lineage(ranks)
    state = ranks.select("key", "rank", "n", "lo", "hi").distinct().select("key", F.col("rank").alias("slot"), "rank", "n", "lo", "hi")
    solved = None
    for _ in range(MAX_PASSES):
        state = cut_lineage(state)
        done = state.where("lo = hi").select("key", "slot", F.col("lo").alias("value"))
        open_ = state.where("lo < hi")
        finish = open_.where(F.col("n") <= limit)
        done = done.unionByName(_pick(long, finish))
        solved = done if solved is None else solved.unionByName(done)
        state = open_.where(F.col("n") > limit)
        if state.limit(1).count() == 0:
            break
        state = _bins(long, state)
    else:
        raise RuntimeError("quantile brackets did not close: are there infinite values?")
    values = ranks.join(solved.withColumnRenamed("slot", "rank"), ["key", "rank"])
    low, high = F.max(F.when(F.col("upper") == 0, F.col("value"))), F.max(F.when(F.col("upper") == 1, F.col("value")))
    return values.groupBy("key", "prob", "frac").agg(low.alias("low"), high.alias("high")).select(
        "key", "prob", (F.col("low") + (F.col("high") - F.col("low")) * F.col("frac")).alias("quantile"))


def _bracketed(long: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of each open bracket; a row meets only the few brackets of its own key."""
    return long.join(broadcast_if_small(state), "key").where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))


def _bins(long: DataFrame, state: DataFrame) -> DataFrame:
    """The bin around each rank as the next bracket, with its own smallest and largest value."""
    share = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    slot = F.least(F.floor(share * BINS), F.lit(BINS - 1))
    cells = _bracketed(long, state).groupBy("key", "slot", "rank", slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    before = Window.partitionBy("key", "slot").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    held = (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))
    return cells.where(held).select("key", "slot", (F.col("rank") - F.col("before")).alias("rank"), "n", "lo", "hi")


def _pick(long: DataFrame, state: DataFrame) -> DataFrame:
    """Order statistics inside brackets that are known to be small."""
    freq = _bracketed(long, state).groupBy("key", "slot", "rank", "value").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("key", "slot").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    hit = freq.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
    return hit.select("key", "slot", "value")


def column_quantiles(
    df: DataFrame, cols: list[str], probs: list[float], single_task_rows: int = SINGLE_TASK_ROWS
) -> dict[str, dict[float, float]]:
    """Quantiles of whole columns as driver values (a few numbers per column)."""
    if not cols:
        return {}
    out: dict[str, dict[float, float]] = {c: {} for c in cols}
    n = df.agg(F.count(F.lit(1))).first()[0]
    if n <= single_task_rows:
        exprs = [F.percentile(present(df, c).cast("double"), [float(p) for p in probs]).alias(f"c{i}") for i, c in enumerate(cols)]
        row = df.agg(*exprs).first()
        for i, c in enumerate(cols):
            values = row[f"c{i}"]
            out[c] = {p: (values[j] if values else None) for j, p in enumerate(probs)}
        return out
    for r in quantiles_by_key(melt_numeric(df, cols), probs, single_task_rows).collect():
        out[r["key"]][r["prob"]] = r["quantile"]
    return out
