"""Row numbers and running totals over a whole table without a one-task window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import broadcast_if_small, cut_lineage, is_small

SINGLE_TASK_ROWS = 200_000  # up to here one sorted task is cheaper than a range shuffle
ROWS_PER_SLICE = 1_000_000


def global_row_number(
    df: DataFrame,
    order_by: list[Column],
    name: str = "row_number",
    start: int = 0,
    single_task_rows: int = SINGLE_TASK_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Number all rows 0.. (or from ``start``) in a total order.

    ``order_by`` must end in a unique key. Large inputs are range-partitioned and sorted,
    the numbered partitions are checkpointed (so that a retry cannot move a boundary), and
    each partition is shifted by the row count of the partitions before it. Only one count
    per partition reaches the driver.
    """
    if is_small(df, single_task_rows):
        rn = F.row_number().over(Window.orderBy(*order_by)) - 1 + start
        return df.withColumn(name, rn.cast("bigint"))
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // ROWS_PER_SLICE + 1)
    ranged = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
    ranged = ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged)
    counts = {r["_pid"]: r["n"] for r in ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], start
    for pid in sorted(counts):
        offsets.append((pid, total))
        total += counts[pid]
    shift = spark.createDataFrame(offsets, "_pid int, _shift bigint")  # one row per partition
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranged.join(F.broadcast(shift), "_pid")
        .withColumn(name, (F.col("_shift") + local).cast("bigint"))
        .drop("_pid", "_mid", "_shift")
    )


def hash_rank(
    df: DataFrame,
    key: str,
    seed: int = 42,
    group: str | None = None,
    name: str = "rank",
    bucket_digits: int | None = None,
) -> DataFrame:
    """0-based rank of every row by ``md5(key-seed)``, over the table or inside ``group``.

    The leading hex digits of the hash cut the order into 16**bucket_digits even slices, so no
    task holds more than one slice of a group, however large the group. Slice sizes are added
    up per group and joined back. The number of digits follows the row count.
    """
    if bucket_digits is None:
        n = df.agg(F.count(F.lit(1))).first()[0]
        bucket_digits = max(1, math.ceil(math.log(max(n, 2) / ROWS_PER_SLICE, 16)))
    hashed = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    work = df.withColumn("_h", hashed).withColumn("_b", F.substring("_h", 1, bucket_digits))
    groups = [group] if group else []
    sizes = work.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # One row per (group, slice): bounded by the number of groups times the number of slices.
    before = Window.partitionBy(*[F.col(g) for g in groups]) if groups else Window.partitionBy(F.lit(1))
    before = before.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_h", key))
    ranked = work.withColumn("_local", local)
    if group:
        shifts = shifts.withColumnRenamed(group, "_g").withColumnRenamed("_b", "_sb")
        joined = ranked.join(shifts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_sb"))).drop("_g", "_sb")
    else:
        joined = ranked.join(shifts, "_b")  # 16**bucket_digits rows on one side: broadcast by size
    return joined.withColumn(name, (F.col("_before") + F.col("_local") - 1).cast("bigint")).drop(
        "_h", "_b", "_before", "_local"
    )


def running_share(
    counts: DataFrame,
    by: list[str],
    order: str,
    weight: str,
    name: str = "before",
    buckets: int | None = None,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Per ``by`` group, the sum of ``weight`` over rows with a smaller ``order`` value.

    ``order`` is numeric and unique inside a group. Groups may be as large as the table, so large
    inputs are cut into slices at approximate quantiles of ``order``: a window inside each slice
    plus the running total of whole slices. Slice edges are one short array per group.
    """
    upto = (Window.unboundedPreceding, -1)
    if is_small(counts, single_task_rows):
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(*upto)
        return counts.withColumn(name, F.coalesce(F.sum(weight).over(w), F.lit(0)))
    if buckets is None:
        buckets = max(16, counts.count() // ROWS_PER_SLICE)
    fine = max(2, math.isqrt(buckets))
    probs = [i / (fine * fine) for i in range(1, fine * fine)]
    cuts = F.percentile_approx(order, probs, 10_000)
    edges = counts.groupBy(*by).agg(cuts.alias("_cuts"))
    # Two-level lookup: the coarse edges pick one short list of fine edges.
    edges = edges.select(
        *by, F.array(*[F.get("_cuts", F.lit(i * fine - 1)) for i in range(1, fine)]).alias("_coarse"),
        F.array(*[F.slice("_cuts", max(1, i * fine), fine) for i in range(fine)]).alias("_fine"))
    edges = broadcast_if_small(cut_lineage(edges))  # stored: a second sketch could cut elsewhere
    below = lambda edge_list: F.size(F.filter(edge_list, lambda e: e < F.col(order)))
    sliced = counts.join(edges, by).withColumn("_top", below(F.col("_coarse")))
    sliced = sliced.withColumn("_s", F.col("_top") * F.lit(fine + 1) + below(F.get("_fine", F.col("_top")))).drop("_coarse", "_fine", "_top")
    totals = sliced.groupBy(*by, "_s").agg(F.sum(weight).alias("_t"))
    over_slices = Window.partitionBy(*by).orderBy("_s").rowsBetween(*upto)
    shifts = totals.withColumn("_shift", F.coalesce(F.sum("_t").over(over_slices), F.lit(0))).drop("_t")
    inside = Window.partitionBy(*by, "_s").orderBy(order).rowsBetween(*upto)
    return (
        sliced.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(shifts, [*by, "_s"])
        .withColumn(name, F.col("_in") + F.col("_shift"))
        .drop("_s", "_in", "_shift")
    )
