"""Association between columns: Pearson, Spearman, Kendall, correlation ratio, Cramér's V."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import col, numeric_columns, present
from tabloom.operators.ranking import running_share
from tabloom.session import cut_lineage

PAIRS_PER_PASS = 200

CELLS_PER_SLICE = 100_000


def _pair_schema() -> str:
    return "a string, b string, r double"


def pearson_pairs(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(a, b, r) for every pair a before b; rows complete in both columns; one scan."""
    cols = cols or numeric_columns(df)
    pairs = list(combinations(cols, 2))
    out = None
    for i in range(0, len(pairs), PAIRS_PER_PASS):
        chunk = pairs[i : i + PAIRS_PER_PASS]
        aggs = [F.corr(present(df, a).cast("double"), present(df, b).cast("double")).alias(f"r{j}") for j, (a, b) in enumerate(chunk)]
        structs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{j}").alias("r")) for j, (a, b) in enumerate(chunk)]
        part = df.agg(*aggs).select(F.inline(F.array(*structs)))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame([], _pair_schema())
    return out.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def _contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(x, y, n) over rows complete in both columns: hot pairs combine before the shuffle."""
    return (
        df.select(present(df, a).alias("x"), present(df, b).alias("y"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _pair_cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """(pair, x, y, n) for all column pairs in one scan; equal cells combine before the shuffle."""
    pairs = list(combinations(cols, 2))
    structs = [
        F.struct(F.lit(i).alias("pair"), present(df, a).cast("double").alias("x"), present(df, b).cast("double").alias("y"))
        for i, (a, b) in enumerate(pairs)
    ]
    return (
        df.select(F.inline(F.array(*structs))).where("x IS NOT NULL AND y IS NOT NULL")
        .groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    )


def _by_axis(cells: DataFrame, weight) -> DataFrame:
    """Marginal weight per (pair, axis, value)."""
    sides = F.array(
        F.struct(F.lit("x").alias("axis"), F.col("x").alias("value")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("value"))
    )
    return cells.select("pair", "n", F.inline(sides)).groupBy("pair", "axis", "value").agg(weight.alias("m"))


def _join_axes(cells: DataFrame, coded: DataFrame, name: str) -> DataFrame:
    """Bring the per-value number ``name`` of both axes to the cells as ``<name>_x`` and ``<name>_y``."""
    for axis in ("x", "y"):
        side = coded.where(F.col("axis") == axis).select("pair", F.col("value").alias(axis), F.col(name).alias(f"{name}_{axis}"))
        cells = cells.join(side, ["pair", axis])
    return cells


def _named_pairs(df: DataFrame, cols: list[str], by_pair: DataFrame) -> DataFrame:
    names = df.sparkSession.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(combinations(cols, 2))], "pair int, a string, b string"
    )
    return names.join(by_pair, "pair", "left").select("a", "b", "r")


def spearman_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of the average ranks within pairwise-complete rows, for all pairs."""
    cells = cut_lineage(_pair_cells(df, cols))
    ranked = running_share(cut_lineage(_by_axis(cells, F.sum("n"))), ["pair", "axis"], "value", "m")
    ranked = cut_lineage(ranked.select("pair", "axis", "value", (F.col("before") + (F.col("m") + 1) / 2.0).alias("rank")))
    joined = _join_axes(cells, ranked, "rank")
    x, y, n = F.col("rank_x"), F.col("rank_y"), F.col("n")
    total = F.sum(n)
    mid2 = total * ((total + 1) / 2.0) * ((total + 1) / 2.0)  # the mean rank is known
    by_pair = joined.groupBy("pair").agg(
        (F.sum(n * x * y) - mid2).alias("xy"), (F.sum(n * x * x) - mid2).alias("xx"), (F.sum(n * y * y) - mid2).alias("yy")
    )
    r = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    return _named_pairs(df, cols, by_pair.select("pair", r.alias("r")))


def kendall_pairs(df: DataFrame, cols: list[str], slice_bits: int | None = None) -> DataFrame:
    """Tau-b for all pairs without forming pairs of rows.

    Distinct cells (x, y, n) get dense codes. Discordant pairs are counted one bit of the y code
    at a time: two rows first differ in bit k exactly when their codes agree above k, so per
    prefix the job needs, for each row with bit 0, the weight of rows with bit 1 at a smaller x.
    That is a running sum. Prefix groups can be as large as the table, therefore x codes are cut
    into slices: sums inside a slice by window, sums of whole slices by a window over slice totals.
    The number of slices follows the number of cells.
    """
    cells = cut_lineage(_pair_cells(df, cols))
    codes = running_share(cut_lineage(_by_axis(cells, F.max(F.lit(1)))), ["pair", "axis"], "value", "m", "code")
    coded = cut_lineage(
        _join_axes(cells, codes, "code").select("pair", F.col("code_x").alias("cx"), F.col("code_y").alias("cy"), F.col("n").cast("double").alias("n"))
    )
    top = coded.agg(F.max("cx"), F.max("cy"), F.count(F.lit(1))).first()
    if top[0] is None:
        return _named_pairs(df, cols, coded.select("pair", F.col("n").alias("r")))
    bits = max(1, int(top[1]).bit_length())
    slice_bits = max(10, (int(top[2]) // CELLS_PER_SLICE).bit_length()) if slice_bits is None else slice_bits
    shift_x = max(0, int(top[0]).bit_length() - slice_bits)
    choose2 = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    all_ties = coded.groupBy("pair").agg(F.sum("n").alias("total"), choose2("n").alias("xy_tie"))
    x_ties = coded.groupBy("pair", "cx").agg(F.sum("n").alias("m")).groupBy("pair").agg(choose2("m").alias("x_tie"))
    y_ties = coded.groupBy("pair", "cy").agg(F.sum("n").alias("m")).groupBy("pair").agg(choose2("m").alias("y_tie"))
    bit = F.expr("shiftright(cy, k) & 1")
    levels = (
        coded.select("pair", "cx", "cy", "n", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("k"))
        .groupBy("pair", "k", F.expr("shiftright(cy, k + 1)").alias("prefix"), F.expr(f"shiftright(cx, {shift_x})").alias("s"), "cx")
        .agg(F.sum(F.when(bit == 1, F.col("n")).otherwise(0.0)).alias("ones"), F.sum(F.when(bit == 0, F.col("n")).otherwise(0.0)).alias("zeros"))
    )
    upto = (Window.unboundedPreceding, -1)
    group = ["pair", "k", "prefix"]
    in_slice = Window.partitionBy(*group, "s").orderBy("cx").rowsBetween(*upto)
    slices = levels.withColumn("seen", F.coalesce(F.sum("ones").over(in_slice), F.lit(0.0))).groupBy(*group, "s").agg(
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.sum(F.col("zeros") * F.col("seen")).alias("inner_pairs")
    )
    over_slices = Window.partitionBy(*group).orderBy("s").rowsBetween(*upto)
    discordant = (
        slices.withColumn("seen", F.coalesce(F.sum("ones").over(over_slices), F.lit(0.0)))
        .groupBy("pair").agg(F.sum(F.col("inner_pairs") + F.col("zeros") * F.col("seen")).alias("discordant"))
    )
    joined = all_ties.join(x_ties, "pair").join(y_ties, "pair").join(discordant, "pair")
    n0 = F.col("total") * (F.col("total") - 1) / 2
    score = n0 - F.col("x_tie") - F.col("y_tie") + F.col("xy_tie") - 2 * F.col("discordant")
    denom = (n0 - F.col("x_tie")) * (n0 - F.col("y_tie"))
    return _named_pairs(df, cols, joined.select("pair", F.when(denom > 0, score / F.sqrt(denom)).alias("r")))


def correlation_pairs(df: DataFrame, cols: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """Upper triangle of the correlation matrix in long form."""
    cols = cols or numeric_columns(df)
    if method == "pearson":
        return pearson_pairs(df, cols)
    return {"spearman": spearman_pairs, "kendall": kendall_pairs}[method](df, cols)


def correlation_matrix(df: DataFrame, cols: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """Square matrix: one row per column name, one column per column name."""
    cols = cols or numeric_columns(df)
    pairs = correlation_pairs(df, cols, method)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], _pair_schema())
    return both.unionByName(diagonal).groupBy("a").pivot("b", cols).agg(F.first("r")).withColumnRenamed("a", "column")


def top_correlated_pairs(
    df: DataFrame, cols: list[str] | None = None, method: str = "pearson", top_n: int = 20, digits: int | None = None
) -> DataFrame:
    pairs = correlation_pairs(df, cols, method).where(F.col("r").isNotNull())
    if digits is not None:
        pairs = pairs.withColumn("r", F.round("r", digits))
    return pairs.orderBy(F.desc(F.abs("r")), "a", "b").limit(top_n)


def max_pairwise_correlation(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The pair with the largest |r| (null r for fewer than two columns)."""
    pairs = pearson_pairs(df, cols).where(F.col("r").isNotNull())
    return pairs.agg(F.max(F.abs("r")).alias("max_abs_r"), F.max_by(F.struct("a", "b"), F.abs("r")).alias("p")).select(
        F.col("p.a").alias("a"), F.col("p.b").alias("b"), "max_abs_r"
    )


def correlation_ratios(df: DataFrame, pairs: list[tuple[str, str, str]], min_avg_group_size: float = 3.0) -> DataFrame:
    """(name, eta) for (name, category, value) pairs: square root of the share of variance between the groups.

    All pairs come from one scan and one shuffle of (name, category) sums.
    """
    cells = [F.struct(F.lit(n).alias("name"), present(df, c).cast("string").alias("c"), present(df, v).cast("double").alias("v")) for n, c, v in pairs]
    rows = df.select(F.inline(F.array(*cells))).where(F.col("c").isNotNull() & F.col("v").isNotNull())
    # var_pop is merged numerically stably; sums of squares are rebuilt per group.
    groups = rows.groupBy("name", "c").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2"))
    total = groups.groupBy("name").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        F.sum(F.col("n") * F.col("s2")).alias("within"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nm2"),
    )
    between = F.col("nm2") - F.col("n") * F.col("grand") * F.col("grand")
    sst = between + F.col("within")
    eta = (
        F.when(F.col("n").isNull() | (F.col("k") < 2), 0.0)
        .when(F.col("n") / F.col("k") < min_avg_group_size, 0.0)
        .when(sst <= 0, 0.0)
        .otherwise(F.sqrt(F.greatest(between / sst, F.lit(0.0))))
    )
    names = df.sparkSession.createDataFrame([(n,) for n, _, _ in pairs], "name string")
    return names.join(total, "name", "left").select("name", F.coalesce(eta, F.lit(0.0)).alias("eta"))


def correlation_ratio(df: DataFrame, category: str, value: str, min_avg_group_size: float = 3.0) -> DataFrame:
    """Eta of one pair."""
    return correlation_ratios(df, [("", category, value)], min_avg_group_size).select("eta")


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Without bias correction; from the sparse contingency table only."""
    cells = _contingency(df, a, b)
    rows = cells.groupBy("x").agg(F.sum("n").alias("nx"))
    cols = cells.groupBy("y").agg(F.sum("n").alias("ny"))
    n, nx, ny = (F.col(c).cast("double") for c in ("n", "nx", "ny"))
    inner = cells.join(rows, "x").join(cols, "y").agg(
        F.sum(n * n / (nx * ny)).alias("phi"), F.sum("n").alias("total"),
        F.count_distinct("x").alias("r"), F.count_distinct("y").alias("k"),
    )
    side = F.least("r", "k")
    v = F.when(F.col("total").isNull() | (side < 2), 0.0).otherwise(
        F.sqrt(F.greatest(F.col("phi") - 1.0, F.lit(0.0)) / (side - 1))
    )
    return inner.select(v.alias("v"))


def variation_score(df: DataFrame, column: str) -> DataFrame:
    """min(1, std / |mean|); std alone when the mean is about zero."""
    v = present(df, column).cast("double")
    m, s = F.col("m"), F.col("s")
    return df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s")).select(
        F.least(F.lit(1.0), F.when(F.abs(m) > 1e-9, s / F.abs(m)).otherwise(s)).alias("score")
    )


def category_count_score(df: DataFrame, column: str) -> DataFrame:
    """Highest for columns with about one category per twenty rows."""
    v = present(df, column)
    return df.agg((F.count_distinct(v) / F.count(v)).alias("u")).select(
        F.greatest(F.lit(0.0), 1 - F.abs(F.col("u") - 0.05) / 0.5).alias("score")
    )
