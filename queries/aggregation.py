"""Profiles and aggregation (A1-A25)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from queries.base import (
    LINEITEM_NULLS, LINEITEM_NUMERIC, LINEITEM_TYPES, ORDERS_DUP, lineitem_nulls, orders_dup, query, table, union_all,
)
from tabloom.operators import association, profile

COLS = list(LINEITEM_TYPES)
MISS = " + ".join(f"count(*) - count({c})" for c in COLS)


@query("a1_shape_card", f"""WITH {LINEITEM_NULLS}
SELECT count(*) AS rows, 11::BIGINT AS columns, 8::BIGINT AS numeric, 2::BIGINT AS categorical,
       ({MISS})::BIGINT AS missing_cells FROM lineitem_nulls""")
def shape_card(spark, d):
    return profile.shape_card(lineitem_nulls(spark, d))


def _overview_sql(source, types):
    return union_all([
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(DISTINCT {c}) AS "unique",
        count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 1) AS missing_pct FROM {source}"""
        for c, t in types.items()
    ])


@query("a2_dataset_overview", _overview_sql("lineitem", LINEITEM_TYPES))
def overview(spark, d):
    return profile.dataset_overview(table(spark, d, "lineitem"))


@query("a2_dataset_overview_nulls", f"WITH {LINEITEM_NULLS} {_overview_sql('lineitem_nulls', LINEITEM_TYPES)}")
def overview_nulls(spark, d):
    return profile.dataset_overview(lineitem_nulls(spark, d))


@query("a3_column_types", f"WITH {LINEITEM_NULLS} " + union_all([
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null,
    round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_pct FROM lineitem_nulls""" for c, t in LINEITEM_TYPES.items()]))
def column_types(spark, d):
    return profile.column_types(lineitem_nulls(spark, d))


def describe_sql(relation, texts, numbers, dates):
    return union_all([
        f"""SELECT '{c}' AS "column", count({c}) AS "count", count(DISTINCT {c}) AS "unique",
    (SELECT {c}::VARCHAR FROM {relation} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c}::VARCHAR LIMIT 1) AS top,
    (SELECT count(*) FROM {relation} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS freq,
    NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS "min", NULL::DOUBLE AS q25, NULL::DOUBLE AS q50,
    NULL::DOUBLE AS q75, NULL::DOUBLE AS "max" FROM {relation}""" for c in texts] + [
        f"""SELECT '{c}', count({c}), NULL, NULL, NULL, round(avg({v}), 4), {std}, min({v}),
    round(quantile_cont({v}, 0.25), 4), round(quantile_cont({v}, 0.5), 4), round(quantile_cont({v}, 0.75), 4), max({v}) FROM {relation}"""
        for c, v, std in [(c, f"{c}::DOUBLE", f"round(stddev_samp({c}), 4)") for c in numbers] + [(c, f"epoch({c})", "NULL") for c in dates]])


@query("a4_describe_all", f"WITH {LINEITEM_NULLS} " + describe_sql("lineitem_nulls", ["l_returnflag", "l_linestatus"], LINEITEM_NUMERIC, ["l_shipdate"]))
def describe(spark, d):
    out = profile.describe_all(lineitem_nulls(spark, d))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query("a4_describe_booleans", "WITH o AS (SELECT o_totalprice > 100000 AS dear, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus = 'F' END AS done, o_orderdate FROM orders) " + describe_sql("o", ["dear", "done"], [], ["o_orderdate"]))
def describe_booleans(spark, d):
    o = table(spark, d, "orders").select((F.col("o_totalprice") > 100000).alias("dear"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus") == "F").alias("done"), "o_orderdate")
    return profile.describe_all(o).withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query("a5_missing_value_summary", f"WITH {LINEITEM_NULLS} SELECT * FROM (" + union_all([
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
    round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct FROM lineitem_nulls""" for c in COLS]) + ") WHERE missing > 0")
def missing_summary(spark, d):
    return profile.missing_value_summary(lineitem_nulls(spark, d))


@query("a6_value_counts", """SELECT p_type AS value, count(*) AS "count" FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def value_counts(spark, d):
    return profile.value_counts(table(spark, d, "part"), "p_type", 20)


@query("a7_group_counts", f"""WITH {LINEITEM_NULLS} SELECT l_returnflag, l_linestatus, count(*) AS "count"
FROM lineitem_nulls GROUP BY 1, 2""")
def group_counts(spark, d):
    return profile.group_counts(lineitem_nulls(spark, d), ["l_returnflag", "l_linestatus"])


@query("a8_grouped_means", f"""WITH {LINEITEM_NULLS} SELECT l_returnflag, round(avg(l_quantity), 3) AS l_quantity,
round(avg(l_extendedprice), 3) AS l_extendedprice FROM lineitem_nulls WHERE l_returnflag IS NOT NULL GROUP BY 1""")
def grouped_means(spark, d):
    return profile.grouped_means(lineitem_nulls(spark, d), "l_returnflag", ["l_quantity", "l_extendedprice"])


@query("a9_tag_summary", """SELECT role, count(*) AS "count", count(*) FILTER (trim(coalesce(text, '')) <> '') AS with_text
FROM conversations GROUP BY 1""")
def tag_summary(spark, d):
    return profile.tag_summary(table(spark, d, "conversations"), "role", "text")


@query("a10_pivot_mean", """SELECT o_orderpriority,
round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 3) AS "F", round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 3) AS "O",
round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 3) AS "P" FROM orders GROUP BY 1""")
def pivot_mean(spark, d):
    return profile.pivot_mean(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O", "P"], 3)


def _hist_sql(source, c, bins):
    return f"""WITH b AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {source}),
h AS (SELECT least(floor(({c} - lo) / ((hi - lo) / {bins})), {bins - 1})::INT AS bin, count(*) AS n FROM {source}, b GROUP BY 1)
SELECT g.bin, round(lo + g.bin * ((hi - lo) / {bins}), 4) AS lo, round(lo + (g.bin + 1) * ((hi - lo) / {bins}), 4) AS hi,
coalesce(n, 0) AS "count" FROM (SELECT range::INT AS bin FROM range({bins})) g LEFT JOIN h USING (bin), b"""


@query("a11_histogram", _hist_sql("lineitem", "l_extendedprice", 50))
def histogram(spark, d):
    out = profile.histogram(table(spark, d, "lineitem"), "l_extendedprice", 50)
    return out.withColumns({"lo": F.round("lo", 4), "hi": F.round("hi", 4)})


@query("a11_histogram_auto_bins", """WITH b AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi, count(*) AS n,
ceil(log2(count(*)))::INT + 1 AS bins FROM documents),
h AS (SELECT least(floor((n_chars - lo) / ((hi - lo) / bins)), bins - 1)::INT AS bin, count(*) AS c FROM documents, b GROUP BY 1)
SELECT g.bin, coalesce(c, 0) AS "count" FROM (SELECT unnest(range(bins))::INT AS bin FROM b) g LEFT JOIN h USING (bin)""")
def histogram_auto(spark, d):
    return profile.histogram(table(spark, d, "documents"), "n_chars", None).select("bin", "count")


@query("a12_box_summary", """WITH q AS (SELECT l_returnflag AS key, quantile_cont(l_extendedprice, 0.25) AS q1,
quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT key, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(l_extendedprice) AS "min", max(l_extendedprice) AS "max",
min(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
max(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
count(*) FILTER (NOT l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS "count"
FROM lineitem JOIN q ON key = l_returnflag GROUP BY key, q1, median, q3""")
def box_summary(spark, d):
    out = profile.box_summary(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("a13_daily_mean", """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1""")
def daily_mean(spark, d):
    out = profile.daily_mean(table(spark, d, "orders"), "o_orderdate", "o_totalprice")
    return out.select(F.col("day").cast("string").alias("day"), F.round("mean", 6).alias("mean"))


@query("a13_daily_count", """WITH e AS (SELECT ts FROM events),
c AS (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM e)
SELECT strftime(c.day, '%Y-%m-%d') AS day, count(e.ts) AS "count" FROM c LEFT JOIN e ON e.ts::DATE = c.day GROUP BY 1""")
def daily_count(spark, d):
    return profile.daily_count(table(spark, d, "events"), "ts").withColumn("day", F.col("day").cast("string"))


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PEARSON = union_all([
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem_nulls" for a, b in combinations(CORR, 2)])


@query("a14_pearson_pairs", f"WITH {LINEITEM_NULLS} {PEARSON}")
def pearson(spark, d):
    return association.pearson_pairs(lineitem_nulls(spark, d), CORR).withColumn("r", F.round("r", 6))


@query("a14_correlation_matrix", f"WITH {LINEITEM_NULLS} " + union_all([
    f"""SELECT '{a}' AS "column", """ + ", ".join(
        f"1.0::DOUBLE AS {b}" if a == b else f"round(corr({a}, {b}), 6) AS {b}" for b in CORR) + " FROM lineitem_nulls" for a in CORR]))
def matrix(spark, d):
    out = association.correlation_matrix(lineitem_nulls(spark, d), CORR)
    return out.withColumns({c: F.round(c, 6) for c in CORR})


def _rank_pair(a, b):
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) AS r FROM (
  SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
  FROM lineitem_nulls WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query("a15_spearman_pairs", f"WITH {LINEITEM_NULLS} " + union_all([_rank_pair(a, b) for a, b in combinations(CORR, 2)]))
def spearman(spark, d):
    return association.correlation_pairs(lineitem_nulls(spark, d), CORR, "spearman").withColumn("r", F.round("r", 6))


def _tau(a, b):
    return f"""SELECT '{a}' AS a, '{b}' AS b, (WITH c AS (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS n FROM lineitem_nulls
  WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
  s AS (SELECT sum(p.n * q.n * sign(p.x - q.x) * sign(p.y - q.y)) / 2 AS d FROM c p, c q),
  t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS n0 FROM c),
  tx AS (SELECT sum(m * (m - 1) / 2) AS n1 FROM (SELECT sum(n) AS m FROM c GROUP BY x)),
  ty AS (SELECT sum(m * (m - 1) / 2) AS n2 FROM (SELECT sum(n) AS m FROM c GROUP BY y))
  SELECT round(d / sqrt((n0 - n1) * (n0 - n2)), 6) FROM s, t, tx, ty) AS r"""


TAU = ["l_quantity", "l_discount", "l_tax"]


@query("a16_kendall_pairs", f"WITH {LINEITEM_NULLS} " + union_all([_tau(a, b) for a, b in combinations(TAU, 2)]))
def kendall(spark, d):
    return association.correlation_pairs(lineitem_nulls(spark, d), TAU, "kendall").withColumn("r", F.round("r", 6))


@query("a17_top_correlated_pairs", f"WITH {LINEITEM_NULLS} SELECT * FROM ({PEARSON}) ORDER BY abs(r) DESC, a, b LIMIT 3")
def top_pairs(spark, d):
    return association.top_correlated_pairs(lineitem_nulls(spark, d), CORR, "pearson", 3, digits=6)


def eta_sql(source, c, v, digits=5):
    return f"""WITH p AS (SELECT {c} AS c, {v}::DOUBLE AS v FROM {source} WHERE {c} IS NOT NULL AND {v} IS NOT NULL),
m AS (SELECT avg(v) AS grand FROM p), g AS (SELECT c, count(*) AS n, avg(v) AS gm FROM p GROUP BY c)
SELECT round(coalesce(CASE WHEN (SELECT count(*) FROM g) < 2 THEN 0 WHEN (SELECT sum(n) / count(*) FROM g) < 3 THEN 0
WHEN (SELECT sum((v - grand) * (v - grand)) FROM p, m) = 0 THEN 0
ELSE sqrt((SELECT sum(n * (gm - grand) * (gm - grand)) FROM g, m) / (SELECT sum((v - grand) * (v - grand)) FROM p, m)) END, 0), {digits})::DOUBLE"""


@query("a18_correlation_ratio", union_all([
    f"SELECT '{c}' AS category, ({eta_sql('part', c, 'p_retailprice')}) AS eta" for c in ("p_brand", "p_type", "p_size", "p_name")]))
def eta(spark, d):
    part = table(spark, d, "part")
    out = None
    for c in ("p_brand", "p_type", "p_size", "p_name"):
        one = association.correlation_ratio(part, c, "p_retailprice").select(F.lit(c).alias("category"), F.round("eta", 5).alias("eta"))
        out = one if out is None else out.unionByName(one)
    return out


def cramers_sql(source, a, b, digits=5):
    return f"""WITH p AS (SELECT {a} AS a, {b} AS b FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
ca AS (SELECT a, count(*) AS n FROM p GROUP BY a), cb AS (SELECT b, count(*) AS n FROM p GROUP BY b),
cells AS (SELECT ca.a, cb.b, ca.n::DOUBLE * cb.n / (SELECT count(*) FROM p) AS e FROM ca, cb),
o AS (SELECT a, b, count(*) AS n FROM p GROUP BY a, b)
SELECT round(sqrt(sum((coalesce(o.n, 0) - e) * (coalesce(o.n, 0) - e) / e) / ((SELECT count(*) FROM p) *
(least((SELECT count(*) FROM ca), (SELECT count(*) FROM cb)) - 1))), {digits}) FROM cells LEFT JOIN o USING (a, b)"""


@query("a19_cramers_v", f"""SELECT ({cramers_sql('orders', 'o_orderpriority', 'o_orderstatus')}) AS v""")
def cramers(spark, d):
    return association.cramers_v(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus").select(F.round("v", 5).alias("v"))


@query("a20_variation_score", """SELECT round(least(1.0, CASE WHEN abs(avg(p_retailprice)) > 1e-9
THEN stddev_samp(p_retailprice) / abs(avg(p_retailprice)) ELSE stddev_samp(p_retailprice) END), 6) AS score FROM part""")
def variation(spark, d):
    return association.variation_score(table(spark, d, "part"), "p_retailprice").select(F.round("score", 6).alias("score"))


@query("a21_category_count_score", """SELECT round(greatest(0.0, 1 - abs(count(DISTINCT p_brand)::DOUBLE / count(p_brand) - 0.05) / 0.5), 6)
AS score FROM part""")
def category_score(spark, d):
    return association.category_count_score(table(spark, d, "part"), "p_brand").select(F.round("score", 6).alias("score"))


@query("a22_duplicate_rows", f"WITH {ORDERS_DUP} SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dup)))::BIGINT AS duplicate_rows FROM orders_dup")
def duplicates(spark, d):
    return profile.duplicate_rows(orders_dup(spark, d))


@query("a23_corpus_summary", r"""SELECT count(*) AS docs, count(DISTINCT source) AS sources,
round(avg(len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda w: w <> ''))), 4) AS mean_words,
round(avg(length(text)), 4) AS mean_chars FROM documents""")
def corpus_summary(spark, d):
    out = profile.corpus_summary(table(spark, d, "documents"))
    return out.withColumns({"mean_words": F.round("mean_words", 4), "mean_chars": F.round("mean_chars", 4)})


@query("a24_max_pairwise_correlation", f"""WITH {LINEITEM_NULLS} SELECT a, b, abs(r) AS max_abs_r FROM ({PEARSON})
ORDER BY abs(r) DESC, a, b LIMIT 1""")
def max_corr(spark, d):
    return association.max_pairwise_correlation(lineitem_nulls(spark, d), CORR).withColumn("max_abs_r", F.round("max_abs_r", 6))


@query("a25_before_after", f"""WITH {LINEITEM_NULLS}
SELECT count(*) AS rows_before, ({MISS})::BIGINT AS missing_before,
count(*) FILTER (l_quantity IS NOT NULL) AS rows_after,
(count(*) FILTER (l_quantity IS NOT NULL AND l_returnflag IS NULL))::BIGINT AS missing_after, 'l_tax' AS columns_removed FROM lineitem_nulls""")
def before_after(spark, d):
    before = lineitem_nulls(spark, d)
    return profile.before_after(before, before.drop("l_tax").where("l_quantity IS NOT NULL"))
