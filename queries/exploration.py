"""Automatic exploration (E1-E10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.aggregation import _hist_sql, cramers_sql, eta_sql
from queries.base import lineitem_nulls, LINEITEM_NULLS, query, table, union_all
from tabloom.operators import explore


def order_columns(spark, d):
    o = table(spark, d, "orders")
    return o.withColumns({"constant": F.lit("x"), "order_uuid": F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))})


OX = "ox AS (SELECT *, 'x' AS constant, concat('u', o_orderkey) AS order_uuid FROM orders)"
OX_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "constant", "order_uuid"]
ID_RULE = {"o_orderkey": 1, "o_custkey": 1, "o_orderstatus": 1, "o_totalprice": 0, "o_orderdate": 0, "o_orderpriority": 1, "constant": 1, "order_uuid": 1}


def _utility(c, source, idlike):
    return f"""SELECT '{c}' AS "column", CASE WHEN top >= 0.98 THEN 'near-constant' WHEN u >= 0.98 AND {idlike} = 1 THEN 'identifier' END AS reason,
round(CASE WHEN top >= 0.98 THEN top WHEN u >= 0.98 AND {idlike} = 1 THEN u END, 6) AS share
FROM (SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}))::DOUBLE / count({c}) AS top,
count(DISTINCT {c})::DOUBLE / count({c}) AS u FROM {source})"""


E1 = union_all([_utility(c, "ox", ID_RULE[c]) for c in OX_COLS])


@query("e1_column_utility", f'WITH {OX} SELECT "column", reason IS NULL AS useful, reason, share FROM ({E1})')
def utility(spark, d):
    return explore.column_utility_table(order_columns(spark, d)).withColumn("share", F.round("share", 6))


@query("e2_chart_types", f"""WITH {OX} SELECT 'o_orderkey' AS "column", 'histogram_box' AS chart_type UNION ALL SELECT 'o_custkey', 'histogram_box'
UNION ALL SELECT 'o_totalprice', 'histogram_box' UNION ALL SELECT 'o_orderdate', 'line_over_time' UNION ALL """ + union_all([
    f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) <= 20 THEN 'bar_counts' ELSE 'bar_counts_top_n' END FROM ox"
    for c in ("o_orderstatus", "o_orderpriority", "constant", "order_uuid")]))
def charts(spark, d):
    return explore.chart_types(order_columns(spark, d))


E3 = union_all(
    [f"SELECT '{c}' AS \"column\", round(abs(corr({c}, l_extendedprice)), 4) AS score, 'pearson' AS method FROM lineitem"
     for c in ("l_quantity", "l_discount", "l_tax")]
    + [f"SELECT '{c}', round(({eta_sql('lineitem', c, 'l_extendedprice', 12)}), 4), 'correlation ratio'" for c in ("l_returnflag", "l_linestatus")])


@query("e3_relevance_numeric_target", E3)
def relevance(spark, d):
    return explore.relevance_table(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])


@query("e3_relevance_text_target", union_all([
    f"""SELECT 'o_totalprice' AS "column", round(({eta_sql('orders', 'o_orderstatus', 'o_totalprice', 12)}), 4) AS score, 'correlation ratio' AS method""",
    f"""SELECT 'o_orderpriority', round(({cramers_sql('orders', 'o_orderpriority', 'o_orderstatus', 12)}), 4), 'cramers v'"""]))
def relevance_text(spark, d):
    return explore.relevance_table(table(spark, d, "orders"), "o_orderstatus", ["o_totalprice", "o_orderpriority"])


def variety(source, numbers, texts):
    return union_all([
        f"""SELECT '{c}' AS "column", round(least(1.0, stddev_samp({c}) / abs(avg({c}))), 4) AS score, 'coefficient of variation' AS method FROM {source}""" for c in numbers]
        + [f"""SELECT '{c}', round(greatest(0.0, 1 - abs(count(DISTINCT {c})::DOUBLE / count({c}) - 0.05) / 0.5), 4), 'category count' FROM {source}""" for c in texts])


@query("e3_relevance_no_target", variety("part", ["p_size", "p_retailprice"], ["p_brand", "p_type"]))
def relevance_none(spark, d):
    return explore.relevance_table(table(spark, d, "part"), None, ["p_size", "p_retailprice", "p_brand", "p_type"])


E4 = f"""WITH {OX}, u AS ({E1}), s AS (SELECT *, row_number() OVER (ORDER BY score DESC, pos)::INT - 1 AS place FROM (
SELECT "column", chart_type, score, method, pos FROM (VALUES ('o_custkey', 'histogram_box', 0), ('o_orderstatus', 'bar_counts', 1),
('o_totalprice', 'histogram_box', 2), ('o_orderdate', 'line_over_time', 3), ('o_orderpriority', 'bar_counts', 4)) v("column", chart_type, pos)
JOIN ({variety('ox', ['o_custkey', 'o_totalprice'], ['o_orderstatus', 'o_orderdate', 'o_orderpriority'])}) USING ("column")))
SELECT place, "column", chart_type, score, method, CASE WHEN place < 3 THEN 'shown' ELSE 'more' END AS bucket, NULL AS reason FROM s
UNION ALL SELECT NULL, "column", NULL, NULL, NULL, 'skipped', reason FROM u WHERE reason IS NOT NULL"""


@query("e4_select_top_charts", E4)
def top_charts(spark, d):
    return explore.select_top_charts(order_columns(spark, d), None, 3)


@query("e5_auto_eda_chart_data", """SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS "count" FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def auto_eda(spark, d):
    data = explore.auto_eda(table(spark, d, "orders"), None, 6)["chart_data"]
    named = [data[c].select(F.lit(c).alias("column"), "value", "count") for c in ("o_orderstatus", "o_orderpriority")]
    return named[0].unionByName(named[1])


@query("e5_auto_eda_top_pairs", """SELECT a, b, round(r, 6) AS r FROM (SELECT 'o_orderkey' AS a, 'o_custkey' AS b, corr(o_orderkey, o_custkey) AS r FROM orders
UNION ALL SELECT 'o_orderkey', 'o_totalprice', corr(o_orderkey, o_totalprice) FROM orders UNION ALL SELECT 'o_custkey', 'o_totalprice', corr(o_custkey, o_totalprice) FROM orders)""")
def auto_eda_pairs(spark, d):
    return explore.auto_eda(table(spark, d, "orders"))["correlation"]["top_pairs"].withColumn("r", F.round("r", 6))


@query("e6_chart_bar", "SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1, 2")
def chart_bar(spark, d):
    out = explore.chart_data(table(spark, d, "orders"), "bar", "o_orderpriority", "o_totalprice", "o_orderstatus")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("e6_chart_histogram", _hist_sql("part", "p_size", 12))
def chart_hist(spark, d):
    out = explore.chart_data(table(spark, d, "part"), "histogram", "p_size", bins=12)
    return out.withColumns({"lo": F.round("lo", 4), "hi": F.round("hi", 4)})


@query("e6_chart_scatter", "SELECT p_size, p_retailprice, p_type FROM part")
def chart_scatter(spark, d):
    return explore.chart_data(table(spark, d, "part"), "scatter", "p_size", "p_retailprice", "p_type")


@query("e6_chart_line", "SELECT ts::DATE::VARCHAR AS day, value FROM events")
def chart_line(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").cast("string").alias("day"), "value")
    return explore.chart_data(e, "line", "day", "value")


@query("e6_chart_pie", "SELECT event_type, count(*) AS \"count\" FROM events GROUP BY 1")
def chart_pie(spark, d):
    return explore.chart_data(table(spark, d, "events"), "pie", "event_type")


@query("e6_chart_box", """SELECT key, round(quantile_cont(value, 0.25), 4) AS q1, round(median(value), 4) AS median, count(*) AS "count"
FROM (SELECT event_type AS key, value FROM events) GROUP BY 1""")
def chart_box(spark, d):
    out = explore.chart_data(table(spark, d, "events"), "box", "event_type", "value")
    return out.select("key", F.round("q1", 4).alias("q1"), F.round("median", 4).alias("median"), "count")


P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("e6_chart_heatmap", "SELECT p_brand, " + ", ".join(f"round(avg(p_retailprice) FILTER (p_type = '{t}'), 4) AS \"{t}\"" for t in P_TYPES) + " FROM part GROUP BY 1")
def chart_heatmap(spark, d):
    out = explore.chart_data(table(spark, d, "part"), "heatmap", "p_type", "p_brand", value="p_retailprice", levels=P_TYPES)
    return out.withColumns({c: F.round(c, 4) for c in P_TYPES})


@query("e7_multi_series", f"""WITH {LINEITEM_NULLS}, k AS (SELECT l_shipdate::VARCHAR AS day, l_quantity, l_discount FROM lineitem_nulls WHERE l_quantity IS NOT NULL)
SELECT day, 'l_quantity' AS series, l_quantity AS value FROM k UNION ALL SELECT day, 'l_discount', l_discount FROM k""")
def multi(spark, d):
    li = lineitem_nulls(spark, d).withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    return explore.multi_series(li, "day", ["l_quantity", "l_discount"])


@query("e8_pair_plot", "SELECT p_size, p_retailprice, p_type FROM part")
def pair_plot(spark, d):
    return explore.pair_plot(table(spark, d, "part"), ["p_size", "p_retailprice"], "p_partkey", "p_type")


@query("e9_relationship_specs", """WITH r AS (SELECT 'l_quantity' AS x, abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem UNION ALL
SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM lineitem UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM lineitem)
SELECT (row_number() OVER (ORDER BY r DESC))::INT - 1 AS place, 'scatter' AS chart_type, x, 'l_extendedprice' AS y, NULL AS colour FROM r QUALIFY place < 2
UNION ALL SELECT 2, 'violin', 'l_returnflag', 'l_extendedprice', 'l_returnflag' UNION ALL SELECT 3, 'pie', 'l_returnflag', NULL, NULL""")
def specs(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return explore.relationship_specs(li, "l_extendedprice")


@query("e10_run_eda", """SELECT 'struct__p_size' AS "column", count(DISTINCT p_size) AS "unique", 0::BIGINT AS missing FROM part
UNION ALL SELECT 'struct__p_brand', count(DISTINCT p_brand), 0 FROM part""")
def run_eda(spark, d):
    p = table(spark, d, "part").select(
        F.col("p_size").alias("struct__p_size"), F.col("p_brand").alias("struct__p_brand"), F.length("p_name").alias("text__len"))
    return explore.run_eda(p, exclude_prefixes=["text__"])["overview"].select("column", "unique", "missing")
