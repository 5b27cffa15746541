"""Fitted cleaning (C1-C16) and the outlier preview (PF13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import CUSTOMER_NEG, LINEITEM_NULLS, customer_neg, lineitem_nulls, query, table, union_all
from tabloom.operators import clean

KEY = "l_orderkey, l_linenumber, l_partkey"


@query("c1_fill_drop_rows", f"WITH {LINEITEM_NULLS} SELECT {KEY}, l_quantity, l_returnflag FROM lineitem_nulls WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL")
def drop_rows(spark, d):
    return clean.fill_missing(lineitem_nulls(spark, d), ["l_quantity", "l_returnflag"], "drop_rows").select(*KEY.split(", "), "l_quantity", "l_returnflag")


def _numeric_fill(name, agg):
    sql = f"WITH {LINEITEM_NULLS}, s AS (SELECT {agg}(l_quantity) AS q, {agg}(l_tax) AS t FROM lineitem_nulls) " \
          f"SELECT {KEY}, round(coalesce(l_quantity, q), 6) AS l_quantity, round(coalesce(l_tax, t), 6) AS l_tax FROM lineitem_nulls, s"

    def run(spark, d):
        out = clean.fill_missing(lineitem_nulls(spark, d), ["l_quantity", "l_tax"], name)
        return out.select(*KEY.split(", "), F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax"))

    query(f"c1_fill_{name}", sql)(run)


_numeric_fill("mean", "avg")
_numeric_fill("median", "median")


def mode_sql(c, source="lineitem_nulls"):
    return f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("c1_fill_mode", f"""WITH {LINEITEM_NULLS} SELECT {KEY}, coalesce(l_quantity, {mode_sql('l_quantity')}) AS l_quantity,
coalesce(l_returnflag, {mode_sql('l_returnflag')}) AS l_returnflag FROM lineitem_nulls""")
def fill_mode(spark, d):
    return clean.fill_missing(lineitem_nulls(spark, d), ["l_quantity", "l_returnflag"], "mode").select(*KEY.split(", "), "l_quantity", "l_returnflag")


@query("c1_fill_custom", f"WITH {LINEITEM_NULLS} SELECT {KEY}, coalesce(l_returnflag, 'Z') AS l_returnflag FROM lineitem_nulls")
def fill_custom(spark, d):
    return clean.fill_missing(lineitem_nulls(spark, d), ["l_returnflag"], "custom", "Z").select(*KEY.split(", "), "l_returnflag")


@query("c1_drop_columns", f"WITH {LINEITEM_NULLS} SELECT l_orderkey, l_partkey, l_discount FROM lineitem_nulls")
def fill_drop_columns(spark, d):
    li = lineitem_nulls(spark, d).select("l_orderkey", "l_partkey", "l_discount", "l_tax")
    return clean.fill_missing(li, ["l_tax"], "drop_columns")


@query("c2_fill_selected_rows", f"""WITH {LINEITEM_NULLS} SELECT {KEY}, CASE WHEN l_quantity IS NULL AND l_orderkey IN
(SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN (SELECT median(l_quantity) FROM lineitem_nulls) ELSE l_quantity END AS l_quantity FROM lineitem_nulls""")
def selected_rows(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    out = clean.fill_selected_rows(lineitem_nulls(spark, d), "l_quantity", "l_orderkey", urgent, "median")
    return out.select(*KEY.split(", "), "l_quantity")


MISSING_DECISION = [("l_quantity", "median"), ("l_tax", "median"), ("l_returnflag", "mode")]
C3_SQL = union_all([f"""SELECT '{c}' AS "column", CASE WHEN m > 0.55 THEN 'drop_column' ELSE 'fill' END AS action,
CASE WHEN m <= 0.55 THEN '{s}' END AS strategy, '{c}: ' || printf('%.1f', m * 100) || '% missing' ||
CASE WHEN m > 0.55 THEN ' exceeds 55%, column dropped' ELSE ', filled with the {s}' END AS description
FROM (SELECT (count(*) - count({c}))::DOUBLE / count(*) AS m FROM lineitem_nulls) WHERE m > 0""" for c, s in MISSING_DECISION])


@query("c3_decide_missing", f"WITH {LINEITEM_NULLS} {C3_SQL}")
def decide_missing(spark, d):
    return clean.decision_rows(spark, clean.decide_missing(lineitem_nulls(spark, d)))


@query("c4_apply_missing", f"""WITH {LINEITEM_NULLS} SELECT {KEY}, coalesce(l_quantity, (SELECT median(l_quantity) FROM lineitem_nulls)) AS l_quantity,
coalesce(l_returnflag, {mode_sql('l_returnflag')}) AS l_returnflag, l_discount FROM lineitem_nulls""")
def apply_missing(spark, d):
    out = clean.apply_missing(lineitem_nulls(spark, d)).df
    assert "l_tax" not in out.columns
    return out.select(*KEY.split(", "), "l_quantity", "l_returnflag", "l_discount")


def bounds_sql(c, method, source):
    if method == "zscore":
        return f"SELECT avg({c}) - 3 * stddev_samp({c}) AS lo, avg({c}) + 3 * stddev_samp({c}) AS hi FROM {source}"
    if method == "percentile":
        return f"SELECT quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.99) AS hi FROM {source}"
    return f"SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source})"


def _outliers(method):
    sql = f"""WITH {LINEITEM_NULLS}, a AS ({bounds_sql('l_extendedprice', method, 'lineitem_nulls')}), b AS ({bounds_sql('l_quantity', method, 'lineitem_nulls')})
SELECT {KEY}, l_extendedprice, coalesce(l_extendedprice < a.lo OR l_extendedprice > a.hi, false) OR coalesce(l_quantity < b.lo OR l_quantity > b.hi, false) AS is_outlier
FROM lineitem_nulls, a, b"""

    def run(spark, d):
        out, _ = clean.detect_outliers(lineitem_nulls(spark, d), ["l_extendedprice", "l_quantity"], method)
        return out.select(*KEY.split(", "), "l_extendedprice", "is_outlier")

    query(f"c5_detect_outliers_{method}", sql)(run)


for _m in ("zscore", "iqr", "percentile"):
    _outliers(_m)


@query("c6_outlier_cap", f"""WITH a AS ({bounds_sql('l_extendedprice', 'percentile', 'lineitem')})
SELECT {KEY}, round(least(greatest(l_extendedprice, lo), hi), 4) AS l_extendedprice FROM lineitem, a""")
def outlier_cap(spark, d):
    out = clean.outlier_action(table(spark, d, "lineitem"), ["l_extendedprice"], "percentile", "cap")
    return out.select(*KEY.split(", "), F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query("c6_outlier_remove", f"""WITH a AS ({bounds_sql('l_extendedprice', 'percentile', 'lineitem')})
SELECT {KEY}, l_extendedprice FROM lineitem, a WHERE l_extendedprice BETWEEN lo AND hi""")
def outlier_remove(spark, d):
    return clean.outlier_action(table(spark, d, "lineitem"), ["l_extendedprice"], "percentile", "remove").select(*KEY.split(", "), "l_extendedprice")


@query("pf13_outlier_preview", f"""WITH a AS ({bounds_sql('l_extendedprice', 'percentile', 'lineitem')})
SELECT {KEY}, l_extendedprice FROM lineitem, a WHERE l_extendedprice < lo OR l_extendedprice > hi ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice LIMIT 200""")
def preview(spark, d):
    return clean.outlier_preview(table(spark, d, "lineitem"), ["l_extendedprice"], KEY.split(", "), "percentile")


def _outlier_decisions(spark, decisions):
    return spark.createDataFrame([(x["column"], x["action"], x["n"]) for x in decisions], "column string, action string, n bigint")


def _c7_sql(cols, source, hinted):
    parts = []
    for c in cols:
        neg = f"(SELECT count(*) FROM {source} WHERE {c} < 0)" if c in hinted else "0"
        parts.append(f"""SELECT * FROM (SELECT '{c}' AS "column", CASE WHEN {neg} > 0 THEN 'cap_impossible' ELSE 'flag_only' END AS action,
CASE WHEN {neg} > 0 THEN {neg} ELSE (SELECT count(*) FROM {source}, ({bounds_sql(c, 'iqr', source)}) b WHERE {c} < lo OR {c} > hi) END AS n) WHERE n > 0""")
    return union_all(parts)


@query("c7_decide_outliers", f"WITH {CUSTOMER_NEG} {_c7_sql(['c_custkey', 'c_nationkey', 'account_amount'], 'customer_neg', ['account_amount'])}")
def decide_outliers(spark, d):
    return _outlier_decisions(spark, clean.decide_outliers(customer_neg(spark, d)))


@query("c7_decide_outliers_flag", _c7_sql(["event_id", "user_id", "value"], "events", []))
def decide_flags(spark, d):
    return _outlier_decisions(spark, clean.decide_outliers(table(spark, d, "events")))


@query("c8_apply_outliers", f"WITH {CUSTOMER_NEG} SELECT c_custkey, greatest(account_amount, 0) AS account_amount FROM customer_neg")
def apply_outliers(spark, d):
    return clean.apply_outliers(customer_neg(spark, d)).df.select("c_custkey", "account_amount")


@query("c9_label_encode", f"""WITH {LINEITEM_NULLS} SELECT {KEY}, dense_rank() OVER (ORDER BY coalesce(l_returnflag, 'nan')) - 1 AS l_returnflag_enc FROM lineitem_nulls""")
def label_encode(spark, d):
    return clean.label_encode(lineitem_nulls(spark, d), "l_returnflag")[0].select(*KEY.split(", "), "l_returnflag_enc")


@query("c10_one_hot", f"""WITH {LINEITEM_NULLS} SELECT {KEY}, coalesce(l_returnflag = 'N', false) AS "l_returnflag_N", coalesce(l_returnflag = 'R', false) AS "l_returnflag_R" FROM lineitem_nulls""")
def one_hot(spark, d):
    return clean.one_hot(lineitem_nulls(spark, d).select(*KEY.split(", "), "l_returnflag"), ["l_returnflag"]).drop("l_returnflag")


SCALE = {
    "standard": ("avg({c})", "stddev_pop({c})"),
    "minmax": ("min({c})", "(max({c}) - min({c}))"),
    "robust": ("median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"),
}


def _scale(method):
    a, b = SCALE[method]
    cols = ("l_quantity", "l_extendedprice")
    params = ", ".join(f"{a.format(c=c)} AS a_{c}, {b.format(c=c)} AS b_{c}" for c in cols)
    out = ", ".join(f"round(({c} - a_{c}) / b_{c}, 6) AS {c}" for c in cols)

    def run(spark, d):
        scaled, _ = clean.scale_columns(lineitem_nulls(spark, d), list(cols), method)
        return scaled.select(*KEY.split(", "), *[F.round(c, 6).alias(c) for c in cols])

    query(f"c11_scale_{method}", f"WITH {LINEITEM_NULLS}, p AS (SELECT {params} FROM lineitem_nulls) SELECT {KEY}, {out} FROM lineitem_nulls, p")(run)


for _m in SCALE:
    _scale(_m)


@query("c12_decide_scaling", f"""WITH {CUSTOMER_NEG} SELECT algorithm, CASE WHEN algorithm = 'Random Forest' THEN 'none' WHEN heavy > 0 THEN 'robust' ELSE 'standard' END AS method
FROM (SELECT unnest(['Random Forest', 'ridge', 'knn']) AS algorithm),
(SELECT count(*) AS heavy FROM ({_c7_sql(['c_custkey', 'c_nationkey', 'account_amount'], 'customer_neg', ['account_amount'])}) WHERE action = 'flag_only'
AND n > greatest(3, 0.05 * (SELECT count(*) FROM customer_neg)))""")
def decide_scaling(spark, d):
    c = customer_neg(spark, d)
    rows = [(a, clean.decide_scaling(c, a)["method"] or "none") for a in ("Random Forest", "ridge", "knn")]
    return spark.createDataFrame(rows, "algorithm string, method string")


@query("c13_apply_scaling", f"""WITH {CUSTOMER_NEG}, p AS (SELECT avg(account_amount) AS a, stddev_pop(account_amount) AS b FROM customer_neg)
SELECT c_custkey, round((account_amount - a) / b, 6) AS account_amount FROM customer_neg, p""")
def apply_scaling(spark, d):
    out = clean.apply_scaling(customer_neg(spark, d), "ridge", ["account_amount"]).df
    return out.select("c_custkey", F.round("account_amount", 6).alias("account_amount"))


C14_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
C14_SQL = f"""{LINEITEM_NULLS}, f AS (SELECT * REPLACE (coalesce(l_quantity, (SELECT median(l_quantity) FROM lineitem_nulls)) AS l_quantity,
coalesce(l_returnflag, {mode_sql('l_returnflag')}) AS l_returnflag) FROM lineitem_nulls),
p AS (SELECT {", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS b_{c}" for c in C14_COLS)} FROM f),
c14 AS (SELECT {KEY}, l_returnflag, {", ".join(f"round(({c} - a_{c}) / b_{c}, 6) AS {c}" for c in C14_COLS)} FROM f, p)"""
IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("c14_auto_preprocess", f"WITH {C14_SQL} SELECT * FROM c14")
def auto_preprocess(spark, d):
    out = clean.auto_preprocess(lineitem_nulls(spark, d), "linear_regression", exclude=IDS).df
    return out.select(*KEY.split(", "), "l_returnflag", *[F.round(c, 6).alias(c) for c in C14_COLS])


@query("c14_auto_preprocess_log", f"""WITH {LINEITEM_NULLS} SELECT row_number() OVER (ORDER BY o)::INT - 1 AS step, "column", action FROM (
SELECT 0 AS o, 'l_quantity' AS "column", 'fill' AS action UNION ALL SELECT 1, 'l_tax', 'drop_column' UNION ALL SELECT 2, 'l_returnflag', 'fill'
UNION ALL SELECT 3, "column", action FROM (SELECT "column", action FROM ({_c7_sql(['l_extendedprice', 'l_discount'], 'lineitem', [])}))
UNION ALL SELECT 9, NULL, 'standard')""")
def auto_log(spark, d):
    out = clean.auto_preprocess(lineitem_nulls(spark, d), "linear_regression", exclude=IDS)
    return clean.log_rows(spark, out).select("step", "column", "action")


@query("c16_scale_for_clustering", f"""WITH {LINEITEM_NULLS}, f AS (SELECT {KEY}, coalesce(l_quantity, avg(l_quantity) OVER ()) AS l_quantity FROM lineitem_nulls)
SELECT {KEY}, round((l_quantity - (SELECT avg(l_quantity) FROM f)) / (SELECT stddev_pop(l_quantity) FROM f), 6) AS l_quantity FROM f""")
def scale_for_clustering(spark, d):
    out, _ = clean.scale_for_clustering(lineitem_nulls(spark, d), ["l_quantity"], "mean")
    return out.select(*KEY.split(", "), F.round("l_quantity", 6).alias("l_quantity"))


@query("c16_scale_for_clustering_zero", f"""WITH {LINEITEM_NULLS}, f AS (SELECT {KEY}, coalesce(l_quantity, 0) AS l_quantity FROM lineitem_nulls)
SELECT {KEY}, round((l_quantity - (SELECT avg(l_quantity) FROM f)) / (SELECT stddev_pop(l_quantity) FROM f), 6) AS l_quantity FROM f""")
def scale_zero(spark, d):
    out, _ = clean.scale_for_clustering(lineitem_nulls(spark, d), ["l_quantity"], "zero")
    return out.select(*KEY.split(", "), F.round("l_quantity", 6).alias("l_quantity"))
