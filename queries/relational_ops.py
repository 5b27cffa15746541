"""Projection and filter (PF), joins (J1-J6, J10, J11), windows (W), sorting and sets (T, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import LINEITEM_NULLS, LINEITEM_TYPES, ORDERS_DUP, lineitem_nulls, orders_dup, query, table, union_all
from tabloom.functions import scalars as sc
from tabloom.functions import textcols as tx
from tabloom.functions.columns import column_families
from tabloom.operators import convert, image, profile
from tabloom.operators import relational as rel
from tabloom.operators.ranking import hash_rank

FAMILY = {"bigint": "numeric", "int": "numeric", "double": "numeric", "string": "categorical", "timestamp_ntz": "datetime"}


@query("pf1_column_families", union_all([
    f"""SELECT {i}::INT AS position, '{c}' AS "column", '{FAMILY[t]}' AS family, count({c}) AS non_null FROM lineitem"""
    for i, (c, t) in enumerate(LINEITEM_TYPES.items())]))
def families(spark, d):
    li = table(spark, d, "lineitem")
    return column_families(li).join(profile.column_types(li).select("column", "non_null"), "column")


@query("pf2_drop_columns", "SELECT c_custkey, c_name FROM customer")
def drop_columns(spark, d):
    return rel.drop_columns(table(spark, d, "customer"), ["c_nationkey", "c_acctbal", "c_mktsegment"])


@query("pf3_rename_columns", "SELECT s_suppkey AS supplier_id, s_name AS supplier, s_nationkey, s_acctbal FROM supplier")
def rename(spark, d):
    return rel.rename_columns(table(spark, d, "supplier"), {"s_suppkey": "supplier_id", "s_name": "supplier"})


@query("pf4_search_regex", r"""SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE
regexp_matches(o_orderkey::VARCHAR, '(?i)urg|^1.*9$') OR regexp_matches(o_orderstatus, '(?i)urg|^1.*9$')
OR regexp_matches(o_orderpriority, '(?i)urg|^1.*9$')""")
def search(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return rel.search_text(o, "urg|^1.*9$")


@query("pf5_search_literal", """SELECT p_partkey, p_name, p_type FROM part
WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_partkey::VARCHAR), 'ring')""")
def literal(spark, d):
    return rel.search_literal(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), "RING")


@query("pf6_numeric_filter_ne", f"WITH {LINEITEM_NULLS} SELECT l_orderkey, l_quantity FROM lineitem_nulls WHERE l_quantity <> 5 OR l_quantity IS NULL")
def numeric_ne(spark, d):
    return rel.filter_numeric(lineitem_nulls(spark, d), "l_quantity", "!=", 5.0).select("l_orderkey", "l_quantity")


@query("pf6_numeric_filter_ge", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_extendedprice >= 50000")
def numeric_ge(spark, d):
    return rel.filter_numeric(table(spark, d, "lineitem"), "l_extendedprice", ">=", 50000.0).select("l_orderkey", "l_partkey", "l_extendedprice")


@query("pf7_delete_by_key", """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def delete_by_key(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.delete_by_key(table(spark, d, "customer"), urgent, ["c_custkey"]).select("c_custkey", "c_name")


@query("pf8_null_rows", f"WITH {LINEITEM_NULLS} SELECT l_orderkey, l_linenumber FROM lineitem_nulls WHERE l_returnflag IS NULL")
def null_rows(spark, d):
    return rel.null_rows(lineitem_nulls(spark, d), "l_returnflag", ["l_orderkey", "l_linenumber"])


TYPED = "typed AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE round(value, 2)::VARCHAR END AS v, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events)"


def typed_text(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id", F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.round("value", 2).cast("string")).alias("v"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"),
    )


@query("pf9_convert_dtypes", f"""WITH {TYPED} SELECT event_id::VARCHAR AS event_id, TRY_CAST(v AS DOUBLE) AS v,
strftime(TRY_CAST(t AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS t FROM typed""")
def convert_types(spark, d):
    out = convert.convert_dtypes(typed_text(spark, d), ["v"], "numeric_float")
    out = convert.convert_dtypes(out, ["t"], "datetime")
    out = convert.convert_dtypes(out, ["event_id"], "string")
    return out.withColumn("t", F.date_format("t", "yyyy-MM-dd HH:mm:ss"))


@query("pf9_convert_int_bool", """SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT END AS p_retailprice,
p_size <> 0 AS p_size FROM part""")
def convert_int(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    return convert.convert_dtypes(convert.convert_dtypes(p, ["p_retailprice"], "numeric_int"), ["p_size"], "boolean")


@query("pf9_conversion_failures", f"""WITH {TYPED} SELECT v AS value, count(*) AS "count" FROM typed WHERE v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL GROUP BY 1""")
def convert_failures(spark, d):
    return convert.conversion_failures(typed_text(spark, d), "v", "numeric_float")


@query("pf10_by_prefix", "SELECT c_custkey, c_custkey AS struct__c_custkey, c_acctbal AS struct__c_acctbal FROM customer")
def prefix(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    t = table(spark, d, "customer").select("c_custkey", F.length("c_name").alias("len"))
    return rel.by_prefix(rel.build_combined(c, "c_custkey", text=t), ["struct__"], keep=["c_custkey"])


@query("pf11_row_id", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def row_id(spark, d):
    return rel.add_row_id(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("pf12_melt", f"""WITH {LINEITEM_NULLS}, k AS (SELECT l_orderkey, l_quantity, l_tax FROM lineitem_nulls
WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL)
SELECT l_orderkey, 'l_quantity' AS variable, l_quantity AS value FROM k UNION ALL SELECT l_orderkey, 'l_tax', l_tax FROM k""")
def melt(spark, d):
    return rel.melt(lineitem_nulls(spark, d), ["l_orderkey"], ["l_quantity", "l_tax"])


@query("j1_merge_inner_chain", """SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""")
def merge_chain(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "nationkey")
    n = table(spark, d, "nation").withColumnsRenamed({"n_nationkey": "nationkey", "n_regionkey": "regionkey"})
    r = table(spark, d, "region").withColumnRenamed("r_regionkey", "regionkey")
    return rel.merge_all([c, n, r], [["nationkey"], ["regionkey"]]).select("c_custkey", "n_name", "r_name")


@query("j1_merge_outer_null_keys", f"""WITH {LINEITEM_NULLS}, l AS (SELECT DISTINCT l_returnflag AS k, 1::BIGINT AS v FROM lineitem_nulls),
r AS (SELECT CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS k, count(*) AS v FROM lineitem_nulls GROUP BY 1)
SELECT coalesce(l.k, r.k) AS k, l.v AS v_x, r.v AS v_y FROM l FULL JOIN r ON l.k IS NOT DISTINCT FROM r.k""")
def merge_outer(spark, d):
    li = lineitem_nulls(spark, d)
    left = li.select(F.col("l_returnflag").alias("k")).distinct().withColumn("v", F.lit(1).cast("bigint"))
    right = li.groupBy(F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return rel.merge(left, right, ["k"], "outer")


@query("j1_merge_left", """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def merge_left(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return rel.merge(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], "left")


@query("j1_merge_right", """SELECT n_nationkey, n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey""")
def merge_right(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return rel.merge(s, table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], "right")


@query("j2_common_columns", """SELECT 'doc_id' AS "column", count(DISTINCT doc_id) AS shared FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def common(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    keys = rel.common_columns(docs, labels)
    return docs.join(labels, keys, "left_semi").agg(F.count_distinct(*keys).alias("shared")).withColumn("column", F.lit(",".join(keys)))


@query("j3_match_records", """SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS matched FROM documents""")
def match(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    matched, unmatched = rel.match_records(docs, table(spark, d, "labels"), "doc_id", "doc_id")
    return matched.withColumn("matched", F.lit(True)).unionByName(unmatched.withColumn("matched", F.lit(False)))


@query("j4_build_combined", """SELECT d.doc_id, d.doc_id AS struct__doc_id, d.lang AS struct__lang, length(d.text) AS text__chars, l.quality AS img__quality
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def combined(spark, d):
    docs = table(spark, d, "documents")
    text = docs.select("doc_id", F.length("text").cast("bigint").alias("chars"))
    return rel.build_combined(docs.select("doc_id", "lang"), "doc_id", text, table(spark, d, "labels").select("doc_id", "quality"))


@query("j5_missing_files", "SELECT count(*) AS missing_files FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_files(spark, d):
    return rel.missing_files(table(spark, d, "documents"), "doc_id", table(spark, d, "labels"), "doc_id")


@query("j10_map_labels", """SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code, c_mktsegment AS segment FROM customer""")
def map_labels(spark, d):
    c = table(spark, d, "customer")
    mapping = rel.label_codes(c, "c_mktsegment")
    encoded = c.join(mapping, c.c_mktsegment == mapping.label).select("c_custkey", "code")
    return rel.map_labels(encoded, "code", mapping, out="segment")


@query("j11_attach", """SELECT o_orderkey, max(l_quantity) AS peak, any_value(o_orderstatus) AS o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def attach(spark, d):
    res = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("peak"))
    return rel.attach(res, table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").where("o_orderstatus is not null")


def _dedupe_sql(keep):
    pick = {"first": "rn = 1", "last": "rl = 1", "none": "n = 1"}[keep]
    return f"""SELECT o_orderkey, o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn,
row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS rl,
count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders) WHERE {pick}"""


def _register_dedupe():
    for label, keep in (("first", "first"), ("last", "last"), ("none", False)):
        def run(spark, d, keep=keep):
            o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
            return rel.remove_duplicates(o, ["o_custkey", "o_orderpriority"], ["o_orderkey"], keep)
        query(f"w1_remove_duplicates_{label}", _dedupe_sql(label))(run)


_register_dedupe()


@query("w1_remove_duplicates_whole_row", f"WITH {ORDERS_DUP} SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders_dup")
def dedupe_rows(spark, d):
    o = orders_dup(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return rel.remove_duplicates(o, o.columns, ["o_orderkey"], "first")


@query("w2_label_codes", f"""WITH {LINEITEM_NULLS} SELECT label, row_number() OVER (ORDER BY label) - 1 AS code
FROM (SELECT DISTINCT coalesce(l_returnflag, 'nan') AS label FROM lineitem_nulls)""")
def label_codes(spark, d):
    return rel.label_codes(lineitem_nulls(spark, d), "l_returnflag")


@query("w3_number_records", """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS record FROM conversations""")
def number_records(spark, d):
    return rel.number_records(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("w4_running_total", """SELECT day, n, sum(n) OVER (ORDER BY day)::BIGINT AS cumulative FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1)""")
def running(spark, d):
    days = profile.daily_count(table(spark, d, "events"), "ts").select(F.col("day").cast("string").alias("day"), F.col("count").alias("n"))
    return rel.running_total(days, "day", "n")


@query("w5_best_per_group", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def best(spark, d):
    return rel.best_per_group(table(spark, d, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"], "o_orderkey")


@query("t1_sort_missing_last", f"WITH {LINEITEM_NULLS} SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem_nulls")
def sort_rows(spark, d):
    return rel.sort_rows(lineitem_nulls(spark, d), "l_quantity", False).select("l_orderkey", "l_linenumber", "l_quantity")


@query("t2_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def head(spark, d):
    return rel.head(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, ["o_orderkey"])


@query("t3_top_k", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 25")
def top_k(spark, d):
    return rel.top_k(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_acctbal", "c_name", 25)


@query("t3_top_k_per_group", """SELECT c_mktsegment, c_name, c_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_name)::INT AS rank FROM customer) WHERE rank <= 5""")
def top_per_group(spark, d):
    return rel.top_k_per_group(table(spark, d, "customer").select("c_mktsegment", "c_name", "c_acctbal"), "c_mktsegment", "c_acctbal", "c_name", 5)


PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query("t4_sort_by_category", """SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY o_orderpriority DESC)::INT AS place FROM orders GROUP BY 1""")
def by_category(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return rel.sort_by_category(g.withColumn("place", (rel.category_rank("o_orderpriority", PRIORITIES) + 1).cast("int")), "o_orderpriority", PRIORITIES)


@query("t5_capped_results", """SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100""")
def capped(spark, d):
    return rel.head(table(spark, d, "documents").select("doc_id", "n_chars"), 100, [F.desc("n_chars"), "doc_id"])


@query("u1_append", """SELECT doc_id AS id, text, NULL AS role FROM documents UNION ALL SELECT conv_id, text, role FROM conversations""")
def append(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return rel.append(docs, table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "text", "role"))


@query("u2_removed_names", "SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def removed(spark, d):
    return rel.removed_names(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("u3_distinct_values", "SELECT DISTINCT p_brand FROM part")
def distinct(spark, d):
    return rel.distinct_values(table(spark, d, "part"), "p_brand")


@query("w6_token_windows", r"""WITH t AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}]+'), lambda w: w <> '') AS w FROM documents))
SELECT doc_id, (i - 1)::INT AS position, gram FROM (SELECT doc_id, i, t || ' ' || lead(t, 1) OVER w || ' ' || lead(t, 2) OVER w AS gram FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE gram IS NOT NULL""")
def token_windows(spark, d):
    grams = tx.ngrams(sc.words(F.lower("text")), 3)
    return table(spark, d, "documents").select("doc_id", F.posexplode(grams).alias("position", "gram"))


@query("w7_neighbour_pairs", """SELECT vec_id AS image_id, y, x, v, lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) AS right_v FROM (
SELECT vec_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, greatest(0, least(255, floor((embedding[i]::DOUBLE + 0.6) * 220)))::INT AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))""")
def neighbour_pairs(spark, d):
    from queries.image_ops import pixels

    return image.horizontal_pairs(image.channel(pixels(spark, d), "r"))


@query("w8_hash_ranks", """SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR || '-7'), o_orderkey) - 1 AS rank FROM orders""")
def hash_ranks(spark, d):
    return hash_rank(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 7, "o_orderpriority")
