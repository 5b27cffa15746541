"""Scalar functions (F1-F16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import query, table, union_all
from tabloom.functions import columns as cn
from tabloom.functions import scalars as sc

SP = r"[\s\p{Z}]"


@query("f1_change_case", r"""SELECT p_partkey, lower(p_name) AS low, upper(p_name) AS up,
list_aggregate(list_transform(regexp_extract_all(p_name || '''s ' || p_brand, '(\p{L}+|\P{L}+)'), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '') AS title FROM part""")
def change_case(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", sc.change_case("p_name", "lower").alias("low"), sc.change_case("p_name", "upper").alias("up"),
        sc.change_case(F.concat("p_name", F.lit("'s "), "p_brand"), "title").alias("title"))


@query("f2_collapse_whitespace", rf"""SELECT doc_id, md5(trim(regexp_replace(text, '{SP}+', ' ', 'g'))) AS squeezed FROM documents""")
def squeeze(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(sc.collapse_whitespace("text")).alias("squeezed"))


@query("f3_regex_replace", r"""SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS bare FROM pages""")
def regex(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(sc.regex_replace("html", "<[^>]+>", " ")).alias("bare"))


@query("f4_word_char_count", rf"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{SP}+'), lambda w: w <> ''))::INT AS words, length(text)::INT AS chars FROM documents""")
def counts(spark, d):
    return table(spark, d, "documents").select("doc_id", sc.word_count("text").alias("words"), sc.char_count("text").alias("chars"))


@query("f5_preview", "SELECT doc_id, substr(text, 1, 80) AS p80, substr(text, 1, 300) AS p300 FROM documents")
def preview(spark, d):
    return table(spark, d, "documents").select("doc_id", sc.preview("text", 80).alias("p80"), sc.preview("text", 300).alias("p300"))


DATE_TEXT = "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS t FROM orders"


@query("f6_reformat_date", f"SELECT o_orderkey, strftime(try_strptime(t, '%d/%m/%Y'), '%Y-%m-%d') AS iso, t IS NOT NULL AND try_strptime(t, '%d/%m/%Y') IS NULL AS failed FROM ({DATE_TEXT})")
def reformat(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "unknown").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("t"))
    iso = sc.reformat_date("t", "%d/%m/%Y", "%Y-%m-%d")
    return o.select("o_orderkey", iso.alias("iso"), iso.isNull().alias("failed"))


@query("f7_quantize", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
CASE WHEN abs(v * 10 - floor(v * 10)) = 0.5 THEN (CASE WHEN floor(v * 10)::BIGINT % 2 = 0 THEN floor(v * 10) ELSE floor(v * 10) + 1 END / 10)::DECIMAL(38,1) ELSE round(v, 1)::DECIMAL(38,1) END::VARCHAR AS q
FROM (SELECT *, l_extendedprice::DECIMAL(18,2) AS v FROM lineitem)""")
def quantize(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                     sc.quantize(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), 1).alias("q"))


@query("f8_clip", "SELECT l_orderkey, l_partkey, least(greatest(l_quantity, 5), 45) AS q, greatest(l_discount, 0.03) AS dis FROM lineitem")
def clip(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", sc.clip("l_quantity", 5.0, 45.0).alias("q"), sc.clip("l_discount", 0.03).alias("dis"))


@query("f9_math", """SELECT event_id, round(ln(1 + abs(value)), 6) AS l, round(sqrt(abs(value)), 6) AS s, round(CASE WHEN value = 0 THEN 0 ELSE -sign(value) * log10(abs(value)) END, 6) AS g FROM events""")
def math(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.round(F.log1p(F.abs("value")), 6).alias("l"), F.round(F.sqrt(F.abs("value")), 6).alias("s"),
        F.round(sc.signed_log10("value"), 6).alias("g"))


@query("f10_name_hints", union_all([
    f"SELECT '{c}' AS \"column\", {i}::BOOLEAN AS identifier, {n}::BOOLEAN AS non_negative, count({c}) AS values FROM lineitem"
    for c, i, n in [("l_orderkey", True, False), ("l_quantity", False, True), ("l_extendedprice", False, True), ("l_tax", False, False), ("l_linenumber", False, False)]]))
def hints(spark, d):
    li = table(spark, d, "lineitem")
    cols = ["l_orderkey", "l_quantity", "l_extendedprice", "l_tax", "l_linenumber"]
    rows = [F.struct(F.lit(c).alias("column"), F.lit(cn.hints_identifier(c)).alias("identifier"), F.lit(cn.hints_non_negative(c)).alias("non_negative"), F.col(f"n_{c}").alias("values")) for c in cols]
    return li.agg(*[F.count(c).alias(f"n_{c}") for c in cols]).select(F.inline(F.array(*rows)))


@query("f11_content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def digest(spark, d):
    return table(spark, d, "documents").select("doc_id", sc.content_digest("text").alias("digest"))


@query("f12_table_signature")
def signature(spark, d):
    return sc.table_signature(table(spark, d, "orders"))


@query("f13_path_helpers", r"""SELECT conv_id, turn, regexp_replace('{http://x}' || role, '^.*\}', '') AS local,
'/conversation[' || (conv_id + 1) || ']/' || role || '[' || (turn + 1) || ']' AS path FROM conversations""")
def paths(spark, d):
    c = table(spark, d, "conversations")
    tag = F.concat(F.lit("{http://x}"), "role")
    parent = F.concat(F.lit("/conversation["), F.col("conv_id") + 1, F.lit("]"))
    return c.select("conv_id", "turn", sc.local_name(tag).alias("local"), sc.child_path(parent, tag, F.col("turn") + 1).alias("path"))


@query("f14_hex_colour", "SELECT p_partkey, printf('#%02x%02x%02x', p_size, p_partkey % 256, (p_partkey * 7) % 256) AS colour FROM part")
def colour(spark, d):
    return table(spark, d, "part").select("p_partkey", sc.hex_colour("p_size", F.col("p_partkey") % 256, (F.col("p_partkey") * 7) % 256).alias("colour"))


@query("f15_array_ops", rf"""SELECT doc_id, array_to_string(w[2:4], '|') AS part, coalesce(list_position(w, 'the'), 0)::BIGINT AS pos FROM
(SELECT doc_id, list_filter(regexp_split_to_array(text, '{SP}+'), lambda x: x <> '') AS w FROM documents)""")
def arrays(spark, d):
    w = sc.words("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(w, 2, 3), "|").alias("part"), F.array_position(w, "the").alias("pos"))


@query("f16_map_lookup", "SELECT event_id, (props->>'$.k')::VARCHAR AS k, NULL AS absent FROM events")
def lookup(spark, d):
    attrs = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", sc.map_lookup(attrs, "k").alias("k"), sc.map_lookup(attrs, "zz").alias("absent"))
