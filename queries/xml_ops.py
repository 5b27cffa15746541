"""XML (XM1-XM14, IO8, IO9, J6): documents are built from every order and its line items."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from queries.base import query, table
from tabloom.operators import xml
from tabloom.sources import files, xmldocs


def xml_documents(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("int").alias("qty"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("ship"), "l_returnflag", "l_linestatus"))).alias("items"))
    item = F.transform("items", lambda s, i: F.concat(
        F.lit('<item no="'), (i + 1).cast("string"), F.lit('" flag="'), s["l_returnflag"], F.lit('"><qty>'), s["qty"].cast("string"), F.lit("</qty><ship>"), s["ship"],
        F.lit("</ship><price>"), F.format_string("%.2f", s["l_extendedprice"]), F.lit("</price><memo/></item>")))
    status = F.transform("items", lambda s: F.concat(F.lit("<status>"), s["l_linestatus"], F.lit("</status>")))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.concat(
        F.lit('<order id="'), F.col("o_orderkey").cast("string"), F.lit('" state="'), "o_orderstatus", F.lit('"><priority>  '), "o_orderpriority",
        F.lit("  </priority>"), F.array_join(item, ""), F.array_join(status, ""), F.lit("</order>")).alias("xml"))


def parsed(spark, d, content=True):
    return xmldocs.parse_and_store(xml_documents(spark, d), content=content)


IT = """it AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i,
l_quantity::INT::VARCHAR AS qty, strftime(l_shipdate, '%d/%m/%Y') AS ship, printf('%.2f', l_extendedprice) AS price, l_returnflag AS flag, l_linestatus AS st,
l_extendedprice AS raw_price, l_shipdate AS raw_ship FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
EL = IT + """, el AS (
SELECT o_orderkey AS doc, '/order[1]' AS path, '/' AS parent, 'order' AS tag, 0 AS depth, NULL AS text,
  o_orderpriority || ' ' || (SELECT string_agg(qty || ' ' || ship || ' ' || price, ' ' ORDER BY i) || ' ' || string_agg(st, ' ' ORDER BY i) FROM it WHERE doc = o_orderkey) AS content,
  'id=' || o_orderkey || ',state=' || o_orderstatus AS attrs FROM orders WHERE o_orderkey IN (SELECT doc FROM it)
UNION ALL SELECT o_orderkey, '/order[1]/priority[1]', '/order[1]', 'priority', 1, '  ' || o_orderpriority || '  ', o_orderpriority, '' FROM orders WHERE o_orderkey IN (SELECT doc FROM it)
UNION ALL SELECT doc, '/order[1]/item[' || i || ']', '/order[1]', 'item', 1, NULL, qty || ' ' || ship || ' ' || price, 'flag=' || flag || ',no=' || i FROM it
UNION ALL SELECT doc, '/order[1]/item[' || i || ']/qty[1]', '/order[1]/item[' || i || ']', 'qty', 2, qty, qty, '' FROM it
UNION ALL SELECT doc, '/order[1]/item[' || i || ']/ship[1]', '/order[1]/item[' || i || ']', 'ship', 2, ship, ship, '' FROM it
UNION ALL SELECT doc, '/order[1]/item[' || i || ']/price[1]', '/order[1]/item[' || i || ']', 'price', 2, price, price, '' FROM it
UNION ALL SELECT doc, '/order[1]/item[' || i || ']/memo[1]', '/order[1]/item[' || i || ']', 'memo', 2, NULL, '', '' FROM it
UNION ALL SELECT doc, '/order[1]/status[' || i || ']', '/order[1]', 'status', 1, st, st, '' FROM it)"""


def attrs():
    return F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("attrs")


def show(df):
    return df.select(F.col("doc_id").alias("doc"), "path", F.coalesce("text", F.lit("")).alias("text"))


SHOW = "SELECT doc, path, coalesce(text, '') AS text FROM el"


@query("io8_read_xml_documents", f"WITH {IT} SELECT 'orders' AS part, count(DISTINCT doc) AS documents, 0::BIGINT AS errors FROM it UNION ALL SELECT 'pages', 0, count(*) FROM pages")
def read_documents(spark, d):
    """Orders parse; the broken documents (an unclosed wrapper around each page) are kept apart."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("<page><br>"), "url", F.lit("</page>")).alias("xml"))
    out = None
    for part, docs in (("orders", xml_documents(spark, d)), ("pages", pages)):
        rows = xmldocs.parse_elements(docs)
        one = rows.agg(F.count_distinct(F.when(F.col("error").isNull(), F.col("doc_id"))).alias("documents"), F.count("error").alias("errors")).withColumn("part", F.lit(part))
        out = one if out is None else out.unionByName(one)
    return out


@query("io9_read_records", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def read_records(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    path = files.write_xml(s, files.scratch_path(spark, "rows"), "suppliers", "supplier")
    return xmldocs.read_records(spark, path, "supplier", s.schema)


@query("xm1_flatten_elements", f"WITH {EL} SELECT doc, path, parent, tag, depth::INT AS depth, coalesce(text, '') AS text, content, attrs FROM el")
def flatten(spark, d):
    return parsed(spark, d).select(F.col("doc_id").alias("doc"), "path", F.col("parent_path").alias("parent"), "tag", "depth",
                                   F.coalesce("text", F.lit("")).alias("text"), F.col("content_text").alias("content"), attrs())


@query("xm2_find", f"WITH {EL} SELECT doc, path FROM el WHERE tag = 'item' AND attrs LIKE '%flag=R%' AND contains(lower(content), '/07/')")
def find(spark, d):
    return xml.find(parsed(spark, d), "item", "flag", "r", "/07/").select(F.col("doc_id").alias("doc"), "path")


@query("xm3_select_path", f"WITH {EL} SELECT doc, path FROM el WHERE regexp_matches(path, '^/order\\[1\\]/item\\[2\\]')")
def select_path(spark, d):
    return xml.select_path(parsed(spark, d), "item[2]").select(F.col("doc_id").alias("doc"), "path")


@query("xm3_select_descendants", f"WITH {EL} SELECT doc, path, text FROM el WHERE tag = 'qty'")
def select_descendants(spark, d):
    return xml.select_path(parsed(spark, d), ".//qty").select(F.col("doc_id").alias("doc"), "path", "text")


PREDICATES = {
    "attribute": ("item[@flag]/qty", "tag = 'qty'"),
    "attribute_value": ("item[@flag='R']/qty", "tag = 'qty' AND (SELECT flag FROM it WHERE it.doc = el.doc AND el.parent = '/order[1]/item[' || i || ']') = 'R'"),
    "attribute_other": ("item[@flag!='R']", "tag = 'item' AND NOT contains(attrs, 'flag=R')"),
    "child": ("*[memo]", "tag = 'item'"),
    "child_text": ("item[qty='7']/ship", "tag = 'ship' AND (SELECT qty FROM it WHERE it.doc = el.doc AND el.parent = '/order[1]/item[' || i || ']') = '7'"),
    "own_text": ("status[.='O']", "tag = 'status' AND text = 'O'"),
    "last": ("item[last()]/price", "tag = 'price' AND parent = '/order[1]/item[' || (SELECT max(i) FROM it WHERE it.doc = el.doc) || ']'"),
    "last_but_one": ("item[last()-1]", "tag = 'item' AND path = '/order[1]/item[' || (SELECT max(i) - 1 FROM it WHERE it.doc = el.doc) || ']'"),
    "parent": (".//qty/../ship", "tag = 'ship'"),
}


@query("xm3_select_predicates", f"WITH {EL} " + " UNION ALL ".join(f"SELECT '{n}' AS kind, doc, path FROM el WHERE {w}" for n, (_, w) in PREDICATES.items()))
def select_predicates(spark, d):
    e = parsed(spark, d, False)
    found = [xml.match_path(e, p).select(F.lit(n).alias("kind"), F.col("doc_id").alias("doc"), "path") for n, (p, _) in PREDICATES.items()]
    return functools.reduce(lambda a, b: a.unionByName(b), found)


@query("xm3_xpath_values", f"WITH {IT} SELECT doc AS doc_id, (row_number() OVER (PARTITION BY doc ORDER BY i) - 1)::INT AS position, price AS value FROM it WHERE flag = 'R'")
def xpath_values(spark, d):
    return xml.xpath_values(xml_documents(spark, d), "/order/item[@flag='R']/price/text()")


@query("xm4_flatten_records", f"""WITH {IT} SELECT doc AS doc_id, i::INT AS record_number, i::VARCHAR AS "@no", qty, ship FROM it""")
def flatten_records(spark, d):
    return xml.flatten_records(parsed(spark, d), "item", ["@no", "qty", "ship"])


@query("xm4_flatten_records_multi", f"""WITH {IT} SELECT doc AS doc_id, 1::INT AS record_number, doc::VARCHAR AS "@id", string_agg(qty, ' | ' ORDER BY i) AS "item/qty", string_agg(st, ' | ' ORDER BY i) AS status FROM it GROUP BY doc""")
def flatten_multi(spark, d):
    return xml.flatten_records(parsed(spark, d), "order", ["@id", "item/qty", "status"])


@query("xm5_record_fields", f"""WITH {EL} SELECT DISTINCT regexp_replace(substr(path, 11), '\\[\\d+\\]', '', 'g') AS field FROM el WHERE depth > 0
UNION SELECT DISTINCT unnest(['@id', '@state', 'item/@no', 'item/@flag']) FROM el""")
def record_fields(spark, d):
    return xml.record_fields(parsed(spark, d), "order")


@query("xm6_default_record_tag", f'WITH {EL} SELECT tag, count(*) AS "count", min(depth)::INT AS depth FROM el GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT 1')
def default_tag(spark, d):
    return xml.default_record_tag(parsed(spark, d))


@query("xm7_clean_text", f"WITH {EL} SELECT doc, path, coalesce(lower(trim(text)), '') AS text, lower(attrs) AS attrs, ((text IS NOT NULL AND text <> lower(trim(text)))::INT + CASE WHEN attrs = '' THEN 0 WHEN tag = 'order' THEN 1 ELSE 1 END)::INT AS changes FROM el")
def clean_text(spark, d):
    out = xml.clean_text(parsed(spark, d), True, "lower")
    return out.select(F.col("doc_id").alias("doc"), "path", F.coalesce("text", F.lit("")).alias("text"), attrs(), "changes")


@query("xm7_refresh_content", f"WITH {EL} SELECT doc, path, lower(content) AS content FROM el")
def refresh(spark, d):
    out = xml.refresh_content(xml.clean_text(parsed(spark, d), True, "lower").drop("changes"))
    return out.select(F.col("doc_id").alias("doc"), "path", F.col("content_text").alias("content"))


@query("xm8_remove_tags", f"WITH {EL} {SHOW} WHERE NOT regexp_matches(path, '/(item|priority)\\[')")
def remove_tags(spark, d):
    e = parsed(spark, d)
    xml.check_root_kept(e, ["item", "priority"])
    return show(xml.remove_tags(e, ["item", "priority"]))


@query("xm8_removed_tag_count", f"WITH {EL} SELECT count(*) FILTER (tag IN ('item', 'priority')) AS removed FROM el")
def removed_count(spark, d):
    return xml.removed_tag_count(parsed(spark, d), ["item", "priority", "qty"])


@query("xm8_remove_attributes", f"WITH {EL} SELECT doc, path, regexp_replace(regexp_replace(attrs, 'flag=.,', ''), ',state=.$', '') AS attrs FROM el")
def remove_attributes(spark, d):
    return xml.remove_attributes(parsed(spark, d), ["flag", "state"]).select(F.col("doc_id").alias("doc"), "path", attrs())


@query("xm9_fill_empty", f"WITH {EL} SELECT doc, path, CASE WHEN tag = 'memo' THEN 'none' ELSE coalesce(text, '') END AS text FROM el")
def fill_empty(spark, d):
    return show(xml.fill_empty(parsed(spark, d), ["memo", "qty"], "none"))


@query("xm9_reformat_dates", f"WITH {EL} SELECT doc, path, CASE WHEN tag = 'ship' THEN strftime(strptime(text, '%d/%m/%Y'), '%Y-%m-%d') ELSE coalesce(text, '') END AS text FROM el")
def reformat_dates(spark, d):
    return show(xml.reformat_dates(parsed(spark, d), ["ship"], "%d/%m/%Y", "%Y-%m-%d")[0])


@query("xm9_date_failures", f"WITH {EL} SELECT doc, path, trim(text) AS value FROM el WHERE tag IN ('priority', 'status')")
def date_failures(spark, d):
    return xml.reformat_dates(parsed(spark, d), ["priority", "ship", "status"], "%d/%m/%Y", "%Y-%m-%d")[1].select(F.col("doc_id").alias("doc"), "path", "value")


@query("xm9_quantize_numbers", f"WITH {EL} SELECT doc, path, CASE WHEN tag = 'qty' THEN text || '.00' ELSE coalesce(text, '') END AS text FROM el")
def quantize_numbers(spark, d):
    return show(xml.quantize_numbers(parsed(spark, d), ["qty"], 2)[0])


@query("xm10_drop_incomplete", f"WITH {EL} {SHOW} WHERE NOT regexp_matches(path, '/item\\[')")
def drop_incomplete(spark, d):
    return show(xml.drop_incomplete(parsed(spark, d), "item", "memo"))


@query("xm10_drop_empty", f"WITH {EL} {SHOW} WHERE tag <> 'memo'")
def drop_empty(spark, d):
    return show(xml.drop_empty(parsed(spark, d)))


@query("xm10_drop_empty_cascade", f"WITH {EL} {SHOW} WHERE tag IN ('order', 'status', 'priority')")
def drop_empty_cascade(spark, d):
    bare = xml.remove_attributes(parsed(spark, d), ["no", "flag"]).withColumn("text", F.when(~F.col("tag").isin("qty", "ship", "price"), F.col("text")))
    return show(xml.drop_empty(bare))


@query("xm10a_dedupe_exact", f"""WITH {EL} SELECT doc, path, coalesce(text, '') AS text FROM el WHERE tag <> 'status'
UNION ALL SELECT doc, '/order[1]/status[' || min(i) || ']', st FROM it GROUP BY doc, st""")
def dedupe_exact(spark, d):
    return show(xml.dedupe_exact(parsed(spark, d)))


@query("xm10a_dedupe_by_key", f"""WITH {EL}, k AS (SELECT doc, min(i) AS i FROM it GROUP BY doc, flag) SELECT e.doc, e.path, coalesce(e.text, '') AS text FROM el e WHERE NOT regexp_matches(path, '/item\\[')
OR EXISTS (SELECT 1 FROM k WHERE k.doc = e.doc AND starts_with(e.path, '/order[1]/item[' || k.i || ']'))""")
def dedupe_by_key(spark, d):
    return show(xml.dedupe_by_key(parsed(spark, d), "item", "@flag"))


@query("xm10a_dedupe_by_child", f"""WITH {EL}, k AS (SELECT doc, min(i) AS i FROM it GROUP BY doc, qty) SELECT e.doc, e.path, coalesce(e.text, '') AS text FROM el e WHERE NOT regexp_matches(path, '/item\\[')
OR EXISTS (SELECT 1 FROM k WHERE k.doc = e.doc AND starts_with(e.path, '/order[1]/item[' || k.i || ']'))""")
def dedupe_by_child(spark, d):
    return show(xml.dedupe_by_key(parsed(spark, d), "item", "qty"))


@query("xm10b_rename_tag", f"WITH {EL} SELECT doc, replace(path, '/item[', '/line[') AS path, CASE WHEN tag = 'item' THEN 'line' ELSE tag END AS tag FROM el")
def rename_tag(spark, d):
    return xml.rename_tag(parsed(spark, d), "item", "line").select(F.col("doc_id").alias("doc"), "path", "tag")


@query("xm10b_rename_tag_merge", f"""WITH {EL} SELECT doc, CASE WHEN tag = 'status' THEN '/order[1]/item[' || ((SELECT count(*) FROM it WHERE it.doc = el.doc) + regexp_extract(path, 'status\\[(\\d+)', 1)::INT) || ']' ELSE path END AS path FROM el""")
def rename_merge(spark, d):
    return xml.rename_tag(parsed(spark, d), "status", "item").select(F.col("doc_id").alias("doc"), "path")


@query("xm10b_rename_attribute", f"WITH {EL} SELECT doc, path, replace(attrs, 'no=', 'number=') AS attrs FROM el")
def rename_attribute(spark, d):
    return xml.rename_attribute(parsed(spark, d), "no", "number").select(F.col("doc_id").alias("doc"), "path", attrs())


@query("xm10b_renumber", f"""WITH {EL} SELECT doc, '/order[1]/item[' || row_number() OVER (PARTITION BY doc ORDER BY i) || ']' AS path, i::VARCHAR AS no FROM it WHERE flag <> 'N'""")
def renumber(spark, d):
    e = parsed(spark, d)
    kept = xml.drop_incomplete(e.withColumn("attrs", F.when(F.element_at("attrs", "flag") == "N", F.map_filter("attrs", lambda k, _: k != "flag")).otherwise(F.col("attrs"))), "item", "@flag")
    return xml.renumber(kept).where("tag = 'item'").select(F.col("doc_id").alias("doc"), "path", F.element_at("attrs", "no").alias("no"))


@query("xm11_combine", f"""WITH {IT} SELECT '/order[1]/item[' || row_number() OVER (ORDER BY doc, i) || ']' AS path, 'item' AS tag, qty || ' ' || ship || ' ' || price AS content FROM it
UNION ALL SELECT '/order[1]/status[' || row_number() OVER (ORDER BY doc, i) || ']', 'status', st FROM it""")
def combine(spark, d):
    bare = xml.remove_attributes(parsed(spark, d), ["id", "state"])
    return xml.combine(bare).where("tag IN ('item', 'status')").select("path", "tag", F.col("content_text").alias("content"))


@query("xm12_split", f"""WITH {EL}, p AS (SELECT doc, max((i - 1) // 2 + 1) AS parts FROM it GROUP BY doc)
SELECT doc, path, (regexp_extract(path, '/item\\[(\\d+)', 1)::INT - 1) // 2 + 1 AS part FROM el WHERE regexp_matches(path, '/item\\[')
UNION ALL SELECT doc, path, unnest(range(1, parts + 1)) FROM el JOIN p USING (doc) WHERE NOT regexp_matches(path, '/item\\[')""")
def split(spark, d):
    return xml.split(parsed(spark, d), "item", 2).select(F.col("doc_id").alias("doc"), "path", "part")


@query("xm13_compare", f"""WITH {EL} SELECT doc || ':' || path AS path, CASE WHEN tag = 'memo' THEN 'Removed' ELSE 'Changed' END AS change,
tag || '|' || attrs || '|' || coalesce(trim(text), '') AS "left", CASE WHEN tag <> 'memo' THEN tag || '|' || replace(attrs, 'no=', 'number=') || '|' END AS "right" FROM el WHERE tag IN ('memo', 'item')""")
def compare(spark, d):
    e = parsed(spark, d)
    return xml.compare(e, xml.rename_attribute(xml.drop_empty(e), "no", "number"))


@query("j6_compare_trees", f"""WITH {EL} SELECT doc || ':' || path AS path, 'Added' AS change, NULL AS "left", 'memo||' AS "right" FROM el WHERE tag = 'memo'""")
def compare_added(spark, d):
    e = parsed(spark, d)
    return xml.compare(xml.drop_empty(e), e)


@query("xm14_tag_summary", f"""WITH {EL} SELECT tag, count(*) AS "count", count(*) FILTER (trim(coalesce(text, '')) <> '') AS with_text FROM el GROUP BY 1""")
def tag_summary(spark, d):
    return xml.tag_summary(parsed(spark, d))


@query("xm14_structure_counts", f"""WITH {EL} SELECT count(*) AS elements, (sum(CASE WHEN attrs = '' THEN 0 ELSE 2 END))::BIGINT AS attributes, count(DISTINCT tag) AS tags, count(*) FILTER (trim(coalesce(text, '')) <> '') AS with_text FROM el""")
def structure(spark, d):
    return xml.structure_counts(parsed(spark, d))
