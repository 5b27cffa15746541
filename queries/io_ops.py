"""Sources and sinks (IO1-IO4, IO7, IO10-IO17) and the step log (C15)."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import functions as F

from queries.base import query, table
from tabloom.plans import store
from tabloom.sources import archives, files


@query("io1_read_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_csv(spark, d):
    path = files.write_csv(table(spark, d, "customer"), files.scratch_path(spark, "csv"))
    return files.read_csv(spark, path)


@query("io2_read_json_records", """SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders""")
def read_json(spark, d):
    """Each document holds the orders of one customer under its first list-valued key."""
    o = table(spark, d, "orders")
    docs = o.groupBy("o_custkey").agg(F.to_json(F.struct(
        F.lit("orders of a customer").alias("note"),
        F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus")).alias("orders"))).alias("value"))
    return files.typed_records(files.json_records(docs))


@query("io2_read_json_lists", """SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT n_nationkey, n_name FROM nation""")
def read_json_lists(spark, d):
    s = table(spark, d, "supplier")
    lists = s.groupBy("s_nationkey").agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("value")).select("value")
    single = table(spark, d, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("s_suppkey"), F.col("n_name").alias("s_name"))).alias("value"))
    return files.typed_records(files.json_records(lists.unionByName(single))).select("s_suppkey", "s_name")


def nested_orders(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty")))).alias("items"))
    o = table(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("customer"))
    return o.join(li, "o_orderkey").select(F.to_json(F.struct("o_orderkey", "customer", "items")).alias("value"))


@query("io3_flatten_nested", """SELECT o_orderkey, o_custkey AS customer__key, o_orderstatus AS customer__status,
(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_quantity) - 1)::INT AS item, l_partkey AS part, l_quantity AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def flatten(spark, d):
    """All items of every order; the flat columns are turned into rows again, as their number follows the data."""
    flat = files.flatten_nested(files.typed_records(files.parse_lines(nested_orders(spark, d))))
    places = sum(c.endswith("__part") for c in flat.columns)
    items = F.array(*[F.struct(F.lit(i).alias("item"), F.col(f"items__{i}__part").alias("part"), F.col(f"items__{i}__qty").cast("double").alias("qty")) for i in range(places)])
    return flat.select("o_orderkey", "customer__key", "customer__status", F.inline(items)).where("part IS NOT NULL")


@query("io4_read_text_lines", r"""SELECT text, count(*) AS n FROM (SELECT regexp_replace(unnest(regexp_split_to_array(text, '\r\n|\r|\n')), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM conversations) WHERE text <> '' GROUP BY 1""")
def read_lines(spark, d):
    path = files.scratch_path(spark, "lines")
    table(spark, d, "conversations").select("text").write.text(path)
    return files.read_text_lines(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("io7_ingest_log", "SELECT source AS filename, count(*) AS n_docs FROM documents GROUP BY 1 ORDER BY 1 LIMIT 8")
def ingest_log(spark, d):
    log = files.log_ingest(table(spark, d, "documents"), files.scratch_path(spark, "log"))
    return files.latest_ingests(log).select("filename", "n_docs")


def png_bytes(values):
    """8 x 8 grey PNG of 64 intensities."""
    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    raw = b"".join(b"\0" + bytes(int(v) for v in values[r * 8:r * 8 + 8]) for r in range(8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def png_files(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.6) * 220).cast("int")))).alias("v"))

    def encode(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"name": [f"img_{i}.png" for i in b["vec_id"]], "content": [png_bytes(v) for v in b["v"]]})

    return e.mapInPandas(encode, "name string, content binary")


@query("io10_read_images", """SELECT 'img_' || vec_id || '.png' AS name, 8::INT AS width, 8::INT AS height, list_sum(list_transform(embedding, lambda e: greatest(0, least(255, floor((e::DOUBLE + 0.6) * 220)))))::BIGINT AS total FROM embeddings""")
def read_images(spark, d):
    folder = files.scratch_path(spark, "images")
    archives.store_files(png_files(spark, d), folder).agg(F.sum("size")).collect()
    images = archives.read_images(spark, folder)
    from tabloom.operators.image import pixel_table

    return pixel_table(images.select(F.col("name").alias("image_id"), "image")).groupBy(F.col("image_id").alias("name")).agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.sum("r").alias("total"))


def zipped_documents(spark, d):
    """One archive per document: a folder, an old and a new file of the same base name."""
    def pack(batches):
        import io
        import zipfile

        import pandas as pd

        for b in batches:
            out = []
            for text in b["text"]:
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w") as z:
                    z.writestr("old/", "")
                    z.writestr("old/body.txt", "outdated")
                    z.writestr("new/body.txt", text)
                out.append(buf.getvalue())
            yield pd.DataFrame({"archive": b["doc_id"].astype(str), "content": out})

    return table(spark, d, "documents").select("doc_id", "text").mapInPandas(pack, "archive string, content binary")


@query("io11_zip_entries", "SELECT doc_id::VARCHAR AS archive, unnest([1, 2])::INT AS entry_no, 'body.txt' AS name, unnest([sha256('outdated'), sha256(text)]) AS digest FROM documents")
def zip_entries(spark, d):
    entries = archives.zip_entries(zipped_documents(spark, d))
    return entries.select("archive", "entry_no", "name", F.sha2("content", 256).alias("digest"))


@query("io11_zip_last_wins", "SELECT 'body.txt' AS name, max(doc_id::VARCHAR) AS archive, 2::INT AS entry_no, arg_max(sha256(text), doc_id::VARCHAR) AS digest FROM documents")
def zip_last(spark, d):
    return archives.last_by_name(archives.zip_entries(zipped_documents(spark, d))).select("name", "archive", "entry_no", F.sha2("content", 256).alias("digest"))


@query("io12_write_csv", "SELECT doc_id, md5(text) AS digest, lang FROM documents")
def write_csv(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    path = files.write_csv(docs, files.scratch_path(spark, "out-csv"))
    return files.read_csv(spark, path, docs.schema, multiLine=True).select("doc_id", F.md5("text").alias("digest"), "lang")


@query("io13_write_json", "SELECT doc_id, md5(text) AS digest FROM documents")
def write_json(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    path = files.write_json(docs, files.scratch_path(spark, "out-json"))
    return files.read_json_lines(spark, path, docs.schema).select("doc_id", F.md5("text").alias("digest"))


@query("io14_write_xml", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def write_xml(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = files.write_xml(s, files.scratch_path(spark, "out-xml"), "suppliers", "supplier")
    return spark.read.format("xml").schema(s.schema).option("rowTag", "supplier").load(path)


@query("io14_write_parts", "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, true AS bounded FROM orders")
def write_parts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    path = files.write_parts(o, files.scratch_path(spark, "parts"), 500, "parquet")
    back = spark.read.parquet(path).withColumn("_f", F.input_file_name())
    per_file = back.groupBy("_f").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") <= 500).alias("bounded"))
    return back.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("keys")).join(per_file, F.lit(True))


@query("io15_save_named", "SELECT n_nationkey, n_name FROM nation")
def save_named(spark, d):
    s = store.VersionStore(spark, files.scratch_path(spark, "named"))
    s.save(table(spark, d, "region"), "regions")
    s.save(table(spark, d, "nation").select("n_nationkey", "n_name"), "nations")
    return s.available()["nations"]


@query("io16_version_store", """SELECT 1::INT AS version, 'raw' AS label, NULL::INT AS source_version, count(*) AS rows FROM orders UNION ALL
SELECT 2, 'urgent', 1, count(*) FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 3, 'raw', 1, count(DISTINCT o_custkey) FROM orders""")
def version_store(spark, d):
    s = store.VersionStore(spark, files.scratch_path(spark, "versions"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    first = s.save(o, "raw")
    s.save(o.where("o_orderpriority = '1-URGENT'"), "urgent", first)
    s.save(o.select("o_custkey").distinct(), "raw", first)
    counts = None
    for v in (1, 2, 3):
        one = s.read(v).agg(F.count(F.lit(1)).alias("rows")).withColumn("version", F.lit(v))
        counts = one if counts is None else counts.unionByName(one)
    return s.versions().join(counts, "version").select("version", "label", "source_version", "rows")


def lineage(spark, d):
    """Every order but the first of a customer is taken as derived from the customer's previous one."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("version"), F.lag("o_orderkey").over(w).alias("source_version"), F.col("o_orderpriority").alias("label"))


LINEAGE = "lineage AS (SELECT o_orderkey AS version, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS source_version, o_orderpriority AS label FROM orders)"


@query("io16_latest_per_label", f"WITH {LINEAGE} SELECT label, max(version) AS version, arg_max(coalesce(source_version, -1), version) AS source_version FROM lineage GROUP BY 1")
def latest(spark, d):
    return store.latest_per_label(lineage(spark, d)).withColumn("source_version", F.coalesce("source_version", F.lit(-1)))


@query("io17_purge_dependents", f"""WITH RECURSIVE {LINEAGE}, reach AS (SELECT version FROM lineage WHERE label = '1-URGENT'
UNION SELECT l.version FROM lineage l JOIN reach r ON l.source_version = r.version) SELECT version, label FROM lineage WHERE version NOT IN (SELECT version FROM reach)""")
def purge(spark, d):
    versions = lineage(spark, d)
    return store.purge(versions, versions.where("label = '1-URGENT'")).select("version", "label")


@query("c15_step_log", "SELECT 'orders' AS dataset, 1::INT AS step, 'rows: ' || count(*) AS description FROM orders UNION ALL SELECT 'orders', 2, 'customers: ' || count(DISTINCT o_custkey) FROM orders")
def step_log(spark, d):
    n, k = table(spark, d, "orders").agg(F.count(F.lit(1)), F.count_distinct("o_custkey")).first()
    log = store.append_step(store.empty_log(spark), "orders", f"rows: {n}")
    log = store.append_step(store.append_step(log, "parts", "loaded"), "orders", f"customers: {k}")
    return store.reset_steps(log, "parts")
