"""XML documents to an element table: the only parsing step; everything after it is relational."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.columns import col
from tabloom.functions.scalars import content_digest
from tabloom.session import cut_lineage

ELEMENTS = (
    "doc_id {key}, path string, parent_path string, pos int, ord int, last_ord int, depth int, tag string, "
    "namespace string, attrs map<string,string>, text string, tail string, content_text string, error string"
)
CHUNK_ROWS = 50_000


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, xml, digest) of whole files."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), F.col("content").alias("xml"), content_digest("content").alias("digest"))


def read_records(spark: SparkSession, path: str, row_tag: str, schema=None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def _rows(doc_id, xml, content):
    """Element rows of one document in document order; one error row when it is not well-formed."""
    import xml.etree.ElementTree as ET

    data = bytes(xml) if not isinstance(xml, str) else xml
    declared = b"<!ENTITY" in data if isinstance(data, bytes) else "<!ENTITY" in data
    try:
        if declared:
            raise ValueError("entity declarations are not accepted")
        root = ET.fromstring(data)
    except (ET.ParseError, ValueError) as e:
        return [(doc_id, None, None, None, None, None, None, None, None, None, None, None, None, str(e))]
    rows, stack, order = [], [(root, "", 1, 1, 0)], 0
    while stack:
        node, parent, index, pos, depth = stack.pop()
        if node is None:  # the subtree that began at row ``index`` is complete
            rows[index][5] = order
            continue
        order += 1
        uri, _, name = node.tag[1:].partition("}") if node.tag.startswith("{") else ("", "", node.tag)
        path = f"{parent}/{name}[{index}]"
        attrs = [(k.rpartition("}")[2], v) for k, v in node.attrib.items()]
        below = " ".join(p.strip() for p in node.itertext() if p.strip()) if content else None
        rows.append([doc_id, path, parent or "/", pos, order, order, depth, name, uri, attrs, node.text, node.tail, below, None])
        if not len(node):
            continue
        stack.append((None, "", len(rows) - 1, 0, 0))
        seen, children = {}, []
        for at, child in enumerate(node, 1):
            local = child.tag.rpartition("}")[2]
            seen[local] = seen.get(local, 0) + 1
            children.append((child, path, seen[local], at, depth + 1))
        stack.extend(reversed(children))
    return rows


def parse_elements(documents: DataFrame, key: str = "doc_id", xml: str = "xml", content: bool = True) -> DataFrame:
    """One row per element: (doc_id, path, parent_path, pos among siblings, document order, ...).

    Documents are parsed independently, so the work spreads over all partitions; a document that
    does not parse gives one row with ``error`` set and no path. ``content=False`` leaves
    ``content_text`` empty, which spares the text of every ancestor.
    """
    parse, schema = _parser(documents, key, content)
    return documents.select(col(key).alias("doc_id"), col(xml).alias("xml")).mapInArrow(parse, schema)


def _parser(documents, key, content):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ELEMENTS.format(key=documents.schema[key].dataType.simpleString()))
    arrow = to_arrow_schema(schema)

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += _rows(doc_id, text, content)
                if len(rows) >= CHUNK_ROWS:
                    yield _batch(pa, rows, arrow)
                    rows = []
            if rows:
                yield _batch(pa, rows, arrow)

    return parse, schema


def _batch(pa, rows, arrow):
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def elements(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NULL").drop("error")


def _packed(batches):
    """Element rows without errors as Parquet images of at most ``CHUNK_ROWS`` rows, one a row."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    for batch in batches:
        good = pa.Table.from_batches([batch]).filter(pc.is_null(batch.column("error"))).drop_columns(["error"])
        for start in range(0, good.num_rows, CHUNK_ROWS):
            image = pa.BufferOutputStream()
            pq.write_table(good.slice(start, CHUNK_ROWS), image, compression="zstd")
            yield pa.RecordBatch.from_arrays([pa.array([image.getvalue().to_pybytes()], pa.binary())], ["chunk"])


def _unpacked(batches):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for batch in batches:
        for chunk in batch.column(0):
            yield from pq.read_table(pa.BufferReader(chunk.as_buffer()), use_threads=False).to_batches()


def parse_and_store(documents: DataFrame, key: str = "doc_id", xml: str = "xml", content: bool = True) -> DataFrame:
    """Elements of all documents that parse, stored in the shared checkpoint folder: operators that look at the
    elements several times read them and parse no document again.

    Stored are compressed columns of many rows each, as paths, tags and ids repeat: rows as Spark
    checkpoints them take seven times the space.
    """
    from pyspark.sql.types import StructType

    parse, schema = _parser(documents, key, content)
    stored = documents.select(col(key).alias("doc_id"), col(xml).alias("xml")).mapInArrow(lambda batches: _packed(parse(batches)), "chunk binary")
    return cut_lineage(stored).mapInArrow(_unpacked, StructType([f for f in schema if f.name != "error"]))


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NOT NULL").select("doc_id", "error")
