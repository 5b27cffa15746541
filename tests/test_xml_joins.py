"""XML operators at size: no broadcast of element tables, compact storage."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import xml
from tabloom.sources import xmldocs

DOC = "<a k='1'><b x='1'><q>7</q><m/></b><b x='1'><q>8</q></b><s>O</s><s>O</s></a>"


@pytest.fixture(scope="module")
def elements(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(DOC).alias("xml"))
    return xmldocs.parse_and_store(docs)


def steps(e):
    bare = xml.remove_attributes(e, ["k"])
    return {
        "drop_incomplete": lambda: xml.drop_incomplete(e, "b", "m"),
        "drop_empty": lambda: xml.drop_empty(e),
        "dedupe_exact": lambda: xml.dedupe_exact(e),
        "dedupe_by_key": lambda: xml.dedupe_by_key(e, "b", "@x"),
        "dedupe_by_child": lambda: xml.dedupe_by_key(e, "b", "q"),
        "rename_tag": lambda: xml.rename_tag(e, "b", "c"),
        "rename_tag_merge": lambda: xml.rename_tag(e, "s", "b"),
        "renumber": lambda: xml.renumber(xml.drop_incomplete(e, "b", "m")),
        "refresh_content": lambda: xml.refresh_content(e),
        "compare": lambda: xml.compare(e, xml.drop_empty(e)),
        "combine": lambda: xml.combine(bare),
        "select_path": lambda: xml.select_path(e, ".//q"),
        "own_text": lambda: xml.match_path(e, "s[.='O']"),
        "child_text": lambda: xml.match_path(e, "b[q='7']/q"),
        "last": lambda: xml.match_path(e, "b[last()]"),
        "parent": lambda: xml.match_path(e, ".//q/../m"),
    }


@pytest.mark.parametrize("name", [
    "drop_incomplete", "drop_empty", "dedupe_exact", "dedupe_by_key", "dedupe_by_child", "rename_tag", "rename_tag_merge", "renumber",
    "refresh_content", "compare", "combine", "select_path", "own_text", "child_text", "last", "parent"])
def test_element_tables_are_not_broadcast(elements, name):
    plan = steps(elements)[name]()._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_stored_elements_are_small(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("<a>"), F.repeat(F.lit("<b><c>some text</c></b>"), 20), F.lit("</a>")).alias("xml"))
    seen = []
    real = xmldocs.cut_lineage

    def cut(df):
        out = real(df)
        seen.append(out)
        return out

    try:
        xmldocs.cut_lineage = cut
        stored = xmldocs.parse_and_store(docs.coalesce(1))
    finally:
        xmldocs.cut_lineage = real
    assert stored.count() == 2_000 * 41
    held = seen[0].agg(F.sum(F.length("chunk"))).first()[0] if seen[0].columns == ["chunk"] else seen[0].agg(F.sum(F.length("path"))).first()[0]
    assert held < 2_000 * 41 * 8  # paths alone have 17 characters


def test_stored_elements_are_the_parsed_ones(spark):
    docs = spark.createDataFrame([("a", DOC), ("a", DOC), (None, "<r>x<y z='1'/>t</r>"), ("bad", "<r>"), ("none", None)], "doc_id string, xml string").where("xml IS NOT NULL")
    parsed = xmldocs.elements(xmldocs.parse_elements(docs))
    stored = xmldocs.parse_and_store(docs)
    assert stored.schema == parsed.schema
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(stored) == rows(parsed)


def test_an_empty_table_is_stored(spark):
    assert xmldocs.parse_and_store(spark.createDataFrame([], "doc_id int, xml string")).count() == 0
