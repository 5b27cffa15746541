"""Depth, ids of any kind, forced large-input paths and strict paths."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tabloom.operators import image, profile, split, text, xml
from tabloom.plans import store
from tabloom.sources import xmldocs

LINKS = "version int, source_version int"


def test_deep_chains(spark):
    deep = [(1, None)] + [(i, i - 1) for i in range(2, 151)]
    side = [(200, 150), (201, 120), (300, None), (301, 300)]
    versions = spark.createDataFrame(deep + side, LINKS)
    assert store.chain(versions, 150) == list(range(1, 151))
    assert store.chain(versions, 200) == [*range(1, 151), 200]
    assert store.chain(versions, 300) == [300]
    assert store.chain(versions, 999) is None
    gone = {r["version"] for r in store.descendants(versions, spark.createDataFrame([(100,)], "version int")).collect()}
    assert gone == set(range(100, 151)) | {200, 201}
    assert {r["version"] for r in store.purge(versions, spark.createDataFrame([(100,)], "version int")).select("version").collect()} == set(range(1, 100)) | {300, 301}


def test_broken_chains(spark):
    cycle = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (5, 4)], LINKS)
    assert store.chain(cycle, 3) is None and store.chain(cycle, 5) is None
    assert {r["version"] for r in store.descendants(cycle, spark.createDataFrame([(2,)], "version int")).collect()} == {1, 2, 3}
    assert {r["version"] for r in store.descendants(cycle, spark.createDataFrame([(4,)], "version int")).collect()} == {4, 5}


def test_appending_keeps_ids(spark):
    frame = lambda *t: spark.createDataFrame([(i, x, x.upper()) for i, x in enumerate(t)], "k int, text string, tag string")
    corpus = text.append_to_corpus(None, frame("b", "a"), "z.txt", order_by="k")
    corpus = text.append_to_corpus(corpus, frame("c"), "a.txt", order_by="k")
    corpus = text.append_to_corpus(corpus, frame("d", "e"), "m.txt", order_by="k", label="tag")
    rows = [tuple(r) for r in corpus.select("doc_id", "text", "source", "label").orderBy("doc_id").collect()]
    assert rows == [(0, "b", "z.txt", None), (1, "a", "z.txt", None), (2, "c", "a.txt", None), (3, "d", "m.txt", "D"), (4, "e", "m.txt", "E")]


DOC = "<r a='1'><i f='R' k=''><q>7</q> t<q>8</q></i><i f='N'><q>7</q><s>x<b>y</b></s></i><j><i f='R'/></j></r>"
PATHS = ["i", "i/q", "*", ".", "./i", ".//q", ".//i", "i[1]", "i[2]/q", "i[last()]", "i[last()-1]/q", "i[@f]", "i[@k]/q", "i[@f='R']/q", "i[@f!='R']/q", "i[q]", "i[s]/q", "i[q='8']",
         "i[s='xy']", ".//q[.='7']", "i[s!='z']", ".//q/..", "*[i]", ".//i[@f='R'][1]", "j/i", "nothing"]


def test_paths_like_element_tree(spark):
    parsed = xmldocs.parse_and_store(spark.createDataFrame([(1, DOC)], "doc_id int, xml string"))
    root = ET.fromstring(DOC)
    places = {}

    def walk(node, path):
        places[node] = path
        seen = {}
        for child in node:
            seen[child.tag] = seen.get(child.tag, 0) + 1
            walk(child, f"{path}/{child.tag}[{seen[child.tag]}]")

    walk(root, "/r[1]")
    for path in PATHS:
        want = sorted({places[n] for n in root.findall(path)})
        assert sorted(r["path"] for r in xml.match_path(parsed, path).select("path").collect()) == want, path


@pytest.mark.parametrize("path", ["i[", "i[@f='R]", "i[position()=1]", "i|q", "i[q and s]", "/r/i", "i//", "i[contains(q,'7')]", "text()"])
def test_unsupported_paths_raise(spark, path):
    parsed = xmldocs.elements(xmldocs.parse_elements(spark.createDataFrame([(1, DOC)], "doc_id int, xml string")))
    with pytest.raises(ValueError):
        xml.match_path(parsed, path)


def test_combining_documents_with_text_ids_on_the_large_path(spark):
    docs = [(f"{c}.xml", f"<r><a>{c}1</a><b/><a>{c}2</a></r>") for c in "cab"]
    parsed = xmldocs.parse_and_store(spark.createDataFrame(docs, "doc_id string, xml string"))
    pairs = lambda df: {r["path"]: r["text"] for r in df.where("tag = 'a'").collect()}
    want = {f"/r[1]/a[{i + 1}]": t for i, t in enumerate(["a1", "a2", "b1", "b2", "c1", "c2"])}
    assert pairs(xml.combine(parsed)) == want
    assert pairs(xml.combine(parsed, single_task_rows=1, buckets=4)) == want


def test_one_parse_per_document(spark):
    parsed = xmldocs.parse_and_store(spark.createDataFrame([(1, DOC)], "doc_id int, xml string"))
    assert "MapInArrow" not in xml.dedupe_exact(parsed)._jdf.queryExecution().toString()


def test_describe_all_kinds(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'x', true, timestamp'2020-01-01'), (2, 'x', false, timestamp'2020-01-03'), (3, 'y', true, null) t(n, s, b, d)")
    rows = {r["column"]: r for r in profile.describe_all(df).collect()}
    assert set(rows) == {"n", "s", "b", "d"}
    assert (rows["b"]["top"], rows["b"]["freq"], rows["b"]["unique"]) == ("true", 2, 2)
    day = 86_400.0
    assert (rows["d"]["count"], rows["d"]["max"] - rows["d"]["min"], rows["d"]["mean"] - rows["d"]["min"], rows["d"]["std"]) == (2, 2 * day, day, None)
    assert rows["s"]["top"] == "x" and rows["n"]["mean"] == 2


def test_palette_of_all_pixels(spark):
    rows = [(i % 3, i // 30, i % 30, *((250, 0, 0) if i % 10 else (0, 0, 250))) for i in range(900)]
    pixels = spark.createDataFrame(rows, "image_id int, y int, x int, r int, g int, b int")
    shares = image.dominant_colours(pixels, 2).groupBy("image_id").agg(F.sum("share").alias("s"), F.count("*").alias("n")).collect()
    assert all(r["s"] == pytest.approx(100) and r["n"] == 2 for r in shares)


def test_stratified_split_of_many_classes(spark):
    df = spark.range(24_000).select(F.col("id"), (F.col("id") % 12_000).alias("label"))
    counts = split.train_test_split(df, "id", 0.5, stratify="label").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in counts} == {"train": 12_000, "test": 12_000}
