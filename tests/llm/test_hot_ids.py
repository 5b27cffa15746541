"""One id, or none, on most of the rows: the work spreads and the results stay those of a plain sort."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tabloom.llm import imatch, mixing
from tests.llm.helpers import table


def hot_rows(hot, n=3000):
    few = [-(1 << 63), (1 << 63) - 1, -7, 0, 12, 13, 14, 900]
    return [(few[i] if i < len(few) else hot if i % 3 else i, f"text number {i} of the table {i * i % 97}", "en", "a", 0) for i in range(n)]


@pytest.mark.parametrize("hot", [None, 13, -(1 << 63)])
def test_next_of_a_hot_id(spark, hot):
    rows = hot_rows(hot)
    docs = table(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("digest"))
    digests = {r.text: r.digest for r in docs.collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), digests[r[1]]))
    want = {r[1]: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    got = imatch.with_next(docs, ["text"], 40).withColumn("task", F.spark_partition_id()).collect()
    assert {r.text: r.next_text for r in got} == want and len(got) == len(rows)
    cuts, crowded = imatch._cuts(docs, 40)
    assert max(crowded.values()) > 10  # the hot id is cut into many parts
    tables = imatch.edited_fingerprints(table(spark, rows), (0.01, 0.9), 40).select("doc_id", "edited_sha256").collect()
    cut = lambda t: t[: len(t) - len(t) // 3] + want[t][: len(t) // 3]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, tables), key=key) == sorted([(r[0], hashlib.sha256(cut(r[1]).encode()).hexdigest()) for r in rows], key=key)


@pytest.mark.parametrize("hot", [None, 13])
def test_mix_of_a_hot_id(spark, hot, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 100)
    rows = [(hot if i % 3 else i, f"word number {i}", "en", "a" if i % 4 else "b", 0) for i in range(3000)] + [(hot, "the same text", "en", "a", 0)] * 250
    docs = table(spark, rows)
    units = mixing.units_of(docs, sliced=True)
    assert units.count() == len(rows) == units.dropDuplicates(["doc_id", "source", "size", "nth"]).count()
    assert units.groupBy("doc_id", "source", "size").agg((F.max("nth") - F.count("*")).alias("d")).where("d <> 0").isEmpty()
    largest = units.groupBy("doc_id", "source", "size", "text_slice").count().agg(F.max("count")).first()[0]
    assert 250 <= largest < 300  # the rows of one text, and few besides
    words = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("words")).collect()
    kept = mixing.mixed_rows(docs).groupBy("source").agg((F.count("*") * 3).alias("words")).collect()
    assert {r.source: r.words for r in kept} == {r.source: r.words for r in words}
