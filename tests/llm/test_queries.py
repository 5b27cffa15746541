"""The registered queries on the smallest tables, the pipeline, and SQL counterparts in DuckDB."""

import os

import pytest

import corpus_pipeline
from tabloom.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        problem, _ = compare(df, SQL[name], con)
        assert problem is None, problem
    else:
        table = "pages" if name.startswith(("op6_", "op10_")) else "documents"
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns, name
        assert after.exceptAll(before).count() == 0 or name == "mix_sources"
        if name in ("language_id", "quality_classifier"):
            good = before.join(labels.where("quality = 1"), "doc_id", "left_semi")
            lost = good.join(after, "doc_id", "left_anti").count()
            assert lost <= 0.02 * good.count(), name
        before = after
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == before.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "simhash_near_dedup", "mix_sources", "bpe"]


def test_url_sql_follows_links(spark):
    import duckdb

    from tabloom.llm import url_filter
    from tests.llm.test_corpus import PAGES

    # Targets that end where a rule's path does, with a default port, and of nobody's rule.
    ends = ["https://shop.com/de/", "https://shop.com:443/de/", "https://x.org/", "https://a.example.org/es/", "https://b.example.org/es", "https://free.net/"]
    more = [(900 + i, f"https://alias{i}.net/p", f'<link rel="canonical" href="{u}">') for i, u in enumerate(ends)]
    pages = spark.createDataFrame(PAGES + more, "page_id bigint, url string, html string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    problem, _ = compare(url_filter.judge(pages), SQL["op10_url_filter"], con)
    assert problem is None, problem
    said = {r.page_id: r.verdict for r in url_filter.judge(pages).where("page_id >= 900").collect()}
    assert said == {900: "block", 901: "block", 902: "allow", 903: "block", 904: "allow", 905: "allow"}
