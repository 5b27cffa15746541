"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import pytest

from queries import load_all
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = load_all()


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
        assert len(df.columns) == len(set(df.columns))
        df.collect()


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)
