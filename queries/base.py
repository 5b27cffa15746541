"""Registry and fixtures shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL counterpart."""

    def add(fn):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Fixtures: missing values injected by fixed rules, because the tables hold none.

def lineitem_nulls(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.withColumns({
        "l_quantity": F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")),
        "l_tax": F.when(F.col("l_orderkey") % 10 >= 6, F.col("l_tax")),
        "l_returnflag": F.when(F.col("l_partkey") % 7 != 0, F.col("l_returnflag")),
    })


LINEITEM_NULLS = """lineitem_nulls AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS l_quantity,
         l_extendedprice, l_discount,
         CASE WHEN l_orderkey % 10 >= 6 THEN l_tax END AS l_tax,
         CASE WHEN l_partkey % 7 <> 0 THEN l_returnflag END AS l_returnflag,
         l_linestatus, l_shipdate
  FROM lineitem)"""

LINEITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
LINEITEM_NUMERIC = [c for c, t in LINEITEM_TYPES.items() if t in ("bigint", "int", "double")]


def customer_neg(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumnRenamed("c_acctbal", "account_amount")


CUSTOMER_NEG = "customer_neg AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal AS account_amount, c_mktsegment FROM customer)"


def orders_dup(spark, sf_dir) -> DataFrame:
    """All orders, and every urgent order a second time."""
    o = table(spark, sf_dir, "orders")
    return o.unionByName(o.where(F.col("o_orderpriority") == "1-URGENT"))


ORDERS_DUP = "orders_dup AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderpriority = '1-URGENT')"


def corpus(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
