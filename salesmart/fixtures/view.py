"""Raw order rows made from the retail test tables, with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.config import REQUIRED_COLUMNS, SalesConfig

FIXTURE_CONFIG = SalesConfig(
    categories=("ECONOMY", "SMALL", "LARGE", "MEDIUM", "STANDARD"),
    regions=("AFRICA", "AMERICA", "ASIA", "EUROPE"),
)
# File order of the rows of one order; unique within an order.
FIXTURE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate",
)
RAW_COLUMNS = (*REQUIRED_COLUMNS, "discount_pct")


# Columns the feed is made of; naming them saves reading file footers first.
TABLES = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz"
    ),
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_type string, p_retailprice double",
    "events": "event_id bigint, value double",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part."""
    part = read(spark, sf_dir, "part")
    return read(spark, sf_dir, "lineitem").join(part, F.expr("l_partkey = p_partkey"))


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the region of their customer."""
    return (
        read(spark, sf_dir, "orders")
        .join(read(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .join(read(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
        .selectExpr("o_orderkey", "o_custkey", "string(date(o_orderdate)) AS o_day", "r_name")
    )


SALES_EXPRESSIONS = {
    "order_id": "l_orderkey",
    "customer_id": "CASE WHEN l_partkey % 101 <> 0 THEN o_custkey END",
    "product": "CASE WHEN l_partkey % 103 <> 0 THEN p_name END",
    "category": "p_type",
    "quantity": "CASE WHEN l_suppkey % 37 = 0 THEN -l_quantity ELSE l_quantity END",
    "unit_price": "l_extendedprice / l_quantity",
    "sales": (
        "CASE WHEN l_suppkey % 41 <> 7 THEN "
        "l_extendedprice * (1 - l_discount) * IF(l_orderkey % 211 = 0, 50, 1) END"
    ),
    "profit": "l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice",
    "date": (
        "CASE WHEN l_orderkey % 307 = 0 THEN NULL "
        "WHEN l_partkey % 113 = 0 THEN '2024-02-30' ELSE o_day END"
    ),
    "region": "r_name",
    "discount_pct": "l_discount * 250",
}


def _as_sales(joined: DataFrame, *more: str) -> DataFrame:
    made = [f"{SALES_EXPRESSIONS[name]} AS {name}" for name in RAW_COLUMNS]
    return joined.selectExpr(*made, *more)


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw row per line item, plus the columns that order them.

    Join sizes are left to Spark: it broadcasts a side only where its size is
    known to be small, and splits skewed keys of the other joins.
    """
    orders = placed_orders(spark, sf_dir)
    joined = lines(spark, sf_dir).join(orders, F.expr("l_orderkey = o_orderkey"))
    return _as_sales(joined, *FIXTURE_ORDER)
