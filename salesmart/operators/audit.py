"""Totals of a loaded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.config import SalesConfig
from salesmart.functions.numeric import exact_mean, exact_total
from salesmart.functions.text import grouped, percent
from salesmart.operators.facts import customers_sketched, facts


def audit_summary(
    rows: DataFrame, config: SalesConfig = SalesConfig(), approximate: bool = False
) -> DataFrame:
    """Totals as one row. Categories are few, so they are collected, not counted
    by a second distinct that would read every row once more.

    With ``approximate``, customers are counted by a sketch, off by
    ``SKETCH_ERROR``: no customer is shuffled.
    """
    return facts(rows, config).agg(
        F.count("*").alias("orders"),
        exact_total("f_sales").alias("total_sales"),
        exact_total("f_profit").alias("total_profit"),
        exact_mean("f_margin", "f_margins").alias("avg_margin"),
        (customers_sketched() if approximate else F.count_distinct("customer_id")).alias("customers"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
        F.coalesce(F.sum("f_outliers"), F.lit(0)).cast("long").alias("outliers"),
        F.size(F.collect_set("category")).cast("long").alias("categories"),
    )


def audit_formatted(summary: DataFrame) -> DataFrame:
    """The summary as one row of text."""
    return summary.select(
        grouped(F.col("orders")).alias("total_orders"),
        F.concat(F.lit("INR "), grouped(F.col("total_sales"))).alias("total_sales"),
        F.concat(F.lit("INR "), grouped(F.col("total_profit"))).alias("total_profit"),
        percent(F.col("avg_margin")).alias("avg_margin"),
        grouped(F.col("customers")).alias("unique_customers"),
        F.concat(
            F.col("date_min").cast("string"), F.lit(" to "), F.col("date_max").cast("string")
        ).alias("date_range"),
        F.col("outliers").cast("string").alias("outlier_rows"),
        F.col("categories").cast("string").alias("categories"),
    )
