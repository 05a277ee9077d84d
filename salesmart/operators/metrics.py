"""Headline figures, grouped metrics, month windows, top lists.

Metrics that take ``fact_rows`` accept the output of ``facts`` or of ``cube``.
Windows without a partition run only over month, region or category results or
over a finished top list, all of them small by their domain.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.functions.bins import (
    CUSTOMER_SEGMENTS,
    DISCOUNT_BANDS,
    PROFIT_TIERS,
    label_rank,
)
from salesmart.functions.dates import day_month_year
from salesmart.functions.numeric import (
    exact_mean,
    exact_sum,
    exact_total,
    half_even,
)
from salesmart.functions.text import grouped, money, percent, signed_percent, title
from salesmart.operators.facts import FACT_NAMES, ROWS, SKETCH, customers_sketched

TOP_PRODUCTS = 10
RECENT_ROWS = 20
# The columns of the recent rows, in order.
RECENT_COLUMNS = (
    "order_id", "customer_id", "product", "category", "sales", "profit",
    "profit_margin_pct", "region", "date", "profit_tier", "customer_segment",
)


def _by(fact_rows: DataFrame, key: str):
    return fact_rows.filter(F.col(key).isNotNull()).groupBy(key)


def _numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(W.orderBy(*order))).orderBy("pos")


# --- headline figures --------------------------------------------------------


def kpi_summary(fact_rows: DataFrame, approximate: bool = False) -> DataFrame:
    """One row of totals; zeros and a missing margin over no rows.

    With ``approximate``, customers are counted by a sketch, off by ``SKETCH_ERROR``.
    """
    customers = customers_sketched() if approximate else F.count_distinct("customer_id")
    return _kpis(fact_rows, F.count("*"), customers)


def segment_facts(fact_rows: DataFrame, approximate: bool = False) -> DataFrame:
    """Facts, rows and customers per segment, the base of two panels.

    With ``approximate``, customers are counted by sketches, off by ``SKETCH_ERROR``;
    a kept cube, which has sketches and no customers, can then be asked as well.
    """
    sums = [F.sum(name).alias(name) for name in fact_rows.columns if name in FACT_NAMES]
    if SKETCH in fact_rows.columns:
        if not approximate:
            raise ValueError("A cube has no exact customers")
        rows, customers = F.sum(ROWS), F.hll_sketch_estimate(F.hll_union_agg(SKETCH))
    else:
        rows = F.count("*")
        customers = customers_sketched() if approximate else F.count_distinct("customer_id")
    return fact_rows.groupBy("customer_segment").agg(
        *sums, rows.alias("rows"), customers.alias("customers")
    )


def kpi_of_segments(segments: DataFrame) -> DataFrame:
    """``kpi_summary`` from ``segment_facts``. A customer has one segment, as it
    has one number of orders, so customers add up over segments."""
    whole = [F.coalesce(F.sum(name), F.lit(0)) for name in ("rows", "customers")]
    return _kpis(segments, *whole)


def _kpis(rows: DataFrame, orders: Column, customers: Column) -> DataFrame:
    totals = rows.agg(
        exact_total("f_sales").alias("total_sales"),
        exact_total("f_profit").alias("total_profit"),
        exact_mean("f_margin", "f_margins").alias("avg_margin"),
        orders.alias("orders"),
        customers.alias("customers"),
        F.coalesce(F.sum("f_outliers"), F.lit(0)).cast("long").alias("outliers"),
    )
    per_order = F.coalesce(F.try_divide("total_sales", "orders"), F.lit(0.0))
    return totals.withColumn("avg_order_value", per_order)


def kpi_cards(summary: DataFrame) -> DataFrame:
    """The summary as five lines of text; none when there are no orders."""

    def card(seq: int, heading: str, value: Column, sub: Column) -> Column:
        return F.struct(
            F.lit(seq).alias("seq"), F.lit(heading).alias("title"),
            value.alias("value"), sub.alias("sub"),
        )

    # The headings and sub-labels.
    cards = [
        card(1, "Total Revenue", money(F.col("total_sales")),
             F.concat(grouped(F.col("orders")), F.lit(" orders"))),
        card(2, "Total Profit", money(F.col("total_profit")),
             F.concat(percent(F.col("avg_margin")), F.lit(" margin"))),
        card(3, "Avg Order Value", money(F.col("avg_order_value")), F.lit("per transaction")),
        card(4, "Unique Customers", grouped(F.col("customers")), F.lit("active buyers")),
        card(5, "Outlier Orders", grouped(F.col("outliers")), F.lit("high-val spikes")),
    ]
    some = summary.filter(F.col("orders") > 0)
    return some.select(F.inline(F.array(*cards)))


# --- by month ----------------------------------------------------------------


def month_facts(fact_rows: DataFrame) -> DataFrame:
    """Exact sales and profit per month, the base of the three month metrics."""
    return _by(fact_rows, "year_month").agg(
        # A month with missing amounts only has the sum 0.
        F.coalesce(exact_sum("f_sales"), F.lit(0)).alias("exact_sales"),
        F.coalesce(exact_sum("f_profit"), F.lit(0)).alias("exact_profit"),
    )


def monthly_trend(months: DataFrame) -> DataFrame:
    return months.select(
        "year_month",
        F.col("exact_sales").cast("double").alias("sales"),
        F.col("exact_profit").cast("double").alias("profit"),
    ).orderBy("year_month")


def rolling_3m(months: DataFrame) -> DataFrame:
    """Mean over this and the two months before it that have rows."""
    frame = W.orderBy("year_month").rowsBetween(-2, W.currentRow)
    mean = F.sum("exact_sales").over(frame).cast("double") / F.count("*").over(frame)
    return months.select(
        "year_month", F.col("exact_sales").cast("double").alias("sales"), mean.alias("r3m")
    ).orderBy("year_month")


def mom_growth(months: DataFrame) -> DataFrame:
    """Growth in percent over the month before that has rows.

    From zero to something is infinite; from zero to zero there is no growth,
    and like the first month such a row is left out.
    """
    sales = F.col("sales")
    before = F.lag("sales").over(W.orderBy("year_month"))
    growth = (
        F.when(before != 0, (F.try_divide(sales, before) - 1) * 100)
        .when((before == 0) & (sales > 0), float("inf"))
        .when((before == 0) & (sales < 0), float("-inf"))
    )
    series = months.select("year_month", F.col("exact_sales").cast("double").alias("sales"))
    grown = series.withColumn("mom", growth)
    return grown.filter(F.col("mom").isNotNull()).orderBy("year_month")


def mom_growth_label(growth: DataFrame) -> DataFrame:
    shown = half_even(F.col("mom"), 1)
    return growth.select(
        "year_month",
        shown.alias("mom_shown"),
        signed_percent(shown).alias("mom_text"),
        F.when(F.col("mom") >= 0, "up").otherwise("down").alias("direction"),
    )


# --- by category, region, product -------------------------------------------


def category_sales(fact_rows: DataFrame) -> DataFrame:
    grouped_sales = _by(fact_rows, "category").agg(exact_total("f_sales").alias("sales"))
    return grouped_sales.orderBy("category")


def category_share(fact_rows: DataFrame) -> DataFrame:
    """Sales per category and their percentage of all of them."""
    sums = _by(fact_rows, "category").agg(
        F.coalesce(exact_sum("f_sales"), F.lit(0)).alias("exact_sales")
    )
    whole = F.sum("exact_sales").over(W.partitionBy()).cast("double")
    own = F.col("exact_sales").cast("double")
    return sums.select(
        "category", own.alias("sales"), (F.try_divide(own, whole) * 100).alias("share_pct")
    ).orderBy("category")


def region_perf(fact_rows: DataFrame) -> DataFrame:
    """Sales and profit per region, smallest sales first."""
    regions = _by(fact_rows, "region").agg(
        exact_total("f_sales").alias("sales"),
        exact_total("f_profit").alias("profit"),
    )
    return _numbered(regions, "sales", "region")


def top_products(fact_rows: DataFrame, n: int = TOP_PRODUCTS) -> DataFrame:
    """The n products of most sales, shown from the smallest up."""
    products = _by(fact_rows, "product").agg(exact_total("f_sales").alias("sales"))
    top = products.orderBy(F.desc("sales"), "product").limit(n)
    return _numbered(top, "sales", "product")


def top_products_label(top: DataFrame) -> DataFrame:
    return top.withColumn("sales_text", money(F.col("sales")))


# --- by tier, segment, discount band ----------------------------------------


def profit_tier_orders(fact_rows: DataFrame) -> DataFrame:
    tiers = _by(fact_rows, "profit_tier").agg(F.sum("f_orders").alias("orders"))
    rank = label_rank(F.col("profit_tier"), PROFIT_TIERS)
    return tiers.withColumn("tier_rank", rank).orderBy("tier_rank", "profit_tier")


def profit_tier_label(tiers: DataFrame) -> DataFrame:
    text = F.concat(F.col("orders").cast("string"), F.lit(" orders"))
    return tiers.withColumn("orders_text", text)


def segment_summary(fact_rows: DataFrame) -> DataFrame:
    """Distinct customers and revenue per segment."""
    return segment_panel(segment_facts(fact_rows))


def segment_panel(facts_by_segment: DataFrame) -> DataFrame:
    """``segment_summary`` from ``segment_facts``."""
    segments = _by(facts_by_segment, "customer_segment").agg(
        F.sum("customers").alias("customers"), exact_total("f_sales").alias("revenue")
    )
    rank = label_rank(F.col("customer_segment"), CUSTOMER_SEGMENTS)
    return segments.withColumn("segment_rank", rank).orderBy("segment_rank", "customer_segment")


def discount_impact(fact_rows: DataFrame) -> DataFrame:
    """Mean margin and orders per discount band that occurs."""
    bands = _by(fact_rows, "discount_band").agg(
        exact_mean("f_margin", "f_margins").alias("avg_margin"),
        F.sum("f_orders").alias("orders"),
    )
    rank = label_rank(F.col("discount_band"), DISCOUNT_BANDS)
    return bands.withColumn("band_rank", rank).orderBy("band_rank")


def discount_label(bands: DataFrame) -> DataFrame:
    shown = half_even(F.col("avg_margin"), 1)
    return bands.select(
        "discount_band", "band_rank", shown.alias("margin_shown"),
        signed_percent(shown).alias("margin_text"),
    )


# --- recent rows -------------------------------------------------------------


def recent_orders(rows: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    """The n latest rows, latest first, equal dates by order id."""
    latest = rows.select(*RECENT_COLUMNS).orderBy(F.desc("date"), "order_id").limit(n)
    return _numbered(latest, F.desc("date"), "order_id")


def recent_formatted(recent: DataFrame) -> DataFrame:
    return recent.withColumns(
        {
            "sales": money(F.col("sales")),
            "profit": money(F.col("profit")),
            "profit_margin_pct": percent(F.col("profit_margin_pct")),
            "date": day_month_year(F.col("date")),
        }
    )


def titled(df: DataFrame) -> DataFrame:
    """Columns renamed to their headings."""
    return df.toDF(*[title(name) for name in df.columns])


def records(df: DataFrame) -> Iterator[dict]:
    """Rows as name/value records, one partition at a time on the driver."""
    return (row.asDict() for row in df.toLocalIterator())
