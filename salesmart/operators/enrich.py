"""Derived columns of clean order rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.config import SalesConfig
from salesmart.functions.bins import customer_segment, profit_tier
from salesmart.functions.dates import DATE_PARTS, date_part
from salesmart.functions.numeric import half_even, mean_and_deviation, moment_parts, moment_sums

# The derived columns in table order, each with the row columns it is made from.
DERIVED = {
    "year": ("date",),
    "month": ("date",),
    "quarter": ("date",),
    "month_name": ("date",),
    "day_of_week": ("date",),
    "profit_margin_pct": ("profit", "sales"),
    "revenue_per_unit": ("sales", "quantity"),
    "profit_tier": ("profit", "sales"),
    "customer_segment": ("customer_id", "order_id"),
    "is_outlier": ("sales",),
    "year_month": ("date",),
}

# A customer is handled apart when it has more than this many rows and more
# than one in HOT_SHARE of all rows. Fewer than HOT_SHARE customers can.
HOT_SHARE = 100_000
HOT_FLOOR = 10_000
# Decimals of amounts unless a feed says otherwise.
MONEY = SalesConfig().money_places
# Places over which the rows of such a customer are spread in a shuffle.
SPREAD = 65_536


def margin_pct() -> Column:
    return half_even(F.try_divide("profit", "sales") * 100, 2)


def revenue_per_unit() -> Column:
    return half_even(F.try_divide("sales", "quantity"), 2)


BUILDERS = {
    "profit_margin_pct": margin_pct,
    "revenue_per_unit": revenue_per_unit,
    # The tier looks at the margin after rounding.
    "profit_tier": lambda: profit_tier(margin_pct()),
    "customer_segment": lambda: customer_segment(F.col("_customer_orders")),
}


def customer_counts(rows: DataFrame) -> DataFrame:
    """Orders and rows per customer; rows without a customer are left out."""
    return (
        rows.filter(F.col("customer_id").isNotNull())
        .groupBy(F.col("customer_id").alias("_customer"))
        .agg(F.count("order_id").alias("_orders"), F.count("*").alias("_rows"))
    )


def customer_orders(
    rows: DataFrame,
    counts: DataFrame | None = None,
    name: str = "customer_orders",
    hot_share: int = HOT_SHARE,
    hot_floor: int = HOT_FLOOR,
    total: int | None = None,
) -> DataFrame:
    """Each row with its customer's number of orders; NULL without a customer.

    Counts are made once per customer and joined back instead of using a window
    over whole customers. Customers above a share of all rows are few by
    arithmetic; their counts are broadcast and their rows are spread evenly over
    the shuffle of the other rows, where they match nothing.

    The rows are read more than once: hand in a table or a staged copy. With
    staged ``customer_counts`` as well, Spark knows their size and leaves the
    rows where they are when all counts are small enough to broadcast.
    """
    counts = customer_counts(rows) if counts is None else counts
    total = rows.agg(F.count("*")).scalar() if total is None else F.lit(total)
    is_hot = (F.col("_rows") > hot_floor) & (F.col("_rows") * hot_share > total)
    hot = counts.filter(is_hot).select(
        F.col("_customer").alias("_hot_customer"), F.col("_orders").alias("_hot_orders")
    )
    # Always 0, but not a literal: that would drop out of the join key. Made from
    # a count that the list above also needs, so both share one aggregation.
    everyone = counts.select(
        "_customer", "_orders", F.when(F.col("_rows") > 0, 0).otherwise(1).alias("_spread")
    )
    marked = rows.join(F.broadcast(hot), F.col("customer_id") == F.col("_hot_customer"), "left")
    settled = F.col("_hot_customer").isNotNull() | F.col("customer_id").isNull()
    place = F.when(settled, F.pmod(F.xxhash64("order_id"), F.lit(SPREAD)) + 1).otherwise(0)
    marked = marked.withColumn("_place", place.cast("int"))
    joined = marked.join(
        everyone,
        (F.col("customer_id") == F.col("_customer")) & (F.col("_place") == F.col("_spread")),
        "left",
    )
    return joined.select(*rows.columns, F.coalesce("_hot_orders", "_orders").alias(name))


def sales_stats(rows: DataFrame, column: str = "sales", places: int = MONEY) -> DataFrame:
    """Mean and sample standard deviation as one row; missing values are left out.

    They are made from exact sums of values, rounded to ``places`` decimals, and
    of their squares, in one pass over one column: the same rows give the same
    bits whatever their order and partitioning.
    """
    units, parts = moment_parts(column, places, "v")
    mean, deviation, steps = mean_and_deviation("v", places)
    sums = rows.selectExpr(*units).selectExpr(*parts).agg(*moment_sums("v"))
    for step in steps:
        sums = sums.selectExpr("*", step)
    return sums.selectExpr(f"{mean} AS mean_value", f"{deviation} AS sd_value")


def outlier_flag(rows: DataFrame, column: str = "sales", places: int = MONEY) -> Column:
    """1 where the value lies above mean + 3 standard deviations, else 0.

    The limit is a one-row subquery over the same rows; over a single row there
    is no deviation and the flag is 0. The limit has the same bits on every run,
    so a value on it is never flagged by one run and not by the next.
    """
    stats = sales_stats(rows, column, places)
    limit = stats.select(F.col("mean_value") + 3 * F.col("sd_value")).scalar()
    return F.coalesce((F.col(column) > limit).cast("int"), F.lit(0))


def enrich(
    rows: DataFrame,
    only: Iterable[str] = tuple(DERIVED),
    counts: DataFrame | None = None,
    total: int | None = None,
) -> DataFrame:
    """Clean rows with their derived columns, by default all of them.

    ``customer_segment`` and ``is_outlier`` depend on all rows and read them
    again: hand in a staged copy when asking for these, and staged
    ``customer_counts`` and the number of rows, where known, for the first.
    """
    wanted = [name for name in DERIVED if name in set(only)]
    segmented = "customer_segment" in wanted
    counted = customer_orders(rows, counts, "_customer_orders", total=total) if segmented else rows

    def column(name: str) -> Column:
        if name in DATE_PARTS:
            return date_part(name)
        if name == "is_outlier":
            return outlier_flag(rows)
        return BUILDERS[name]()

    return counted.select(*rows.columns, *[column(name).alias(name) for name in wanted])


def enrich_reduced(rows: DataFrame) -> DataFrame:
    """The smaller set of columns for rows that no quality rule has seen."""
    return rows.withColumns(
        {
            "year": date_part("year"),
            "month": date_part("month"),
            "quarter": date_part("quarter"),
            "month_name": date_part("month_name"),
            "profit_margin_pct": margin_pct(),
            "year_month": date_part("year_month"),
            "is_outlier": outlier_flag(rows),
            "profit_tier": F.lit("Medium"),
            "customer_segment": F.lit("Returning"),
        }
    )
