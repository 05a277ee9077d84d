"""Additive facts: what the metrics add up, from rows or from a small cube."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.config import SalesConfig
from salesmart.functions.bins import discount_band
from salesmart.functions.numeric import exact_parts

# Keys of small, bounded domain by which most panels are grouped.
CUBE_KEYS = ("year_month", "category", "region", "profit_tier", "discount_band")
# Those of a cube that is kept with a table: filters can be asked of it too. Year
# and quarter follow from the month, so they make no more rows.
KEPT_KEYS = ("year", "quarter", *CUBE_KEYS, "customer_segment")
# Columns of a kept cube beside keys and facts: its rows, and who bought.
ROWS, SKETCH = "n_rows", "customer_sketch"
# Size of a sketch of customers: 2^14 registers. The standard error of its count is
# 1.04 / sqrt(2^14), 0.8 %; some thousand customers are still counted exactly.
SKETCH_LOG_K = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LOG_K / 2)


def _builders(config: SalesConfig) -> dict[str, list[str]]:
    """Facts by the row column they come from; amounts are in parts each."""
    money, percent = config.money_places, config.percent_places
    return {
        "sales": exact_parts("sales", money, "f_sales"),
        "profit": exact_parts("profit", money, "f_profit"),
        "profit_margin_pct": [
            *exact_parts("profit_margin_pct", percent, "f_margin"),
            "bigint(profit_margin_pct IS NOT NULL) AS f_margins",
        ],
        "order_id": ["bigint(order_id IS NOT NULL) AS f_orders"],
        "is_outlier": ["bigint(is_outlier) AS f_outliers"],
    }


# The names of all facts; a feed has no such columns.
FACT_NAMES = tuple(
    text.rsplit(" AS ", 1)[1] for texts in _builders(SalesConfig()).values() for text in texts
)


def with_discount_band(rows: DataFrame) -> DataFrame:
    if "discount_pct" not in rows.columns:
        raise ValueError("Missing columns: ['discount_pct'] (needed for discount bands)")
    return rows.withColumn("discount_band", discount_band(F.col("discount_pct")))


def facts(rows: DataFrame, config: SalesConfig = SalesConfig()) -> DataFrame:
    """Rows with additive fact columns, for those inputs that are there.

    Facts are whole numbers, so metrics come out the same from rows and from any
    pre-aggregation of them. A feed's own column of a fact's name is an error.
    """
    present = set(rows.columns)
    taken = sorted(present & set(FACT_NAMES))
    if taken:
        raise ValueError(f"Columns with names of facts: {taken}")
    made = [text for name, texts in _builders(config).items() if name in present for text in texts]
    return rows.selectExpr("*", *made)


def customers_sketched(column: str = "customer_id") -> Column:
    """Distinct values counted by a sketch: every task sends a few kilobytes, where
    an exact count shuffles every distinct value. Off by ``SKETCH_ERROR``."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.col(column).cast("string"), F.lit(SKETCH_LOG_K)))


def kept_cube(rows: DataFrame, config: SalesConfig = SalesConfig()) -> DataFrame:
    """Enriched rows as the cube that is written beside their table.

    It has the facts, the number of rows, and a sketch of the customers per
    combination of keys: sketches merge where counts of distinct customers do not
    add up. Without ``discount_pct`` there is no key for its bands.
    """
    fact_rows = facts(rows, config)
    keys = [key for key in KEPT_KEYS if key != "discount_band" or "discount_pct" in rows.columns]
    banded = with_discount_band(fact_rows) if "discount_band" in keys else fact_rows
    sums = [F.sum(name).alias(name) for name in fact_rows.columns if name in FACT_NAMES]
    sketch = F.hll_sketch_agg(F.col("customer_id").cast("string"), F.lit(SKETCH_LOG_K))
    return banded.groupBy(*keys).agg(*sums, F.count("*").alias(ROWS), sketch.alias(SKETCH))


def cube(fact_rows: DataFrame, keys: Sequence[str] = CUBE_KEYS) -> DataFrame:
    """Facts summed per combination of keys: one scan that feeds many metrics."""
    present = [name for name in fact_rows.columns if name in FACT_NAMES]
    return fact_rows.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in present])
