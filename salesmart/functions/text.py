"""Display text of numbers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One crore and one lakh.
CRORE = 10_000_000.0
LAKH = 100_000.0


def one_decimal(value: Column) -> Column:
    # The Python wrapper of format_number takes no pattern, the SQL function does.
    return F.call_function("format_number", value.cast("double"), F.lit("0.0"))


def grouped(value: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(value, 0)


def money(value: Column) -> Column:
    """Compact rupee text: crores, lakhs, or a grouped whole number."""
    x = value.cast("double")
    shown = (
        F.when(x >= CRORE, F.concat(one_decimal(x / CRORE), F.lit("Cr")))
        .when(x >= LAKH, F.concat(one_decimal(x / LAKH), F.lit("L")))
        .otherwise(grouped(x))
    )
    # Neither NaN nor an infinity is below infinity.
    return F.when(F.abs(x) < float("inf"), F.concat(F.lit("Rs "), shown))


def percent(value: Column) -> Column:
    return F.concat(one_decimal(value), F.lit("%"))


def signed_percent(value: Column) -> Column:
    """Percent text of a rounded value that may be infinite."""
    return (
        F.when(value == float("inf"), "inf%")
        .when(value == float("-inf"), "-inf%")
        .otherwise(percent(value))
    )


def title(name: str) -> str:
    """Heading of a column: ``profit_tier`` reads ``Profit Tier``."""
    return name.replace("_", " ").title()
