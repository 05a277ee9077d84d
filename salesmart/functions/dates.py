"""Date parsing and date parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def date_of(df: DataFrame, name: str, layout: str) -> Column:
    """A date column from text in one layout, or from a column already dated."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.try_to_date(F.col(name), layout)
    return F.col(name).cast("date")


DATE_PARTS = {
    "year": "year(date)",
    "month": "month(date)",
    "quarter": "quarter(date)",
    "month_name": "date_format(date, 'MMM')",
    "day_of_week": "date_format(date, 'EEEE')",
    "year_month": "date_format(date, 'yyyy-MM')",
}


def date_part(name: str) -> Column:
    """A part of the ``date`` column."""
    return F.expr(DATE_PARTS[name])


def iso_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def day_month_year(date: Column) -> Column:
    return F.date_format(date, "dd MMM yyyy")


def load_stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
