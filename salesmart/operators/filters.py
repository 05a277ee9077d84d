"""Optional filters over enriched rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "all"


def _first_day(value: str | date) -> date:
    """First whole day not before the given moment."""
    moment = datetime.fromisoformat(value) if isinstance(value, str) else value
    if not isinstance(moment, datetime):
        return moment
    day = moment.date()
    return day if moment.time() == time.min else day + timedelta(days=1)


def _last_day(value: str | date) -> date:
    moment = datetime.fromisoformat(value) if isinstance(value, str) else value
    return moment.date() if isinstance(moment, datetime) else moment


@dataclass(frozen=True)
class SalesFilter:
    """Six optional conditions; ``all`` leaves one out.

    The date range is inclusive and counts only when both ends are given.
    """

    year: int | str = ALL
    quarter: int | str = ALL
    category: str = ALL
    product: str = ALL
    region: str = ALL
    start: str | date | None = None
    end: str | date | None = None

    def conditions(self) -> list[Column]:
        chosen = []
        for name in ("year", "quarter"):
            value = getattr(self, name)
            if value != ALL:
                chosen.append(F.col(name) == int(value))
        for name in ("category", "product", "region"):
            value = getattr(self, name)
            if value != ALL:
                chosen.append(F.col(name) == value)
        if self.start and self.end:
            first, last = _first_day(self.start), _last_day(self.end)
            chosen.append(F.col("date").between(F.lit(first), F.lit(last)))
        return chosen

    def columns(self) -> list[str]:
        """The columns that its conditions look at."""
        names = ("year", "quarter", "category", "product", "region")
        dates = ["date"] if self.start and self.end else []
        return [name for name in names if getattr(self, name) != ALL] + dates

    def years(self) -> Column | None:
        """What a date range says about ``year``: it lets whole partitions be skipped."""
        if self.start and self.end:
            first, last = _first_day(self.start), _last_day(self.end)
            return F.col("year").between(first.year, last.year)
        return None

    def apply(self, df: DataFrame) -> DataFrame:
        for condition in self.conditions():
            df = df.filter(condition)
        years = self.years()
        return df if years is None or "year" not in df.columns else df.filter(years)
