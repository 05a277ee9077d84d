"""Settings of one sales feed: columns, allowed values, formats."""

from __future__ import annotations

from dataclasses import dataclass

# The columns every feed must have, and the default domains.
REQUIRED_COLUMNS = (
    "order_id", "customer_id", "product", "category", "quantity",
    "unit_price", "sales", "profit", "date", "region",
)
CATEGORIES = ("Electronics", "Clothing", "Home & Kitchen", "Books", "Sports")
REGIONS = ("North", "South", "East", "West", "Central")


@dataclass(frozen=True)
class SalesConfig:
    """What a feed must look like to be accepted.

    ``numeric`` columns are read as doubles when present; ``positive`` ones must
    also be above zero. ``date_format`` is the one accepted layout of ``date``.
    Amounts have at most ``money_places`` decimals and percentages
    ``percent_places``, up to 8; sums raise an error where one has more.
    """

    required: tuple[str, ...] = REQUIRED_COLUMNS
    numeric: tuple[str, ...] = ("quantity", "unit_price", "sales", "profit", "discount_pct")
    positive: tuple[str, ...] = ("sales", "quantity", "unit_price")
    categories: tuple[str, ...] = CATEGORIES
    regions: tuple[str, ...] = REGIONS
    date_format: str = "yyyy-MM-dd"
    money_places: int = 4
    percent_places: int = 2
