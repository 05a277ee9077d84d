"""Right-closed bins and the order of their labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bin edges and labels of the three classifications.
PROFIT_TIERS = ("Loss", "Low", "Medium", "High")
PROFIT_TIER_EDGES = (None, 0, 15, 30, None)
CUSTOMER_SEGMENTS = ("One-time", "Returning", "Loyal")
CUSTOMER_SEGMENT_EDGES = (0, 3, 7, None)
DISCOUNT_BANDS = ("No Discount", "1-10%", "11-20%", "20%+")
DISCOUNT_BAND_EDGES = (-1, 0, 10, 20, 100)


def cut(value: Column, edges: Sequence[float | None], labels: Sequence[str]) -> Column:
    """Label of the bin ``(edge, next edge]`` that holds the value.

    ``None`` as first or last edge leaves that side open. A missing value and a
    value outside the edges have no label.
    """
    inside = value.isNotNull()
    if edges[0] is not None:
        inside = inside & (value > F.lit(float(edges[0])))
    label = None
    for upper, name in zip(edges[1:], labels, strict=True):
        fits = inside if upper is None else inside & (value <= F.lit(float(upper)))
        label = F.when(fits, name) if label is None else label.when(fits, name)
    return label


def profit_tier(margin_pct: Column) -> Column:
    return cut(margin_pct, PROFIT_TIER_EDGES, PROFIT_TIERS)


def customer_segment(orders: Column) -> Column:
    return cut(orders, CUSTOMER_SEGMENT_EDGES, CUSTOMER_SEGMENTS)


def discount_band(discount_pct: Column) -> Column:
    return cut(discount_pct, DISCOUNT_BAND_EDGES, DISCOUNT_BANDS)


def label_rank(label: Column, labels: Sequence[str]) -> Column:
    """1-based place of a label in its fixed order; unknown and NULL come last."""
    place = F.array_position(F.array(*[F.lit(name) for name in labels]), label)
    return F.when(place > 0, place).otherwise(len(labels) + 1).cast("int")
