from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salesmart.functions import bins, dates, numeric, text


def values(spark, column, items, kind="double"):
    df = spark.createDataFrame([(n, item) for n, item in enumerate(items)], f"n int, x {kind}")
    return [row.y for row in df.select("n", column(F.col("x")).alias("y")).orderBy("n").collect()]


def test_half_even(spark):
    got = values(spark, lambda x: numeric.half_even(x, 2), [0.125, 2.675, 0.015, -0.125, None])
    assert got == [0.12, 2.68, 0.02, -0.12, None]


def test_number_from_text(spark):
    texts = ["12", " 12 ", "-1.5e2", "12d", "12f", "0x1p3", "abc", "inf", "NaN", "1e999", None]
    got = values(spark, numeric.number_from_text, texts, "string")
    assert got == [12.0, 12.0, -150.0] + [None] * 8


def test_finite(spark):
    assert values(spark, numeric.finite, [1.0, float("nan"), float("inf"), float("-inf")]) == [
        1.0, None, None, None,
    ]


def test_profit_tier_edges(spark):
    assert values(spark, bins.profit_tier, [-5.0, 0.0, 0.01, 15.0, 15.01, 30.0, 30.01, None]) == [
        "Loss", "Loss", "Low", "Low", "Medium", "Medium", "High", None,
    ]


def test_segment_edges(spark):
    assert values(spark, bins.customer_segment, [0, 1, 3, 4, 7, 8, None], "bigint") == [
        None, "One-time", "One-time", "Returning", "Returning", "Loyal", None,
    ]


def test_discount_band_edges(spark):
    edges = [-1.0, -0.5, -0.0, 0.0, 0.5, 10.0, 10.5, 20.0, 100.0, 100.5, None]
    assert values(spark, bins.discount_band, edges) == [
        None, "No Discount", "No Discount", "No Discount", "1-10%", "1-10%",
        "11-20%", "11-20%", "20%+", None, None,
    ]


def test_label_rank_puts_unknown_last(spark):
    got = values(
        spark, lambda x: bins.label_rank(x, bins.PROFIT_TIERS), ["Loss", "High", "?", None], "string"
    )
    assert got == [1, 4, 5, 5]


def test_money(spark):
    amounts = [12345.5, 99999.6, 100000.0, 125000.0, 1e7, -500000.4, 12.0, None, float("inf")]
    assert values(spark, text.money, amounts) == [
        "Rs 12,346", "Rs 100,000", "Rs 1.0L", "Rs 1.2L", "Rs 1.0Cr", "Rs -500,000",
        "Rs 12", None, None,
    ]


@pytest.mark.parametrize("amount", [0.5, 1.5, 2.5, 999.5, 1e5 - 0.5, 150000.0, 2.5e6, 1.25e8, -0.4])
def test_money_rounds_like_python(spark, amount):
    if amount >= 1e7:
        expected = f"Rs {amount / 1e7:.1f}Cr"
    elif amount >= 1e5:
        expected = f"Rs {amount / 1e5:.1f}L"
    else:
        expected = f"Rs {amount:,.0f}"
    assert values(spark, text.money, [amount]) == [expected]


def test_percent_rounds_like_python(spark):
    amounts = [0.25, 0.35, 12.25, -3.05, 0.0, 99.95]
    assert values(spark, text.percent, amounts) == [f"{x:.1f}%" for x in amounts]
    assert values(spark, text.signed_percent, [float("inf"), float("-inf"), 1.5]) == [
        "inf%", "-inf%", "1.5%",
    ]


def test_grouped_and_title(spark):
    assert values(spark, text.grouped, [1234567, 12], "bigint") == ["1,234,567", "12"]
    assert text.title("profit_tier") == "Profit Tier"


def test_dates(spark):
    df = spark.createDataFrame(
        [("2024-01-05",), ("05/01/2024",), ("2024-02-30",), ("",)], "date string"
    )
    got = [row.d for row in df.select(dates.date_of(df, "date", "yyyy-MM-dd").alias("d")).collect()]
    assert got == [date(2024, 1, 5), None, None, None]


def test_date_parts(spark):
    df = spark.sql("SELECT DATE'2024-01-05' AS date")
    row = df.select(*[dates.date_part(name).alias(name) for name in dates.DATE_PARTS]).first()
    assert row.asDict() == {
        "year": 2024, "month": 1, "quarter": 1, "month_name": "Jan", "day_of_week": "Friday",
        "year_month": "2024-01",
    }
    shown = df.select(dates.iso_text(F.col("date")), dates.day_month_year(F.col("date"))).first()
    assert tuple(shown) == ("2024-01-05", "05 Jan 2024")


def exact(spark, amounts, places=4):
    df = spark.createDataFrame([(x,) for x in amounts], "x double")
    return df.selectExpr(*numeric.exact_parts("x", places, "f")).agg(
        numeric.exact_sum("f").alias("s"), numeric.exact_total("f").alias("t")
    ).first()


def test_exact_sum_in_parts(spark):
    amounts = [0.1, -0.1, 0.2, 1e11 + 0.0001, -7.77, -1e11, 123456.7891, None, -0.0001]
    expected = sum(Decimal(str(round(x, 4))) for x in amounts if x is not None)
    assert exact(spark, amounts).s == expected
    assert tuple(exact(spark, [])) == (None, 0.0)


def test_exact_sum_has_room(spark):
    """The total would not fit one long of ten-thousandths, nor would one amount."""
    assert exact(spark, [9e11] * 2000).t == 1.8e15
    assert exact(spark, [1e15, 1e15, -1e15, 0.25, -1e18, 1e18]).t == 1e15 + 0.25
    assert exact(spark, [-0.0001, -1e15, 1e15, -2.5]).s == Decimal("-2.5001")


def test_decimals_are_never_cut(spark):
    assert exact(spark, [0.00004] * 1000, places=5).t == 0.04
    with pytest.raises(Exception, match="more than 4 decimals"):
        exact(spark, [0.00004] * 1000)
    with pytest.raises(ValueError):
        numeric.exact_parts("x", 9, "f")
