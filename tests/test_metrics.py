import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from salesmart.operators import audit, dimensions, enrich, metrics, quality
from salesmart.operators import facts as facts_module
from salesmart.operators.facts import cube, facts, with_discount_band
from salesmart.operators.filters import SalesFilter


def series(spark, *sales):
    """A month frame with exact sales, months 2024-01 onwards."""
    rows = [(f"2024-{n:02d}", float(x)) for n, x in enumerate(sales, start=1)]
    df = spark.createDataFrame(rows, "year_month string, sales double")
    return metrics.month_facts(facts(df.withColumn("profit", F.lit(1.0))))


def test_growth(spark):
    got = metrics.mom_growth(series(spark, 10, 0, 5, 0, 0, 7))
    assert [row.mom for row in got.collect()] == [-100.0, math.inf, -100.0, math.inf]
    label = metrics.mom_growth_label(got).collect()
    assert [row.mom_text for row in label] == ["-100.0%", "inf%", "-100.0%", "inf%"]
    assert [row.direction for row in label] == ["down", "up", "down", "up"]


def test_growth_skips_missing_months(spark):
    rows = [("2024-01", 10.0), ("2024-05", 15.0)]
    df = spark.createDataFrame(rows, "year_month string, sales double")
    got = metrics.mom_growth(metrics.month_facts(facts(df.withColumn("profit", F.lit(1.0)))))
    assert [(row.year_month, row.mom) for row in got.collect()] == [("2024-05", 50.0)]


def test_rolling_mean(spark):
    rows = [("2024-01", 1.0), ("2024-02", 2.0), ("2024-04", 4.0), ("2024-05", 9.0)]
    df = spark.createDataFrame(rows, "year_month string, sales double")
    months = metrics.month_facts(facts(df.withColumn("profit", F.lit(1.0))))
    assert [row.r3m for row in metrics.rolling_3m(months).collect()] == [1.0, 1.5, 7 / 3, 5.0]


def test_top_products_tie_keeps_product_order(spark):
    rows = [("d", 2.0), ("c", 2.0), ("b", 1.0), ("a", 2.0)]
    df = facts(spark.createDataFrame(rows, "product string, sales double"))
    got = metrics.top_products(df, 2).collect()
    assert [(row["product"], row.pos) for row in got] == [("a", 1), ("c", 2)]


def test_region_order_and_share(spark):
    rows = [("x", "East", 1.0, 1.0), ("y", "North", 3.0, -1.0), ("x", None, 4.0, 1.0)]
    df = facts(spark.createDataFrame(rows, "category string, region string, sales double, profit double"))
    assert [row.region for row in metrics.region_perf(df).collect()] == ["East", "North"]
    share = {row.category: row.share_pct for row in metrics.category_share(df).collect()}
    assert share == {"x": 62.5, "y": 37.5}


def test_discount_bands_need_the_column(spark):
    with pytest.raises(ValueError, match="discount_pct"):
        with_discount_band(spark.createDataFrame([(1,)], "x int"))


@pytest.fixture
def sales(raw):
    changes = []
    for n in range(60):
        changes.append(
            {
                "order_id": f"o{n:02d}", "customer_id": f"c{n % 7}", "product": f"p{n % 13}",
                "category": ("Books", "Sports", "Clothing")[n % 3],
                "region": ("North", "South", "East", "West")[n % 4],
                "sales": 10.0 + n * 1.1, "profit": n * 0.7 - 9.0,
                "date": f"2024-{n % 5 + 1:02d}-{n % 27 + 1:02d}",
                "discount_pct": (None, 0.0, 5.0, 15.0, 50.0)[n % 5],
            }
        )
    return enrich.enrich(quality.validate(raw(*changes), ["line"])).cache()


PANELS = {
    "monthly": lambda f: metrics.monthly_trend(metrics.month_facts(f)),
    "rolling": lambda f: metrics.rolling_3m(metrics.month_facts(f)),
    "growth": lambda f: metrics.mom_growth(metrics.month_facts(f)),
    "category": metrics.category_sales,
    "share": metrics.category_share,
    "region": metrics.region_perf,
    "tier": metrics.profit_tier_orders,
    "discount": metrics.discount_impact,
}


@pytest.mark.parametrize("panel", PANELS)
def test_cube_and_rows_give_the_same(sales, panel):
    rows = facts(with_discount_band(sales))
    build = PANELS[panel]
    assert build(cube(rows)).collect() == build(rows).collect()


def test_totals_add_up(sales):
    f = facts(with_discount_band(sales))
    kpi = metrics.kpi_summary(f).first()
    assert kpi.orders == 60 and kpi.customers == 7
    assert kpi.avg_order_value == kpi.total_sales / 60
    months = metrics.monthly_trend(metrics.month_facts(f)).collect()
    assert math.isclose(sum(row.sales for row in months), kpi.total_sales)
    assert sum(row.orders for row in metrics.profit_tier_orders(f).collect()) == 60
    assert sum(row.orders for row in metrics.discount_impact(f).collect()) == 48
    assert math.isclose(sum(row.share_pct for row in metrics.category_share(f).collect()), 100)
    segments = metrics.segment_summary(f).collect()
    assert sum(row.customers for row in segments) == 7
    assert math.isclose(sum(row.revenue for row in segments), kpi.total_sales)


def test_order_of_labels(sales):
    f = facts(with_discount_band(sales))
    tiers = [row.profit_tier for row in metrics.profit_tier_orders(f).collect()]
    assert tiers == [name for name in ("Loss", "Low", "Medium", "High") if name in tiers]
    bands = [row.discount_band for row in metrics.discount_impact(f).collect()]
    assert bands == ["No Discount", "1-10%", "11-20%", "20%+"]
    labels = metrics.profit_tier_label(metrics.profit_tier_orders(f)).collect()
    assert all(row.orders_text == f"{row.orders} orders" for row in labels)


def test_recent_rows(sales):
    recent = metrics.recent_orders(sales)
    got = recent.collect()
    expected = sorted(
        ((row.date, row.order_id) for row in sales.collect()),
        key=lambda pair: (-pair[0].toordinal(), pair[1]),
    )[:20]
    assert [(row.date, row.order_id) for row in got] == expected
    assert recent.columns == [*metrics.RECENT_COLUMNS, "pos"]
    first = metrics.recent_formatted(recent).first()
    assert first.date == got[0].date.strftime("%d %b %Y")
    assert first.profit_margin_pct == f"{got[0].profit_margin_pct:.1f}%"
    titled = metrics.titled(recent)
    assert titled.columns[:3] == ["Order Id", "Customer Id", "Product"]
    assert next(metrics.records(titled))["Order Id"] == got[0].order_id


def test_kpi_cards(sales):
    cards = metrics.kpi_cards(metrics.kpi_summary(facts(sales))).collect()
    assert [row.title for row in cards] == [
        "Total Revenue", "Total Profit", "Avg Order Value", "Unique Customers", "Outlier Orders",
    ]
    assert cards[0].sub == "60 orders" and cards[3].value == "7"


def test_empty_filter_gives_empty_panels(sales):
    rows = facts(with_discount_band(SalesFilter(category="None such").apply(sales)))
    kpi = metrics.kpi_summary(rows).first()
    assert (kpi.total_sales, kpi.orders, kpi.avg_order_value, kpi.outliers) == (0.0, 0, 0.0, 0)
    assert kpi.avg_margin is None
    assert metrics.kpi_cards(metrics.kpi_summary(rows)).count() == 0
    for build in PANELS.values():
        assert build(rows).count() == 0
        assert build(cube(rows)).count() == 0


@pytest.mark.parametrize(
    ("conditions", "keep"),
    [
        ({"year": "2024"}, lambda r: True),
        ({"year": 2023}, lambda r: False),
        ({"quarter": "2"}, lambda r: r.quarter == 2),
        ({"category": "Books"}, lambda r: r.category == "Books"),
        ({"product": "p3"}, lambda r: r["product"] == "p3"),
        ({"region": "East"}, lambda r: r.region == "East"),
        ({"start": "2024-02-10"}, lambda r: True),
        ({"start": "2024-02-10", "end": "2024-03-05"},
         lambda r: date(2024, 2, 10) <= r.date <= date(2024, 3, 5)),
        ({"start": "2024-02-10T12:00:00", "end": "2024-03-05T12:00:00"},
         lambda r: date(2024, 2, 11) <= r.date <= date(2024, 3, 5)),
        ({"category": "Books", "region": "East", "quarter": 1},
         lambda r: r.category == "Books" and r.region == "East" and r.quarter == 1),
    ],
)
def test_filters(sales, conditions, keep):
    got = {row.order_id for row in SalesFilter(**conditions).apply(sales).collect()}
    assert got == {row.order_id for row in sales.collect() if keep(row)}


def test_dimensions(sales):
    assert [row.region for row in dimensions.distinct_values(sales, "region").collect()] == [
        "East", "North", "South", "West",
    ]
    options = {tuple(row)[2:] for row in dimensions.filter_options(sales).collect()}
    assert ("year", "All Years", "all") in options
    assert ("quarter", "Q2", "2") in options
    assert len(options) == 5 + 1 + 2 + 3 + 13 + 4
    bounds = dimensions.date_bounds(sales).first()
    assert bounds.date_min == date(2024, 1, 1)


def test_audit(sales):
    summary = audit.audit_summary(sales)
    row = summary.first()
    assert (row.orders, row.customers, row.categories) == (60, 7, 3)
    text = audit.audit_formatted(summary).first()
    assert text.total_orders == "60"
    assert text.total_sales == f"INR {row.total_sales:,.0f}"
    assert text.date_range == f"{row.date_min} to {row.date_max}"


def test_top_list_needs_no_full_sort(sales):
    plan = metrics.top_products(facts(sales))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_a_month_of_missing_sales_is_zero(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES ('2024-01', 10D, 1D), ('2024-02', CAST(NULL AS DOUBLE), NULL), "
        "('2024-03', 5D, 1D) AS t(year_month, sales, profit)"
    )
    months = metrics.month_facts(facts(rows))
    assert [r.sales for r in metrics.monthly_trend(months).collect()] == [10.0, 0.0, 5.0]
    assert [r.r3m for r in metrics.rolling_3m(months).collect()] == [10.0, 5.0, 5.0]
    assert [r.mom for r in metrics.mom_growth(months).collect()] == [-100.0, float("inf")]
    shares = rows.selectExpr("year_month AS category", "sales")
    got = {r.category: r.sales for r in metrics.category_share(facts(shares)).collect()}
    assert got["2024-02"] == 0.0


def test_options_come_in_order(spark):
    from salesmart.operators.dimensions import filter_options

    rows = spark.sql(
        "SELECT * FROM VALUES (2024, 2, 'B', 'q', 'South'), (2023, 1, 'A', 'p', 'North'), "
        "(2024, 1, 'A', NULL, 'North') AS t(year, quarter, category, product, region)"
    )
    got = [(r.filter, r.label) for r in filter_options(rows).collect()]
    assert got == [
        ("year", "All Years"), ("year", "2023"), ("year", "2024"),
        ("quarter", "All Quarters"), ("quarter", "Q1"), ("quarter", "Q2"),
        ("category", "All Categories"), ("category", "A"), ("category", "B"),
        ("product", "All Products"), ("product", "p"), ("product", "q"),
        ("region", "All Regions"), ("region", "North"), ("region", "South"),
    ]


def test_facts_are_those_made_here(spark):
    rows = spark.sql("SELECT 'A' AS category, 1.5D AS sales, 'note' AS f_note")
    assert cube(facts(rows), ["category"]).columns == ["category", "f_sales_high", "f_sales_low", "f_sales_fraction"]
    with pytest.raises(ValueError, match="f_sales_low"):
        facts(rows.selectExpr("*", "1 AS f_sales_low"))


def test_sketched_customers_are_within_the_documented_error(spark):
    rows = spark.range(300_000, numPartitions=5).selectExpr("concat('c', id % 100000) AS customer_id", "id % 3 AS k")
    whole = rows.agg(facts_module.customers_sketched().alias("n")).first().n
    assert abs(whole / 100_000 - 1) < 3 * facts_module.SKETCH_ERROR
    # Sketches of parts merge to that of the whole.
    parts = rows.groupBy("k").agg(
        F.hll_sketch_agg("customer_id", F.lit(facts_module.SKETCH_LOG_K)).alias("s")
    )
    merged = parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("n")).first().n
    assert abs(merged / 100_000 - 1) < 3 * facts_module.SKETCH_ERROR
    assert rows.limit(0).agg(facts_module.customers_sketched().alias("n")).first().n == 0
