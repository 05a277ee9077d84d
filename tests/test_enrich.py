import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from salesmart.operators import enrich, quality
from salesmart.storage import stage


def clean(raw, *changes):
    return quality.validate(raw(*changes), ["line"])


def test_all_columns_in_table_order(raw):
    rows = clean(raw, {})
    row = enrich.enrich(rows).first().asDict()
    assert list(row)[len(rows.columns):] == list(enrich.DERIVED)
    assert row["profit_margin_pct"] == 40.0
    assert row["revenue_per_unit"] == 5.0
    assert row["profit_tier"] == "High"
    assert row["customer_segment"] == "One-time"
    assert row["is_outlier"] == 0


def test_tier_uses_the_rounded_margin(raw):
    rows = clean(raw, {"sales": 100.0, "profit": 0.004})
    row = enrich.enrich(rows, only=["profit_margin_pct", "profit_tier"]).first()
    assert (row.profit_margin_pct, row.profit_tier) == (0.0, "Loss")


def test_only_wanted_columns_are_made(raw):
    rows = clean(raw, {})
    assert enrich.enrich(rows, only=["year", "quarter"]).columns == [
        *rows.columns, "year", "quarter",
    ]


def test_segments_follow_orders_per_customer(raw):
    changes = [
        {"order_id": f"{customer}{n}", "customer_id": customer}
        for customer, orders in (("c1", 1), ("c3", 3), ("c4", 4), ("c7", 7), ("c8", 8))
        for n in range(orders)
    ]
    got = enrich.enrich(clean(raw, *changes), only=["customer_segment"])
    assert {(row.customer_id, row.customer_segment) for row in got.collect()} == {
        ("c1", "One-time"), ("c3", "One-time"), ("c4", "Returning"), ("c7", "Returning"),
        ("c8", "Loyal"),
    }


def skewed(spark):
    """A third of the rows with one customer, a sixth with none."""
    customer = (
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 6 = 1 THEN NULL "
        "ELSE concat('c', id % 500) END AS customer_id"
    )
    return stage(spark.range(30_000).selectExpr("id AS order_id", customer), "skewed").rows


def expected_counts(rows):
    counts = rows.filter("customer_id IS NOT NULL").groupBy("customer_id").count()
    return {row.customer_id: row["count"] for row in counts.collect()}


def test_customer_orders_with_and_without_hot_customers(spark):
    rows = skewed(spark)
    truth = expected_counts(rows)
    # No customer is hot, one is, all are.
    for share, floor in ((100_000, 10_000), (10, 100), (100_000, 0)):
        staged = stage(enrich.customer_counts(rows), "customers").rows if share == 10 else None
        got = enrich.customer_orders(rows, staged, hot_share=share, hot_floor=floor)
        assert got.count() == rows.count()
        wrong = [
            row for row in got.distinct().collect()
            if row.customer_orders != truth.get(row.customer_id)
        ]
        assert wrong == []


def test_hot_customer_is_spread_and_counts_are_shared(spark):
    rows = skewed(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = enrich.customer_orders(rows, hot_share=10, hot_floor=100)
        sizes = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
        joined = enrich.customer_orders(rows, hot_share=10, hot_floor=100)
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4
    assert max(row["count"] for row in sizes) < 1.3 * 30_000 / 4
    assert "ReusedExchange" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_outliers_lie_above_three_deviations(spark):
    rows = spark.range(101).selectExpr("id", "IF(id = 100, 1000.0D, double(id % 2)) AS sales")
    got = rows.withColumn("flag", enrich.outlier_flag(rows)).filter("flag = 1").collect()
    assert [row.id for row in got] == [100]


def test_reduced_enrichment_keeps_unseen_rows(raw):
    df = raw({"date": "2024-01-05"}, {"sales": 0.0, "order_id": "B"})
    df = df.withColumn("date", F.to_date("date"))
    rows = {row.order_id: row for row in enrich.enrich_reduced(df).collect()}
    assert rows["A"].month_name == "Jan" and rows["A"].profit_tier == "Medium"
    assert rows["B"].profit_margin_pct is None
    assert rows["B"].customer_segment == "Returning"


def stats_of(spark, values, parts, places=4):
    rows = spark.createDataFrame([(v,) for v in values], "sales double").repartition(parts)
    return tuple(enrich.sales_stats(rows, places=places).first())


def test_moments_have_the_same_bits_under_any_partitioning(spark):
    """Also the flag of a value that lies right on the limit."""
    draw = random.Random(5)
    values = [round(draw.lognormvariate(4, 2), 4) for _ in range(3000)] + [1e9 + 0.1, -7.25]
    seen = set()
    for parts in (1, 7, 211):
        draw.shuffle(values)
        seen.add(stats_of(spark, values, parts))
    assert len(seen) == 1
    exact = [Fraction(round(v * 10**4), 10**4) for v in values]
    mean = sum(exact) / len(exact)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in exact) / (len(exact) - 1))
    ((got_mean, got_deviation),) = seen
    assert math.isclose(got_mean, mean, rel_tol=1e-15) and math.isclose(got_deviation, deviation, rel_tol=1e-14)


def test_a_value_on_the_limit_is_flagged_alike_by_every_run(spark):
    """Sums of doubles give limits on both sides of it."""
    values = [0.1, 0.2, 0.3, 0.7] * 500
    for _ in range(3):
        mean, deviation = stats_of(spark, [*values, 2.0], 1)
        values.append(round(mean + 3 * deviation, 4))
    flags = set()
    for parts in (1, 7, 211):
        rows = spark.createDataFrame([(v,) for v in [*values, 2.0]], "sales double").repartition(parts)
        flagged = rows.withColumn("f", enrich.outlier_flag(rows)).filter("f = 1")
        flags.add(tuple(sorted(r.sales for r in flagged.collect())))
    assert len(flags) == 1


def test_moments_far_from_zero_lose_nothing(spark):
    values = [1e11 + n * 0.0001 for n in range(5)]
    mean, deviation = stats_of(spark, values, 2)
    assert math.isclose(mean, 1e11 + 0.0002, rel_tol=1e-15)
    assert math.isclose(deviation, 0.0001 * math.sqrt(2.5), rel_tol=1e-9)
    assert stats_of(spark, [5.0] * 9, 3) == (5.0, 0.0)


def test_moments_of_few_and_missing_values(spark):
    assert stats_of(spark, [], 1) == (None, None)
    assert stats_of(spark, [None, 3.5], 2) == (3.5, None)
    assert stats_of(spark, [0.00004, -0.00004, 0.123456789], 1) == stats_of(spark, [0.0, 0.0, 0.1235], 1)
    assert math.isclose(stats_of(spark, [2.5, 3.5, 1e-8], 1, places=8)[0], 6.00000001 / 3, rel_tol=1e-15)
    with pytest.raises(Exception, match="too large for 4 decimals"):
        stats_of(spark, [1e15], 1)
    with pytest.raises(Exception, match="(?i)38|overflow|range"):
        stats_of(spark, [4e14] * 11, 1)
