"""One query per operator over the fixture feed."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.fixtures.view import (
    FIXTURE_CONFIG,
    FIXTURE_ORDER,
    RAW_COLUMNS,
    raw_sales,
    read,
)
from salesmart.functions.dates import date_of, iso_text
from salesmart.functions.layout import interleaved
from salesmart.functions.text import money, percent
from salesmart.operators import dimensions, metrics, quality
from salesmart.operators.audit import audit_formatted, audit_summary
from salesmart.operators.enrich import (
    DERIVED,
    customer_counts,
    customer_orders,
    enrich,
    outlier_flag,
    sales_stats,
)
from salesmart.operators.facts import SKETCH_ERROR, facts, with_discount_band
from salesmart.operators.filters import SalesFilter
from salesmart.plans.etl import run_etl, stamped
from salesmart.plans.mart import SalesMart
from salesmart.sinks.table import POINT_COLUMNS, ensure_database, replace_table, with_text_date
from salesmart.sources.csv import read_csv_dated, scan_csv
from salesmart.sources.table import read_table
from salesmart.storage import fresh_path, stage, work_dir

Query = Callable[[SparkSession, str], DataFrame]
SCRATCH = "salesmart_scratch"
FILTERED = ("order_id", "customer_id", "product", "category", "region", "date", "sales", "profit")

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__.rstrip("_")] = build
    return build


# --- shared inputs -----------------------------------------------------------


def after(spark: SparkSession, sf_dir: str, rules: int) -> DataFrame:
    """Rows left by the deduplication and the first so many rules."""
    raw = raw_sales(spark, sf_dir)
    rows = quality.validate(raw, FIXTURE_ORDER, FIXTURE_CONFIG, quality.RULES[:rules])
    return rows.select(*RAW_COLUMNS)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return after(spark, sf_dir, len(quality.RULES))


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Enriched rows with just these columns.

    The two columns that depend on all rows read their input more than once, so
    the clean rows, cut to what is needed, are staged before them.
    """
    derived = [name for name in columns if name in DERIVED]
    given = [name for name in columns if name not in DERIVED]
    rows, counts = clean(spark, sf_dir), None
    if {"customer_segment", "is_outlier"} & set(derived):
        inputs = {name for column in derived for name in DERIVED[column]} | set(given)
        rows = stage(rows.select(*[name for name in RAW_COLUMNS if name in inputs]), "clean").rows
    if "customer_segment" in derived:
        counts = stage(customer_counts(rows), "customers").rows
    return enrich(rows, derived, counts).select(*columns)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = dict.fromkeys((*FIXTURE_CONFIG.required, *FIXTURE_ORDER))
    raw = raw_sales(spark, sf_dir).select(*needed)
    return quality.judge(raw, FIXTURE_ORDER, FIXTURE_CONFIG)


def scratch_table(spark: SparkSession) -> str:
    ensure_database(spark, SCRATCH, f"{work_dir(spark)}/{SCRATCH}")
    return f"{SCRATCH}.t_{uuid.uuid4().hex}"


def csv_copy(spark: SparkSession, sf_dir: str) -> str:
    """The raw feed written as CSV files; their folder."""
    path = fresh_path(spark, "csv")
    raw_sales(spark, sf_dir).select(*RAW_COLUMNS).write.option("header", True).csv(path)
    return path


# --- sources and sinks -------------------------------------------------------


@query
def src_csv_scan(spark, sf_dir):
    return read_csv_dated(spark, csv_copy(spark, sf_dir), FIXTURE_CONFIG)


@query
def src_csv_feed(spark, sf_dir):
    """A load straight from CSV files: one scan, checked before anything is shown."""
    path = fresh_path(spark, "csv")
    # Rows of an order share a file, in the order of the fixture.
    placed = raw_sales(spark, sf_dir).repartition("order_id").sortWithinPartitions(
        "order_id", *FIXTURE_ORDER
    )
    placed.select(*RAW_COLUMNS).write.option("header", True).csv(path)
    table = scratch_table(spark)
    run_etl(scan_csv(spark, path, FIXTURE_CONFIG), table, config=FIXTURE_CONFIG)
    ids = {name: F.col(name).cast("long") for name in ("order_id", "customer_id")}
    numbers = {"discount_pct": F.col("discount_pct").cast("double")}
    return spark.table(table).drop("loaded_at").withColumns(ids | numbers)


@query
def src_table_scan(spark, sf_dir):
    table = scratch_table(spark)
    rows = with_text_date(sales(spark, sf_dir, *RAW_COLUMNS, "year", "year_month"))
    replace_table(rows, table)
    return read_table(spark, table)


@query
def src_fallback(spark, sf_dir):
    return SalesMart(
        spark, f"{SCRATCH}.no_such_table", csv_copy(spark, sf_dir), FIXTURE_CONFIG
    ).rows


@query
def sink_table_replace(spark, sf_dir):
    table = scratch_table(spark)
    derived = ("year", "quarter", "year_month", "profit_margin_pct")
    replace_table(sales(spark, sf_dir, *RAW_COLUMNS, *derived), table)
    return spark.table(table)


@query
def sink_row_count(spark, sf_dir):
    table = scratch_table(spark)
    report = replace_table(sales(spark, sf_dir, *RAW_COLUMNS, "year"), table)
    return spark.table(table).agg(
        F.lit(report.rows_written).cast("long").alias("rows_written"),
        F.count("*").alias("rows_read_back"),
    )


# --- data quality ------------------------------------------------------------


@query
def dq_dedup_first(spark, sf_dir):
    return after(spark, sf_dir, 0)


@query
def dq_null_profile(spark, sf_dir):
    return quality.null_profile(after(spark, sf_dir, 0), FIXTURE_CONFIG)


@query
def dq_drop_nulls(spark, sf_dir):
    return after(spark, sf_dir, 1)


@query
def dq_positive_numeric(spark, sf_dir):
    return after(spark, sf_dir, 2)


@query
def dq_category_domain(spark, sf_dir):
    return after(spark, sf_dir, 3)


@query
def dq_region_domain(spark, sf_dir):
    return after(spark, sf_dir, 4)


@query
def dq_date_parse(spark, sf_dir):
    rows = after(spark, sf_dir, 4)
    parsed = date_of(rows, "date", FIXTURE_CONFIG.date_format)
    return rows.select(
        "order_id", F.col("date").alias("date_text"), parsed.alias("date"),
        parsed.isNull().alias("is_bad"),
    )


@query
def dq_issue_report(spark, sf_dir):
    return quality.issues(quality.tally(judged(spark, sf_dir), FIXTURE_CONFIG), FIXTURE_CONFIG)


@query
def dq_row_totals(spark, sf_dir):
    return quality.row_totals(quality.tally(judged(spark, sf_dir), FIXTURE_CONFIG))


@query
def dq_validate(spark, sf_dir):
    return clean(spark, sf_dir)


# --- enrichment --------------------------------------------------------------


@query
def tx_date_parts(spark, sf_dir):
    parts = ("year", "month", "quarter", "month_name", "day_of_week", "year_month")
    rows = sales(spark, sf_dir, "order_id", "date", *parts)
    return rows.select("order_id", *parts, iso_text(F.col("date")).alias("date_text"))


@query
def tx_ratios(spark, sf_dir):
    return sales(spark, sf_dir, "order_id", "profit_margin_pct", "revenue_per_unit")


@query
def tx_profit_tier(spark, sf_dir):
    return sales(spark, sf_dir, "order_id", "profit_margin_pct", "profit_tier")


@query
def tx_customer_orders(spark, sf_dir):
    rows = stage(clean(spark, sf_dir).select("order_id", "customer_id"), "clean").rows
    return customer_orders(rows, stage(customer_counts(rows), "customers").rows)


@query
def tx_customer_segment(spark, sf_dir):
    return sales(spark, sf_dir, "order_id", "customer_id", "customer_segment")


@query
def tx_sales_stats(spark, sf_dir):
    stats = sales_stats(read(spark, sf_dir, "events"), "value")
    # Last digits depend on the order of addition.
    return stats.select(*[F.round(name, 4).alias(name) for name in stats.columns])


@query
def tx_outlier_flag(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "value")
    return events.withColumn("is_outlier", outlier_flag(events, "value"))


@query
def tx_load_stamp(spark, sf_dir):
    began = F.lit(datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None))
    stamp = F.col("loaded_at")
    return stamped(clean(spark, sf_dir).select("order_id")).select(
        "order_id",
        F.length(stamp).alias("stamp_length"),
        stamp.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$").alias("is_stamp"),
        # The clock of the query, not earlier than when it was built.
        (F.to_timestamp_ntz(stamp, F.lit("yyyy-MM-dd HH:mm:ss")) >= began).alias("is_now"),
    )


@query
def tx_enrich(spark, sf_dir):
    return sales(spark, sf_dir, *RAW_COLUMNS, *DERIVED)


# --- audit -------------------------------------------------------------------


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(
        spark, sf_dir, "customer_id", "sales", "profit", "profit_margin_pct",
        "date", "is_outlier", "category",
    )


@query
def audit_summary_(spark, sf_dir):
    return audit_summary(audit_rows(spark, sf_dir))


@query
def audit_formatted_(spark, sf_dir):
    return audit_formatted(audit_summary(audit_rows(spark, sf_dir)))


# --- dimensions --------------------------------------------------------------


@query
def dim_years(spark, sf_dir):
    return dimensions.distinct_values(sales(spark, sf_dir, "year"), "year")


@query
def dim_categories(spark, sf_dir):
    return dimensions.distinct_values(sales(spark, sf_dir, "category"), "category")


@query
def dim_regions(spark, sf_dir):
    return dimensions.distinct_values(sales(spark, sf_dir, "region"), "region")


@query
def dim_products(spark, sf_dir):
    return dimensions.distinct_values(sales(spark, sf_dir, "product"), "product")


@query
def dim_quarters(spark, sf_dir):
    return dimensions.distinct_values(sales(spark, sf_dir, "quarter"), "quarter")


@query
def dim_date_bounds(spark, sf_dir):
    return dimensions.date_bounds(sales(spark, sf_dir, "date"))


@query
def dim_filter_options(spark, sf_dir):
    return dimensions.filter_options(sales(spark, sf_dir, *dimensions.FILTERS))


# --- filters -----------------------------------------------------------------


def chosen(spark: SparkSession, sf_dir: str, **conditions) -> DataFrame:
    rows = sales(spark, sf_dir, *FILTERED, "year", "quarter")
    return SalesFilter(**conditions).apply(rows).select(*FILTERED)


@query
def flt_year(spark, sf_dir):
    return chosen(spark, sf_dir, year="1997")


@query
def flt_quarter(spark, sf_dir):
    return chosen(spark, sf_dir, quarter=2)


@query
def flt_category(spark, sf_dir):
    return chosen(spark, sf_dir, category="SMALL")


@query
def flt_product(spark, sf_dir):
    return chosen(spark, sf_dir, product="red widget")


@query
def flt_product_clustered(spark, sf_dir):
    """One product of a table whose files are skipped by day and by product."""
    table = scratch_table(spark)
    replace_table(
        sales(spark, sf_dir, *FILTERED, "year"), table, sort_by=["date"], order=interleaved(),
        bloom=POINT_COLUMNS,
    )
    return SalesFilter(product="hot rod").apply(spark.table(table)).select(*FILTERED)


@query
def flt_region(spark, sf_dir):
    return chosen(spark, sf_dir, region="ASIA")


@query
def flt_date_range(spark, sf_dir):
    """Over the table by year, of which the range skips whole parts."""
    table = scratch_table(spark)
    replace_table(sales(spark, sf_dir, *FILTERED, "year"), table, sort_by=["date"])
    chosen_dates = SalesFilter(start="1996-02-15", end="1997-06-30")
    return chosen_dates.apply(spark.table(table)).select(*FILTERED)


@query
def flt_combined(spark, sf_dir):
    return chosen(
        spark, sf_dir, year=1997, quarter=2, category="SMALL", region="ASIA",
        start="1997-04-10", end="1997-06-20",
    )


KPI_INPUTS = ("customer_id", "sales", "profit", "profit_margin_pct", "is_outlier")


@query
def flt_empty(spark, sf_dir):
    rows = SalesFilter(category="NONE SUCH").apply(sales(spark, sf_dir, *KPI_INPUTS, "category"))
    return metrics.kpi_summary(facts(rows))


# --- headline figures --------------------------------------------------------


@query
def kpi_summary(spark, sf_dir):
    return metrics.kpi_summary(facts(sales(spark, sf_dir, *KPI_INPUTS)))


@query
def kpi_sketch(spark, sf_dir):
    """The headline figures with sketched customers, held against the exact count."""
    fact_rows = facts(sales(spark, sf_dir, *KPI_INPUTS))
    exact = fact_rows.agg(F.count_distinct("customer_id").alias("n")).scalar()
    summary = metrics.kpi_summary(fact_rows, approximate=True)
    off = F.abs(F.col("customers") - exact)
    return summary.withColumn("customers", off <= 3 * SKETCH_ERROR * exact).withColumnRenamed(
        "customers", "customers_within_error"
    )


@query
def kpi_cards(spark, sf_dir):
    return metrics.kpi_cards(metrics.kpi_summary(facts(sales(spark, sf_dir, *KPI_INPUTS))))


# --- metrics -----------------------------------------------------------------


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.month_facts(facts(sales(spark, sf_dir, "year_month", "sales", "profit")))


def by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(sales(spark, sf_dir, "category", "sales"))


def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_products(facts(sales(spark, sf_dir, "product", "sales")))


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.profit_tier_orders(facts(sales(spark, sf_dir, "order_id", "profit_tier")))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sales(spark, sf_dir, "order_id", "discount_pct", "profit_margin_pct")
    return metrics.discount_impact(facts(with_discount_band(rows)))


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recent_orders(sales(spark, sf_dir, *metrics.RECENT_COLUMNS))


@query
def m_monthly_trend(spark, sf_dir):
    return metrics.monthly_trend(months(spark, sf_dir))


@query
def m_category_sales(spark, sf_dir):
    return metrics.category_sales(by_category(spark, sf_dir))


@query
def m_category_share(spark, sf_dir):
    return metrics.category_share(by_category(spark, sf_dir))


@query
def m_rolling_3m(spark, sf_dir):
    return metrics.rolling_3m(months(spark, sf_dir))


@query
def m_mom_growth(spark, sf_dir):
    return metrics.mom_growth(months(spark, sf_dir))


@query
def m_mom_growth_label(spark, sf_dir):
    return metrics.mom_growth_label(metrics.mom_growth(months(spark, sf_dir)))


@query
def m_region_perf(spark, sf_dir):
    return metrics.region_perf(facts(sales(spark, sf_dir, "region", "sales", "profit")))


@query
def m_top_products(spark, sf_dir):
    return top(spark, sf_dir)


@query
def m_top_products_label(spark, sf_dir):
    return metrics.top_products_label(top(spark, sf_dir))


@query
def m_profit_tier(spark, sf_dir):
    return tiers(spark, sf_dir)


@query
def m_profit_tier_label(spark, sf_dir):
    return metrics.profit_tier_label(tiers(spark, sf_dir))


@query
def m_segment(spark, sf_dir):
    rows = sales(spark, sf_dir, "customer_id", "sales", "customer_segment")
    return metrics.segment_summary(facts(rows))


@query
def m_discount_band(spark, sf_dir):
    return with_discount_band(sales(spark, sf_dir, "order_id", "discount_pct"))


@query
def m_discount_impact(spark, sf_dir):
    return bands(spark, sf_dir)


@query
def m_discount_label(spark, sf_dir):
    return metrics.discount_label(bands(spark, sf_dir))


@query
def m_recent_orders(spark, sf_dir):
    return recent(spark, sf_dir)


@query
def m_recent_formatted(spark, sf_dir):
    return metrics.recent_formatted(recent(spark, sf_dir))


# --- display -----------------------------------------------------------------


@query
def fx_money(spark, sf_dir):
    return clean(spark, sf_dir).select(
        "order_id",
        money(F.col("sales")).alias("sales_text"),
        money(F.col("profit")).alias("profit_text"),
        money(F.col("sales") * 1000).alias("thousandfold_text"),
    )


@query
def fx_percent(spark, sf_dir):
    rows = sales(spark, sf_dir, "order_id", "profit_margin_pct")
    return rows.select("order_id", percent(F.col("profit_margin_pct")).alias("margin_text"))


@query
def fx_title_columns(spark, sf_dir):
    return metrics.titled(
        sales(spark, sf_dir, "order_id", "profit_margin_pct", "profit_tier", "year_month")
    )


# --- the load run and the dashboard as they are used -------------------------


def load(spark: SparkSession, sf_dir: str):
    table = scratch_table(spark)
    return table, run_etl(raw_sales(spark, sf_dir), table, FIXTURE_ORDER, FIXTURE_CONFIG)


@query
def etl_run(spark, sf_dir):
    table, _ = load(spark, sf_dir)
    return spark.table(table).drop("loaded_at", *FIXTURE_ORDER)


@query
def etl_report(spark, sf_dir):
    """The lines of the report, with the place, name and count of each rule."""
    _, report = load(spark, sf_dir)
    return spark.createDataFrame(report.lines, "seq int, rule string, n long, message string")


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, _ = load(spark, sf_dir)
    return SalesMart(spark, table, config=FIXTURE_CONFIG).dashboard(SalesFilter(year=1997))[name]


@query
def dash_monthly(spark, sf_dir):
    return panel(spark, sf_dir, "monthly")


@query
def dash_category(spark, sf_dir):
    return panel(spark, sf_dir, "category")


@query
def dash_kpis(spark, sf_dir):
    return panel(spark, sf_dir, "kpis")


@query
def dash_discount(spark, sf_dir):
    return panel(spark, sf_dir, "discount")


@query
def dash_region_cube(spark, sf_dir):
    """A panel whose filter asks for keys of the kept cube only: no row is read."""
    table, _ = load(spark, sf_dir)
    mart = SalesMart(spark, table, config=FIXTURE_CONFIG)
    return mart.dashboard(SalesFilter(quarter=2, category="SMALL"))["region"]
