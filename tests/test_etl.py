import pytest

from salesmart import SalesFilter, SalesMart, run_etl
from salesmart.fixtures.view import FIXTURE_CONFIG, FIXTURE_ORDER, RAW_COLUMNS, raw_sales
from salesmart.operators import metrics
from salesmart.operators.facts import facts
from salesmart.sinks import table as sinks
from salesmart.sinks.table import ensure_database
from salesmart.sources.table import SourceNotFound
from salesmart.storage import work_dir

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def loaded(spark):
    ensure_database(spark, "etl_db")
    raw = raw_sales(spark, SF_SMALL)
    report = run_etl(raw, "etl_db.sales", FIXTURE_ORDER, FIXTURE_CONFIG)
    return report, SalesMart(spark, "etl_db.sales")


def test_report(loaded):
    report, mart = loaded
    assert (report.rows_in, report.rows_clean, report.rows_dropped) == (6000, 713, 5287)
    assert report.issues[0] == "Dropped 4527 duplicate order_ids"
    assert report.issues[1].startswith("Nulls found: {'customer_id': ")
    assert "Dropped 260 unknown regions" in report.issues
    assert report.written.rows_read_back == 713 == mart.rows.count()
    assert report.audit["orders"] == 713
    assert report.audit_text["total_orders"] == "713"
    assert report.elapsed_s > 0


def test_table_columns(loaded):
    report, mart = loaded
    assert report.written.columns == len(mart.rows.columns)
    for name in (*RAW_COLUMNS, "profit_tier", "customer_segment", "is_outlier", "loaded_at"):
        assert name in mart.rows.columns


def test_errors_are_raised_again(spark, raw):
    with pytest.raises(ValueError, match="Missing columns"):
        run_etl(raw({}).drop("sales"), "etl_db.broken", ["line"])


def test_dashboard_matches_single_metrics(loaded):
    _, mart = loaded
    chosen = SalesFilter(region="ASIA")
    rows = mart.filtered(chosen)
    board = mart.dashboard(chosen)
    f = facts(rows)
    assert board["monthly"].collect() == metrics.monthly_trend(metrics.month_facts(f)).collect()
    assert board["region"].collect() == metrics.region_perf(f).collect()
    assert board["kpis"].collect() == metrics.kpi_cards(metrics.kpi_summary(f)).collect()
    assert board["products"].count() == 10 and board["recent"].count() == 20
    assert sum(row.orders for row in board["tier"].collect()) == rows.count()
    assert set(board.panels) == {
        "kpis", "monthly", "category", "rolling", "growth", "region", "products", "tier",
        "segment", "recent", "discount",
    }
    for panel in board.panels.values():
        assert panel.count() > 0
    board.close()


def test_empty_dashboard(loaded):
    _, mart = loaded
    board = mart.dashboard(SalesFilter(category="None such"))
    assert all(panel.count() == 0 for panel in board.panels.values())
    board.close()


def test_filters_reach_the_files(loaded):
    _, mart = loaded
    rows = mart.filtered(SalesFilter(year=1997, region="ASIA")).select("sales")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert "EqualTo(region,ASIA)" in plan
    assert "ReadSchema: struct<sales:double,region:string>" in plan


def test_refresh_sees_the_next_load(spark, loaded):
    _, mart = loaded
    ensure_database(spark, "etl_db2")
    raw = raw_sales(spark, SF_SMALL)
    run_etl(raw, "etl_db2.sales", FIXTURE_ORDER, FIXTURE_CONFIG)
    other = SalesMart(spark, "etl_db2.sales")
    assert other.rows.count() == 713
    run_etl(raw.filter("order_id < 100"), "etl_db2.sales", FIXTURE_ORDER, FIXTURE_CONFIG)
    other.refresh()
    assert 0 < other.rows.count() < 100
    assert other.options().count() > 5
    assert other.date_bounds().first().date_min is not None


@pytest.mark.parametrize("start, end", [("1996-02-15", "1996-06-30"), ("1996-12-20", "1997-01-05")])
def test_date_ranges_skip_years(loaded, start, end):
    _, mart = loaded
    rows = mart.filtered(SalesFilter(start=start, end=end))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    partition = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert f"year#" in partition and start[:4] in partition and end[:4] in partition
    plain = mart.rows.filter(f"date BETWEEN DATE'{start}' AND DATE'{end}'")
    assert 0 < rows.count() == plain.count()


def test_a_dashboard_reads_the_table_four_times(loaded):
    _, mart = loaded
    board = mart.dashboard(SalesFilter(year=1997))
    scans = sum(
        frame._jdf.queryExecution().executedPlan().toString().count("FileScan")
        for frame in (board["products"], board["recent"])
    )
    shared = [frame._jdf.queryExecution().withCachedData().toString() for frame in board.shared]
    assert scans == 2 and len(shared) == 2
    for name in ("kpis", "segment", "monthly", "category", "region", "tier", "discount", "growth"):
        assert "InMemoryRelation" in board[name]._jdf.queryExecution().executedPlan().toString()
    board.close()


def staged_folders(spark):
    place = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return {x.getPath().getName() for x in system.listStatus(place)} if system.exists(place) else set()


def test_nothing_staged_is_left(spark, raw):
    ensure_database(spark, "etl_db3")
    before = staged_folders(spark)
    run_etl(raw({}, {"order_id": "B"}), "etl_db3.sales", ["line"])
    assert staged_folders(spark) == before


def test_columns_of_a_feed_arrive_unchanged_and_in_place(spark, raw):
    ensure_database(spark, "etl_db4")
    feed = raw({}, {}, {"order_id": "B", "line": 3}).selectExpr(
        "7 AS copies", "*", "'yes' AS verdict", "1L AS missing_bits", "'text' AS f_note"
    )
    report = run_etl(feed, "etl_db4.sales", ["line"])
    assert (report.rows_in, report.rows_dropped) == (3, 1)
    table = spark.table("etl_db4.sales")
    assert [name for name in table.columns if name in feed.columns] == feed.columns
    assert {(r.copies, r.verdict, r.missing_bits, r.f_note) for r in table.collect()} == {(7, "yes", 1, "text")}
    board = SalesMart(spark, "etl_db4.sales").dashboard()
    assert board["monthly"].count() == 1
    board.close()
    with pytest.raises(ValueError, match="Reserved columns"):
        run_etl(raw({}).selectExpr("*", "1 AS __judge_copies"), "etl_db4.other", ["line"])


class Kept:
    """A sink that only remembers what it was given."""

    table = "kept"

    def write(self, rows, inspect):
        self.rows = rows.collect()
        inspect(rows)
        return sinks.WriteReport(self.table, len(rows.columns), len(self.rows), len(self.rows))


def test_any_sink_and_any_source(spark, raw, tmp_path):
    sink = Kept()
    report = run_etl(raw({}, {"order_id": "B"}), sink, ["line"])
    assert report.written.table == "kept" and len(sink.rows) == 2
    assert report.audit["orders"] == 2
    stored = spark.createDataFrame(sink.rows)
    assert SalesMart(spark, lambda _: stored).rows.count() == 2

    def gone(_):
        raise SourceNotFound("no database here")

    file = tmp_path / "a.csv"
    raw({}).drop("line").toPandas().to_csv(file, index=False)
    mart = SalesMart(spark, gone, str(file))
    assert mart.rows.first().customer_segment == "Returning"
    assert mart.dashboard()["kpis"].count() == 5
    with pytest.raises(SourceNotFound):
        SalesMart(spark, "no_such_table")


def test_amounts_too_fine_are_no_reason_to_lose_the_old_table(spark, raw):
    ensure_database(spark, "etl_db5")
    run_etl(raw({}), "etl_db5.sales", ["line"])
    with pytest.raises(Exception, match="more than 4 decimals"):
        run_etl(raw({"sales": 0.00004}), "etl_db5.sales", ["line"])
    assert spark.table("etl_db5.sales").first().sales == 10.0
    assert spark.sql("SHOW TABLES IN etl_db5 LIKE 'sales__v*'").count() == 1


@pytest.mark.parametrize("chosen", [
    SalesFilter(), SalesFilter(year=1997), SalesFilter(quarter=2, region="ASIA"),
    SalesFilter(category="SMALL", year=1996, quarter=1), SalesFilter(category="NONE SUCH"),
])
def test_panels_from_the_kept_cube_equal_those_from_the_rows(loaded, chosen):
    _, mart = loaded
    assert mart.kept is not None
    board = mart.dashboard(chosen)
    rows_only = SalesMart(mart.spark, lambda spark: spark.table("etl_db.sales"))
    assert rows_only.kept is None
    plain = rows_only.dashboard(chosen)
    assert "sales__cube_v" in board.shared[0]._jdf.queryExecution().logical().toString()
    for name in board.panels:
        assert board[name].collect() == plain[name].collect()
    board.close()
    plain.close()


@pytest.mark.parametrize("chosen", [
    SalesFilter(product="red widget"), SalesFilter(start="1996-02-15", end="1996-06-30"),
])
def test_filters_beyond_the_keys_read_the_rows(loaded, chosen):
    _, mart = loaded
    board = mart.dashboard(chosen)
    assert "cube_v" not in board.shared[0]._jdf.queryExecution().logical().toString()
    monthly = board["monthly"].collect()
    assert monthly == metrics.monthly_trend(metrics.month_facts(facts(mart.filtered(chosen)))).collect()
    board.close()


def test_approximate_customers(loaded):
    """Few customers are counted exactly; the panels then come from the cube alone."""
    _, mart = loaded
    for chosen in (SalesFilter(), SalesFilter(region="ASIA", quarter=3), SalesFilter(product="red widget")):
        board, exact = mart.dashboard(chosen, approximate=True), mart.dashboard(chosen)
        from_cube = not chosen.columns() or "product" not in chosen.columns()
        plans = [frame._jdf.queryExecution().logical().toString() for frame in board.shared]
        assert all(("cube_v" in plan) == from_cube for plan in plans)
        for name in board.panels:
            assert board[name].collect() == exact[name].collect()
        board.close()
        exact.close()


def test_the_cube_goes_with_its_version(spark, raw):
    ensure_database(spark, "cube_db")

    def names(like):
        return spark.sql(f"SHOW TABLES IN cube_db LIKE '{like}'").count()

    for n in (1, 2, 3):
        run_etl(raw(*[{"order_id": str(k)} for k in range(n)]), "cube_db.sales", ["line"])
        mart = SalesMart(spark, "cube_db.sales")
        assert mart.kept.first().n_rows == n == mart.rows.count()
    assert names("sales__v*") == names("sales__cube_v*") == 2
    with pytest.raises(RuntimeError, match="no cube"):
        sinks.replace_table(
            spark.table("cube_db.sales"), "cube_db.sales", keep={"cube": lambda _: (_ for _ in ()).throw(RuntimeError("no cube"))}
        )
    assert names("sales__v*") == names("sales__cube_v*") == 2
    assert SalesMart(spark, "cube_db.sales").kept.first().n_rows == 3
    plain = sinks.CatalogSink("cube_db.plain", clustered=False, cube=False)
    run_etl(raw({}), plain, ["line"])
    assert SalesMart(spark, "cube_db.plain").kept is None
    assert SalesMart(spark, "cube_db.plain").dashboard()["kpis"].count() == 5


def test_a_load_may_count_customers_by_a_sketch(spark, raw):
    ensure_database(spark, "sketch_db")
    feed = raw(*[{"order_id": str(n), "customer_id": f"c{n % 7}"} for n in range(20)])
    report = run_etl(feed, "sketch_db.sales", ["line"], approximate=True)
    assert report.audit["customers"] == 7


def rows_read(df):
    """Rows that the scan of a finished query has given on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    found = plan.collectLeaves()
    return sum(found.apply(n).metrics().apply("numOutputRows").value() for n in range(found.size()))


def test_point_and_date_filters_skip_row_groups(spark):
    """Of rows by day and product in turn, a filter on either reads a part."""
    from pyspark.sql import functions as F

    ensure_database(spark, "layout_db")
    rows = spark.range(200_000).select(
        F.col("id").cast("string").alias("order_id"), F.concat(F.lit("p"), F.hash("id") % 5000).alias("product"),
        F.concat(F.lit("c"), F.xxhash64("id") % 70_000).alias("customer_id"),
        F.date_add(F.lit("2024-01-01"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(366)).cast("int")).alias("date"),
    ).withColumn("year", F.year("date"))
    spark.conf.set("parquet.block.size", str(64 << 10))
    spark.conf.set("parquet.page.size", str(8 << 10))
    hadoop = spark._jsc.hadoopConfiguration()
    for key, value in (("parquet.block.size", 64 << 10), ("parquet.page.size", 8 << 10), ("parquet.block.size.row.check.min", 100)):
        hadoop.set(key, str(value))
    try:
        sinks.replace_table(rows, "layout_db.by_date", sort_by=["date"])
        sinks.replace_table(
            rows, "layout_db.mixed", sort_by=["date"], order=sinks.interleaved(), bloom=sinks.POINT_COLUMNS
        )
    finally:
        for key in ("parquet.block.size", "parquet.page.size", "parquet.block.size.row.check.min"):
            hadoop.unset(key)
        spark.conf.unset("parquet.block.size")
        spark.conf.unset("parquet.page.size")
    one = rows.first()
    for chosen in (f"product = '{one.product}'", f"customer_id = '{one.customer_id}'", "date BETWEEN DATE'2024-03-01' AND DATE'2024-03-20'"):
        mixed = spark.table("layout_db.mixed").filter(chosen)
        assert mixed.count() == rows.filter(chosen).count() > 0
        assert rows_read(mixed) < 200_000 / 3, chosen
    assert rows_read(spark.table("layout_db.by_date").filter(f"product = '{one.product}'")) > 200_000 / 3
