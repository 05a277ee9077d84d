import pytest
from pyspark.sql import functions as F

from conftest import GOOD
from salesmart.operators import quality
from salesmart.sinks import table as sinks
from salesmart.sources import csv as csv_source
from salesmart.sources import table as sources
from salesmart.storage import fresh_path, quoted, stage

HEADER = "order_id,customer_id,product,category,quantity,unit_price,sales,profit,date,region,note\n"


def line(order_id, product="pen", sales="10", date="2024-01-05", note="x"):
    return f"{order_id},c1,{product},Books,2,5.0,{sales},4,{date},North,{note}\n"


def test_missing_path_raises(spark):
    with pytest.raises(csv_source.SourceNotFound, match="no-such-file"):
        csv_source.read_csv(spark, "/tmp/no-such-file.csv")


def test_missing_tokens_and_text(spark, tmp_path):
    tokens = ["", "NA", "N/A", "null", "NULL", "None", "nan", "<NA>", "#N/A", '""']
    kept = ["-", "?", "NaT", " n"]
    file = tmp_path / "a.csv"
    file.write_text(HEADER + "".join(line(f"o{n}", text) for n, text in enumerate(tokens + kept)))
    rows = csv_source.read_csv(spark, str(file)).orderBy("_ingest_row").collect()
    assert [row["product"] for row in rows] == [None] * len(tokens) + kept
    assert rows[0].sales == 10.0 and rows[0].date == "2024-01-05" and rows[0].note == "x"


def test_quotes_follow_the_doubled_form(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text(HEADER + line("o1", '"a ""b"", c"'))
    assert csv_source.read_csv(spark, str(file)).first()["product"] == 'a "b", c'


def test_first_row_follows_file_order(spark, tmp_path):
    """A later, larger file is read first by Spark but does not come first."""
    (tmp_path / "part-1.csv").write_text(HEADER + line("A", "first") + line("A", "second"))
    many = "".join(line("A", f"late{n}") for n in range(5000))
    (tmp_path / "part-2.csv").write_text(HEADER + many + line("B"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = csv_source.read_csv(spark, str(tmp_path))
        assert raw.rdd.getNumPartitions() > 4
        got = {row.order_id: row["product"] for row in quality.validate(raw).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {"A": "first", "B": "pen"}


def test_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + line("A"))
    (tmp_path / "b.csv").write_text(HEADER.replace("order_id,customer_id", "customer_id,order_id"))
    with pytest.raises(Exception, match="(?i)header"):
        csv_source.read_csv(spark, str(tmp_path)).collect()


def test_dated_scan(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text(HEADER + line("A") + line("B", date="2024-02-30"))
    rows = {row.order_id: row.date for row in csv_source.read_csv_dated(spark, str(file)).collect()}
    assert str(rows["A"]) == "2024-01-05" and rows["B"] is None


def test_fallback_only_when_the_table_is_missing(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text(HEADER + line("A"))
    got = sources.read_or_fallback(spark, "no_such_sales", str(file)).first()
    assert got.profit_tier == "Medium" and got.year_month == "2024-01"
    spark.sql("CREATE DATABASE IF NOT EXISTS fallback_db")
    spark.sql("CREATE TABLE fallback_db.sales USING parquet AS SELECT '2024-03-01' AS date")
    got = sources.read_or_fallback(spark, "fallback_db.sales", str(file))
    assert got.columns == ["date"] and str(got.first().date) == "2024-03-01"


def test_replace_table(spark, raw):
    sinks.ensure_database(spark, "sink_db")
    sinks.ensure_database(spark, "sink_db")
    rows = raw(*[{"order_id": f"o{n}"} for n in range(40)]).withColumn("year", F.col("line") % 3)
    report = sinks.replace_table(rows, "sink_db.sales")
    assert (report.rows_written, report.rows_read_back) == (40, 40)
    assert spark.table("sink_db.sales").count() == 40
    # The new rows may be made from the table being replaced.
    half = spark.table("sink_db.sales").filter("line % 2 = 0")
    assert sinks.replace_table(half, "sink_db.sales").rows_read_back == 20
    assert sinks.replace_table(rows.limit(5), "sink_db.sales").rows_written == 5
    assert spark.table("sink_db.sales").count() == 5
    versions = spark.sql("SHOW TABLES IN sink_db LIKE 'sales__v*'").count()
    assert versions == 2
    pruned = spark.table("sink_db.sales").filter("year = 1")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_failed_write_keeps_the_old_rows(spark, raw):
    sinks.ensure_database(spark, "sink_db2")
    rows = raw({}).withColumn("year", F.lit(2024))
    sinks.replace_table(rows, "sink_db2.sales")
    broken = rows.withColumn("sales", F.raise_error(F.lit("boom")).cast("double"))
    with pytest.raises(Exception, match="boom"):
        sinks.replace_table(broken, "sink_db2.sales")
    assert spark.table("sink_db2.sales").count() == 1


def test_names_are_checked():
    assert quoted("db.sales") == "`db`.`sales`"
    for bad in ("sales; DROP TABLE x", "a`b", "", "a..b", "1a"):
        with pytest.raises(ValueError):
            quoted(bad)


def test_jdbc_options():
    target = sources.JdbcTarget("jdbc:mysql://host/db", "me", "secret", driver="some.Driver")
    assert "secret" not in repr(target)
    split = sources.JdbcSplit("order_no", "1", "1000", 16)
    read = sources.jdbc_read_options(target, "sales", split)
    assert read["dbtable"] == "sales" and read["numPartitions"] == "16"
    assert read["partitionColumn"] == "order_no" and read["connectTimeout"] == "10000"
    write = sinks.jdbc_write_options(target, "sales", 4)
    assert write["batchsize"] == "500" and write["driver"] == "some.Driver"
    assert read["fetchsize"] == "10000"
    with pytest.raises(ValueError):
        sources.jdbc_read_options(target, "sales where 1=1", split)
    with pytest.raises(TypeError):
        sources.jdbc_read_options(target, "sales")
    alone = sources.jdbc_read_options(target, "sales", sources.SingleConnection())
    assert alone["numPartitions"] == "1" and "partitionColumn" not in alone
    count = sinks.jdbc_count_options(target, "sales")
    assert count["query"] == "SELECT COUNT(*) AS n FROM sales" and "dbtable" not in count


def test_text_date(raw):
    rows = quality.validate(raw({}), ["line"])
    assert sinks.with_text_date(rows).first().date == GOOD["date"]


def test_stage_reads_back_and_releases(spark, raw):
    rows = raw({}, {"order_id": "B"})
    staged = stage(rows, "t")
    assert staged.rows.orderBy("line").collect() == rows.orderBy("line").collect()
    staged.release()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(staged.path)
    staged.release()
    assert fresh_path(spark, "t") != fresh_path(spark, "t")


def test_work_dir_is_the_one_of_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is not None:
        assert fresh_path(spark, "t").startswith(configured)


@pytest.mark.parametrize("check_first", [True, False])
def test_malformed_records_are_errors(spark, tmp_path, check_first):
    def read(text, **more):
        file = tmp_path / f"f{len(list(tmp_path.iterdir()))}.csv"
        file.write_text(HEADER + text)
        rows = csv_source.read_csv(spark, str(file), check_first=check_first, **more)
        return rows.select("order_id", "note").collect()

    with pytest.raises(Exception, match="(?i)too many fields|malformed"):
        read(line("A") + line("B").strip() + ",11,12\n")
    with pytest.raises(Exception, match="(?i)open quote|malformed"):
        read(line("A") + line("C", '"multi\nline"'))
    got = read(line("C", '"multi\nline"') + line("D"), multi_line=True)
    assert [row.order_id for row in got] == ["C", "D"]
    # Short records are filled, and quotes and commas inside quotes are no faults.
    got = read("A,c1,pen\n" + line("B", '"a, ""b"", c,,,,,,,,,,,"') + line("E", 'size 5"'))
    assert [row.order_id for row in got] == ["A", "B", "E"] and got[0].note is None


def test_the_error_names_file_and_count(spark, tmp_path):
    (tmp_path / "good.csv").write_text(HEADER + line("A"))
    (tmp_path / "bad.csv").write_text(HEADER + (line("B").strip() + ",x\n") * 3)
    with pytest.raises(csv_source.MalformedCsv, match=r"bad\.csv: 3"):
        csv_source.read_csv_dated(spark, str(tmp_path))


def test_tables_of_others_are_left_alone(spark, raw):
    sinks.ensure_database(spark, "own_db")
    for other in ("sales__v1_backup", "sales__vat", "sales__v20240101000000000000_0123abcd"):
        spark.sql(f"CREATE TABLE own_db.{other} USING parquet AS SELECT 1 AS x")
    rows = raw({}).withColumn("year", F.lit(2024))
    for _ in range(3):
        sinks.replace_table(rows, "own_db.sales")
    names = {row.tableName for row in spark.sql("SHOW TABLES IN own_db").collect()}
    assert {"sales__v1_backup", "sales__vat", "sales__v20240101000000000000_0123abcd"} <= names
    # The view, the three above, the version shown and the one before.
    assert len(names) == 6


def test_a_table_of_that_name_is_refused_before_writing(spark, raw):
    sinks.ensure_database(spark, "taken_db")
    spark.sql("CREATE TABLE taken_db.sales USING parquet AS SELECT 1 AS x")
    spark.sql("CREATE VIEW taken_db.seen AS SELECT 1 AS x")
    rows = raw({}).withColumn("year", F.lit(2024))
    for name in ("taken_db.sales", "taken_db.seen"):
        with pytest.raises(sinks.TargetTaken):
            sinks.replace_table(rows, name)
    assert spark.sql("SHOW TABLES IN taken_db").count() == 2


def test_a_failed_last_step_leaves_no_orphan(spark, raw):
    sinks.ensure_database(spark, "orphan_db")
    rows = raw({}).withColumn("year", F.lit(2024))
    sinks.replace_table(rows, "orphan_db.sales")

    def refuse(_):
        raise RuntimeError("not these rows")

    with pytest.raises(RuntimeError):
        sinks.replace_table(rows, "orphan_db.sales", inspect=refuse)
    assert spark.sql("SHOW TABLES IN orphan_db").count() == 2
    assert spark.table("orphan_db.sales").count() == 1


def test_locations_are_escaped(spark, tmp_path):
    place = tmp_path / "it's here"
    sinks.ensure_database(spark, "quote_db", str(place))
    spark.sql("CREATE TABLE quote_db.t USING parquet AS SELECT 1 AS x")
    assert place.exists()


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan csv")


def test_one_scan_of_the_files(spark, tmp_path):
    """Neither the checked rows nor a load read the files a second time."""
    from salesmart import run_etl

    (tmp_path / "a.csv").write_text(HEADER + line("A") + line("B"))
    checked = csv_source.read_csv(spark, str(tmp_path))
    assert scans(checked) == 0 and checked.count() == 2
    feed = csv_source.scan_csv(spark, str(tmp_path))
    assert scans(feed.rows) == 1
    sinks.ensure_database(spark, "scan_db")
    report = run_etl(feed, "scan_db.sales")
    assert report.rows_in == 2 and report.columns_in == 11
    assert list(report.steps) == ["read and judge", "report", "count customers", "enrich, write and audit"]
    assert all(took >= 0 for took in report.steps.values()) and sum(report.steps.values()) <= report.elapsed_s


def test_nothing_is_published_from_a_feed_with_malformed_records(spark, tmp_path):
    from salesmart import run_etl

    (tmp_path / "a.csv").write_text(HEADER + line("A"))
    sinks.ensure_database(spark, "gate_db")
    run_etl(csv_source.scan_csv(spark, str(tmp_path)), "gate_db.sales")
    (tmp_path / "b.csv").write_text(HEADER + (line("B").strip() + ",11\n") * 2)
    with pytest.raises(csv_source.MalformedCsv, match=r"too many fields or an open quote: .*b\.csv: 2\."):
        run_etl(csv_source.scan_csv(spark, str(tmp_path)), "gate_db.sales")
    assert [row.order_id for row in spark.table("gate_db.sales").collect()] == ["A"]
    assert spark.sql("SHOW TABLES IN gate_db LIKE 'sales__v*'").count() == 1


class FakeJava:
    """What a JVM exception shows through the gateway."""

    def __init__(self, name, state=None, cause=None, sql=True):
        self.name, self.state, self.cause, self.sql = name, state, cause, sql

    def getClass(self):
        return self

    def getName(self):
        return self.name

    def getSuperclass(self):
        return FakeJava("java.sql.SQLException") if self.sql and self.name != "java.sql.SQLException" else None

    def getSQLState(self):
        return self.state

    def getCause(self):
        return self.cause


@pytest.mark.parametrize("cause, missing", [
    (FakeJava("com.mysql.cj.jdbc.exceptions.CommunicationsException", "08S01"), True),
    (FakeJava("org.postgresql.util.PSQLException", "42P01"), True),
    (FakeJava("java.sql.SQLSyntaxErrorException", "42S02"), True),
    (FakeJava("java.lang.RuntimeException", None, FakeJava("java.net.ConnectException", sql=False), False), True),
    (FakeJava("java.sql.SQLInvalidAuthorizationSpecException", "28000"), False),
    (FakeJava("java.sql.SQLSyntaxErrorException", "42000"), False),
    (FakeJava("org.apache.spark.SparkException", sql=False), False),
])
def test_only_missing_sources_fall_back(spark, tmp_path, cause, missing):
    class Broken(sources.Py4JJavaError):
        def __init__(self):
            self.java_exception = cause

        def __str__(self):
            return "broken"

    def loader(_):
        raise Broken

    file = tmp_path / "a.csv"
    file.write_text(HEADER + line("A"))
    load = sources.with_fallback(loader, str(file))
    if missing:
        assert load(spark).first().profit_tier == "Medium"
    else:
        with pytest.raises(Broken):
            load(spark)


def test_broken_queries_do_not_fall_back(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text(HEADER + line("A"))
    for text in ("SELECT no_such_column FROM range(1)", "SELEC 1", "SELECT no_such_function(1)"):
        with pytest.raises(Exception, match="(?i)no_such|syntax"):
            sources.with_fallback(lambda s, text=text: s.sql(text), str(file))(spark)
    load = sources.with_fallback(lambda s: s.table("no_such_db.sales"), str(file))
    assert load(spark).first().order_id == "A"


class FakeStore:
    """A database of dictionaries that knows the statements of the dialects."""

    def __init__(self, **tables):
        self.tables, self.log, self.fail = tables, [], ""

    def create(self, rows, table):
        assert table not in self.tables
        self.tables[table] = rows.collect()[:1] if self.fail == "lose" else rows.collect()
        if self.fail == "write":
            raise RuntimeError("write")

    def count(self, table):
        return len(self.tables[table])

    def run(self, statements, transaction=False):
        before = dict(self.tables)
        try:
            for text in statements:
                self.log.append(text)
                if self.fail and self.fail in text:
                    raise RuntimeError(self.fail)
                words = text.replace(",", " ,").split()
                if text.startswith("CREATE"):
                    self.tables.setdefault(words[5], [])
                elif text.startswith("RENAME"):
                    for n in range(2, len(words), 4):
                        self.tables[words[n + 2]] = self.tables.pop(words[n])
                elif text.startswith("ALTER"):
                    schema = words[2].rpartition(".")[0]
                    self.tables[f"{schema}.{words[5]}" if schema else words[5]] = self.tables.pop(words[2])
                elif text.startswith("DROP"):
                    self.tables.pop(words[-1], None)
        except BaseException:
            if transaction:
                self.tables = before
            raise


MYSQL = sources.JdbcTarget("jdbc:mysql://host/db", "me", "secret")
POSTGRES = sources.JdbcTarget("jdbc:postgresql://host/db", "me", "secret")


@pytest.mark.parametrize("target, table", [(MYSQL, "sales"), (POSTGRES, "shop.sales")])
def test_a_database_table_is_replaced_by_a_swap(raw, target, table):
    rows = quality.validate(raw({}, {"order_id": "B"}), ["line"])
    store = FakeStore()
    for n in (2, 1):
        report = sinks.replace_jdbc(rows.limit(n), target, table, store=store)
        assert (report.table, report.rows_written, report.rows_read_back) == (table, n, n)
        assert list(store.tables) == [table] and len(store.tables[table]) == n
    assert store.tables[table][0].date == GOOD["date"]


@pytest.mark.parametrize("target, table", [(MYSQL, "sales"), (POSTGRES, "shop.sales")])
@pytest.mark.parametrize("fail", ["write", "lose", "refuse", "CREATE", "RENAME"])
def test_a_failed_replacement_leaves_the_old_table(raw, target, table, fail):
    rows = quality.validate(raw({}, {"order_id": "B"}), ["line"])
    store = FakeStore(**{table: ["old"]})
    store.fail = fail

    def refuse():
        if fail == "refuse":
            raise RuntimeError("refuse")

    with pytest.raises(RuntimeError):
        sinks.replace_jdbc(rows, target, table, store=store, inspect=refuse)
    assert store.tables == {table: ["old"]}


def test_an_old_table_that_cannot_be_dropped_is_no_failure(raw):
    store = FakeStore(sales=["old"])
    store.fail = "DROP"
    report = sinks.replace_jdbc(quality.validate(raw({}), ["line"]), MYSQL, "sales", store=store)
    assert report.rows_written == 1 and len(store.tables["sales"]) == 1 and len(store.tables) == 2


def test_databases_without_known_statements_need_a_dialect(raw):
    rows = quality.validate(raw({}), ["line"])
    other = sources.JdbcTarget("jdbc:other://host/db", "me", "secret")
    with pytest.raises(ValueError, match="jdbc:other:.*Dialect"):
        sinks.replace_jdbc(rows, other, "sales", store=FakeStore())
    own = sinks.Dialect(("jdbc:other:",), sinks.DIALECTS[0].swap, False)
    assert sinks.replace_jdbc(rows, other, "sales", store=FakeStore(), dialect=own).rows_written == 1


def test_quantile_split(spark, monkeypatch):
    split = sources.JdbcQuantiles("order_no", 4)
    assert split.query("sales") == (
        "SELECT MAX(v) AS bound FROM (SELECT order_no AS v, NTILE(4) OVER (ORDER BY order_no) AS part "
        "FROM sales WHERE order_no IS NOT NULL) q GROUP BY part ORDER BY 1"
    )
    assert split.predicates([10, 20, 20, 90]) == [
        "order_no <= 10 OR order_no IS NULL", "order_no > 10 AND order_no <= 20", "order_no > 20",
    ]
    assert split.predicates([]) == split.predicates([5]) == ["1 = 1"]
    assert sources.JdbcQuantiles("name", 2).predicates(["o'x", "z"])[1] == "name > 'o''x'"
    with pytest.raises(ValueError):
        sources.JdbcQuantiles("a; b", 2).query("sales")
    # Every row is in one range, also rows beyond the bounds that were seen.
    rows = spark.createDataFrame([(n,) for n in [None, -5, 3, 10, 11, 20, 21, 90, 500]], "order_no int")
    parts = [rows.filter(condition).count() for condition in split.predicates([10, 20, 90])]
    assert parts == [4, 2, 3]


def test_quantiles_are_asked_of_the_database(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(sources, "ask", lambda *x: asked.append(x[1:]) or [1, 2, 3])

    class Reader:
        def jdbc(self, url, table, predicates, properties):
            asked.append((url, table, predicates, properties))
            return spark.createDataFrame([("2024-01-05",)], "date string")

    class Session:
        read = Reader()

    rows = sources.read_jdbc(Session(), MYSQL, "sales", sources.JdbcQuantiles("k", 3))
    assert str(rows.first().date) == "2024-01-05"
    (target, query), (url, table, predicates, properties) = asked
    assert target is MYSQL and "NTILE(3)" in query
    assert (url, table, len(predicates)) == (MYSQL.url, "sales", 3)
    assert properties["fetchsize"] == "10000" and "url" not in properties
