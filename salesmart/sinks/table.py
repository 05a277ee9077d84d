"""Full-replace table sinks with a row count read back."""

from __future__ import annotations

import logging
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from salesmart.config import SalesConfig
from salesmart.functions.dates import iso_text
from salesmart.functions.layout import cell, interleaved
from salesmart.operators.facts import kept_cube
from salesmart.sources.table import JdbcTarget, ask, dated
from salesmart.storage import quoted, stage

log = logging.getLogger("salesmart")

# Fixed value: rows per JDBC insert.
INSERT_BATCH = 500


# Columns by which rows are dealt and sorted, gone before they are written.
_ORDER, _CELL = "__order", "__cell"


class TargetTaken(RuntimeError):
    """The name to load into belongs to something that no load has made."""


class RowCountMismatch(RuntimeError):
    """The sink holds another number of rows than was written."""


@dataclass(frozen=True)
class WriteReport:
    table: str
    columns: int
    rows_written: int
    rows_read_back: int


def ensure_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    place = ""
    if location is not None:
        escaped = location.replace("\\", "\\\\").replace("'", "\\'")
        place = f" LOCATION '{escaped}'"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(name)}{place}")


# Properties that mark a version, beside its name, and the view that shows one.
VERSION_OF, SHOWS = "salesmart.version_of", "salesmart.shows"
# What may be kept beside a version.
CUBE = "cube"
KINDS = (CUBE,)


def _new_version(name: str) -> str:
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S%f")
    return f"{name}__v{stamp}_{uuid.uuid4().hex[:8]}"


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {row.key: row.value for row in spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").collect()}


def _versions(spark: SparkSession, name: str) -> list[str]:
    """Tables that this module has written for ``name``, oldest first.

    Both the whole name and the table's property must say so: other tables of a
    like name are nobody's business here.
    """
    database, _, base = name.rpartition(".")
    scope = f" IN {quoted(database)}" if database else ""
    pattern = re.compile(rf"{re.escape(base.lower())}__v[0-9]{{20}}_[0-9a-f]{{8}}")
    shown = spark.sql(f"SHOW TABLES{scope}").collect()
    names = sorted(row.tableName for row in shown if pattern.fullmatch(row.tableName.lower()))
    found = [f"{database}.{table}" if database else table for table in names]
    return [table for table in found if _properties(spark, table).get(VERSION_OF) == name.lower()]


def _beside(version: str, kind: str) -> str:
    """The table that is kept beside a version."""
    base, mark, stamp = version.rpartition("__v")
    return f"{base}__{kind}{mark[1:]}{stamp}"


def _drop_version(spark: SparkSession, version: str) -> None:
    for table in (*[_beside(version, kind) for kind in KINDS], version):
        spark.sql(f"DROP TABLE IF EXISTS {quoted(table)}")


def kept_beside(spark: SparkSession, name: str, kind: str) -> DataFrame | None:
    """What the load that ``name`` shows has kept beside its rows; None where it
    has kept nothing, or where no load has made ``name``."""
    if not spark.catalog.tableExists(name) or spark.catalog.getTable(name).tableType != "VIEW":
        return None
    shown = _properties(spark, name).get(SHOWS)
    if shown is None or not spark.catalog.tableExists(_beside(shown, kind)):
        return None
    return spark.table(quoted(_beside(shown, kind)))


def _shown(spark: SparkSession, name: str) -> str | None:
    """The version that the view ``name`` shows; None where there is no such view.

    A table, or a view that shows something else, is not ours to replace.
    """
    if not spark.catalog.tableExists(name):
        return None
    if spark.catalog.getTable(name).tableType != "VIEW":
        raise TargetTaken(f"{name} is a table, not a view made by an earlier load")
    shown = _properties(spark, name).get(SHOWS)
    if shown is None:
        raise TargetTaken(f"{name} is a view that no load has made")
    return shown


def replace_table(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = ("year",),
    *,
    rebalance: bool = True,
    sort_by: Sequence[str] = (),
    inspect: Callable[[DataFrame], None] | None = None,
    order: Column | None = None,
    bloom: Sequence[str] = (),
    keep: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> WriteReport:
    """Replace what ``name`` shows by these rows.

    The rows go into a new table, their count is read back, ``inspect`` may look
    at them, and only then the view ``name`` is pointed at it: readers never see
    a missing or half-written table, and whatever fails leaves the old rows in
    place and no new table behind. The version shown before stays until the next
    replacement, for queries still reading it; older ones go. ``rebalance``
    shuffles once towards the partition columns so that each holds few
    well-sized files; adaptive execution splits the large ones. ``sort_by``
    orders rows within files, so that filters on these columns skip parts of them.
    An ``order`` of ``functions.layout`` comes before these and also decides which
    rows share files; ``bloom`` columns get Bloom filters, by which filters on one
    value skip row groups. What ``keep`` makes of the new rows, by its kind, is
    written beside them, and shown and dropped together with them.
    """
    spark = df.sparkSession
    shown = _shown(spark, name)
    before = _versions(spark, name)
    version = _new_version(name)
    dealt, sorted_by = [*partition_by], [*partition_by, *sort_by] if sort_by else []
    if order is not None:
        df = df.withColumns({_ORDER: order, _CELL: cell(order)})
        dealt, sorted_by = [*dealt, _CELL], [*partition_by, _ORDER, *sort_by]
    if rebalance and dealt:
        df = df.hint("rebalance", *[F.col(column) for column in dealt])
    if sorted_by:
        df = df.sortWithinPartitions(*sorted_by)
    df = df.drop(_ORDER, _CELL)
    options = {f"parquet.bloom.filter.enabled#{column}": "true" for column in bloom}
    if options:
        # The filters are as large as the values of a row group need.
        options["parquet.bloom.filter.adaptive.enabled"] = "true"
    written = Observation()
    try:
        (
            # Above the last shuffle: each row is counted by the task that writes it.
            df.observe(written, F.count(F.lit(1)).alias("rows"))
            .write.format("parquet").options(**options).partitionBy(*partition_by).saveAsTable(quoted(version))
        )
        spark.sql(f"ALTER TABLE {quoted(version)} SET TBLPROPERTIES ('{VERSION_OF}' = '{name.lower()}')")
        report = WriteReport(
            name, len(df.columns), int(written.get["rows"]), spark.table(quoted(version)).count()
        )
        if report.rows_written != report.rows_read_back:
            raise RowCountMismatch(str(report))
        if inspect:
            inspect(spark.table(quoted(version)))
        for kind, make in (keep or {}).items():
            beside = quoted(_beside(version, kind))
            make(spark.table(quoted(version))).write.format("parquet").saveAsTable(beside)
        spark.sql(
            f"CREATE OR REPLACE VIEW {quoted(name)} TBLPROPERTIES ('{SHOWS}' = '{version.lower()}') "
            f"AS SELECT * FROM {quoted(version)}"
        )
    except BaseException:
        _drop_version(spark, version)
        raise
    for old in before:
        if old.lower() != shown:
            _drop_version(spark, old)
    return report


def with_text_date(df: DataFrame) -> DataFrame:
    """``date`` as ISO text, for stores that keep it as text."""
    return dated(df).withColumn("date", iso_text(F.col("date")))


def jdbc_write_options(target: JdbcTarget, table: str, partitions: int) -> dict[str, str]:
    quoted(table)
    return {
        **target.options(), "dbtable": table,
        "batchsize": str(INSERT_BATCH), "numPartitions": str(partitions),
    }


def jdbc_count_options(target: JdbcTarget, table: str) -> dict[str, str]:
    """The count is taken in the database: one row comes back."""
    quoted(table)
    return {**target.options(), "query": f"SELECT COUNT(*) AS n FROM {table}"}


@dataclass(frozen=True)
class Dialect:
    """How a database puts a finished table in the place of another.

    ``swap`` are the statements, in order, over ``{table}``, the finished
    ``{fresh}`` and ``{old}``, a name that is free; ``{table_base}`` and
    ``{old_base}`` are the names without a schema. They also serve where there
    is no table yet. With ``transaction`` they take effect together; without,
    the one that renames does so by itself.
    """

    urls: tuple[str, ...]
    swap: tuple[str, ...]
    transaction: bool
    drop: str = "DROP TABLE IF EXISTS {table}"

    def statements(self, table: str, fresh: str, old: str) -> list[str]:
        names = {
            "table": table, "fresh": fresh, "old": old,
            "table_base": table.rpartition(".")[2], "old_base": old.rpartition(".")[2],
        }
        return [text.format(**names) for text in self.swap]


# The rename statements of these databases.
DIALECTS = (
    Dialect(
        ("jdbc:mysql:", "jdbc:mariadb:"),
        (
            "CREATE TABLE IF NOT EXISTS {table} LIKE {fresh}",
            "RENAME TABLE {table} TO {old}, {fresh} TO {table}",
        ),
        transaction=False,
    ),
    Dialect(
        ("jdbc:postgresql:",),
        (
            "CREATE TABLE IF NOT EXISTS {table} (LIKE {fresh})",
            "ALTER TABLE {table} RENAME TO {old_base}",
            "ALTER TABLE {fresh} RENAME TO {table_base}",
        ),
        transaction=True,
    ),
)


def dialect_of(url: str) -> Dialect:
    for dialect in DIALECTS:
        if url.startswith(dialect.urls):
            return dialect
    raise ValueError(f"No statements known to replace a table of {url.split('//')[0]}; name a Dialect")


class JdbcStore:
    """Tables of one database, written and counted by Spark, renamed by statements."""

    def __init__(self, spark: SparkSession, target: JdbcTarget, partitions: int = 8):
        self.spark, self.target, self.partitions = spark, target, partitions

    def create(self, rows: DataFrame, table: str) -> None:
        options = jdbc_write_options(self.target, table, self.partitions)
        rows.write.format("jdbc").options(**options).mode("errorifexists").save()

    def count(self, table: str) -> int:
        return int(ask(self.spark, self.target, jdbc_count_options(self.target, table)["query"])[0])

    def run(self, statements: Sequence[str], transaction: bool = False) -> None:
        """Statements over one connection, which the driver opens and closes."""
        jvm = self.spark._jvm
        options = self.target.options()
        if self.target.driver:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.target.driver)
        settings = jvm.java.util.Properties()
        for key, value in options.items():
            if key not in ("url", "driver"):
                settings.setProperty(key, value)
        connection = jvm.java.sql.DriverManager.getConnection(options["url"], settings)
        try:
            connection.setAutoCommit(not transaction)
            statement = connection.createStatement()
            for text in statements:
                statement.execute(text)
            if transaction:
                connection.commit()
        finally:
            # What is not committed by now is undone.
            connection.close()


def _drop(store: JdbcStore, dialect: Dialect, table: str) -> None:
    """Drop a table that nobody reads. A failure is logged: the outcome stands without it."""
    try:
        store.run([dialect.drop.format(table=table)])
    except Exception:
        log.exception("Could not drop %s", table)


def replace_jdbc(
    df: DataFrame,
    target: JdbcTarget,
    table: str,
    partitions: int = 8,
    *,
    dialect: Dialect | None = None,
    store: JdbcStore | None = None,
    inspect: Callable[[], None] | None = None,
) -> WriteReport:
    """Replace a JDBC table, ``date`` as text; at most ``partitions`` connections.

    The rows go into a table of a name of their own, the database counts them
    there, ``inspect`` may still refuse them, and only then the two tables
    change names. Whatever fails before leaves the old table as it was and no
    new one behind; readers see the old rows or the new ones.
    """
    quoted(table)
    dialect = dialect or dialect_of(target.url)
    store = store or JdbcStore(df.sparkSession, target, partitions)
    mark = uuid.uuid4().hex[:12]
    fresh, old = f"{table}__new_{mark}", f"{table}__old_{mark}"
    written = Observation()
    rows = with_text_date(df).observe(written, F.count(F.lit(1)).alias("rows"))
    try:
        store.create(rows, fresh)
        report = WriteReport(table, len(rows.columns), int(written.get["rows"]), store.count(fresh))
        if report.rows_written != report.rows_read_back:
            raise RowCountMismatch(str(report))
        if inspect:
            inspect()
        store.run(dialect.statements(table, fresh, old), dialect.transaction)
    except BaseException:
        _drop(store, dialect, fresh)
        raise
    _drop(store, dialect, old)
    return report


# --- where a load goes -------------------------------------------------------

# Columns of many values that filters ask for one of.
POINT_COLUMNS = ("product", "customer_id")


@dataclass(frozen=True)
class CatalogSink:
    """A catalog table by year, made for the questions asked of it.

    Rows lie by days and products in turn, with Bloom filters on product and
    customer, so that filters on dates or on one product skip files and row
    groups; the cube that panels of a small result are read from is kept beside
    it. ``clustered`` and ``cube`` leave these out, for rows with other columns.
    """

    table: str
    config: SalesConfig = SalesConfig()
    clustered: bool = True
    cube: bool = True

    def write(self, rows: DataFrame, inspect: Callable[[DataFrame], None]) -> WriteReport:
        return replace_table(
            rows, self.table, sort_by=["date"], inspect=inspect,
            order=interleaved() if self.clustered else None,
            bloom=POINT_COLUMNS if self.clustered else (),
            keep={CUBE: lambda made: kept_cube(made, self.config)} if self.cube else None,
        )


@dataclass(frozen=True)
class JdbcSink:
    """A database table. Rows are staged first, so that what is wrong with them
    shows before the database is touched and they are made only once."""

    target: JdbcTarget
    table: str
    partitions: int = 8
    dialect: Dialect | None = None

    def write(self, rows: DataFrame, inspect: Callable[[DataFrame], None]) -> WriteReport:
        staged = stage(rows, "load")
        try:
            inspect(staged.rows)
            return replace_jdbc(
                staged.rows, self.target, self.table, self.partitions, dialect=self.dialect
            )
        finally:
            staged.release()
