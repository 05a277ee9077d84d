"""Tables of the catalog or of a JDBC database, and the CSV way out."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.config import SalesConfig
from salesmart.operators.enrich import enrich_reduced
from salesmart.sources.csv import SourceNotFound, read_csv_dated
from salesmart.storage import quoted


log = logging.getLogger("salesmart")

# Gives the enriched rows of a source, or an error where it is not there.
Loader = Callable[[SparkSession], DataFrame]


def dated(df: DataFrame) -> DataFrame:
    """``date`` as a date again where the store kept it as text."""
    if isinstance(df.schema["date"].dataType, T.DateType):
        return df
    return df.withColumn("date", F.to_date("date"))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table with ``date`` as a date."""
    quoted(name)
    if not spark.catalog.tableExists(name):
        raise SourceNotFound(f"Table not found: {name}")
    return dated(spark.table(name))


@dataclass(frozen=True)
class JdbcTarget:
    """Where a JDBC table is and how to reach it; the caller names everything."""

    url: str
    user: str
    password: str = field(repr=False)
    driver: str | None = None
    connect_timeout_ms: int = 10_000
    properties: dict[str, str] = field(default_factory=lambda: {"characterEncoding": "UTF-8"})

    def options(self) -> dict[str, str]:
        chosen = {
            "url": self.url, "user": self.user, "password": self.password,
            "connectTimeout": str(self.connect_timeout_ms), **self.properties,
        }
        if self.driver:
            chosen["driver"] = self.driver
        return chosen


@dataclass(frozen=True)
class JdbcSplit:
    """How one JDBC table is read by many tasks: ranges of a numeric or date column."""

    column: str
    lower: str
    upper: str
    partitions: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column, "lowerBound": self.lower,
            "upperBound": self.upper, "numPartitions": str(self.partitions),
        }


@dataclass(frozen=True)
class SingleConnection:
    """The choice, made in so many words, to read a whole table in one task."""

    def options(self) -> dict[str, str]:
        return {"numPartitions": "1"}


@dataclass(frozen=True)
class JdbcQuantiles:
    """A split whose ranges hold about equally many rows, whatever the values are.

    The database is asked for the bounds when the table is first read: one query
    that sorts the column there and sends back a value per range.
    """

    column: str
    partitions: int

    def query(self, table: str) -> str:
        column = self._checked()
        return (
            f"SELECT MAX(v) AS bound FROM (SELECT {column} AS v, "
            f"NTILE({int(self.partitions)}) OVER (ORDER BY {column}) AS part "
            f"FROM {table} WHERE {column} IS NOT NULL) q GROUP BY part ORDER BY 1"
        )

    def predicates(self, bounds: Iterable[object]) -> list[str]:
        """One condition per task; together they hold for every row once.

        Ranges reach below the first bound and above the last, so rows that came
        in since the bounds were asked for are read too, and so are nulls.
        """
        column = self._checked()
        ends = sorted(set(bounds))[:-1]
        if not ends:
            return ["1 = 1"]
        texts = [_literal(end) for end in ends]
        inner = [f"{column} > {low} AND {column} <= {high}" for low, high in zip(texts, texts[1:])]
        return [f"{column} <= {texts[0]} OR {column} IS NULL", *inner, f"{column} > {texts[-1]}"]

    def _checked(self) -> str:
        quoted(self.column)
        return self.column


def _literal(value: object) -> str:
    """A bound as SQL text: numbers as they are, anything else as quoted text."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"Not a bound of a range: {value!r}")
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


Split = JdbcSplit | SingleConnection | JdbcQuantiles
# Rows that the database sends at a time; drivers may otherwise hold them all.
FETCH_ROWS = 10_000


def jdbc_read_options(
    target: JdbcTarget, table: str, split: JdbcSplit | SingleConnection
) -> dict[str, str]:
    quoted(table)
    return {**target.options(), "dbtable": table, "fetchsize": str(FETCH_ROWS), **split.options()}


def ask(spark: SparkSession, target: JdbcTarget, query: str) -> list[object]:
    """The first column of a query that the database answers in few rows."""
    rows = spark.read.format("jdbc").options(**target.options(), query=query).load()
    return [row[0] for row in rows.collect()]


def read_jdbc(spark: SparkSession, target: JdbcTarget, table: str, split: Split) -> DataFrame:
    """A JDBC table with ``date`` as a date; filters and columns are pushed to it."""
    if isinstance(split, JdbcQuantiles):
        quoted(table)
        bounds = ask(spark, target, split.query(table))
        properties = {**target.options(), "fetchsize": str(FETCH_ROWS)}
        return dated(spark.read.jdbc(
            properties.pop("url"), table, predicates=split.predicates(bounds), properties=properties
        ))
    return dated(spark.read.format("jdbc").options(**jdbc_read_options(target, table, split)).load())


def table_loader(name: str) -> Loader:
    """Reads a catalog table, as it is when it is called."""

    def load(spark: SparkSession) -> DataFrame:
        if spark.catalog.tableExists(name):
            spark.catalog.refreshTable(name)
        return read_table(spark, name)

    return load


def jdbc_loader(target: JdbcTarget, table: str, split: Split) -> Loader:
    return lambda spark: read_jdbc(spark, target, table, split)


# Spark's conditions for a table, schema, catalog or path that is not there.
NOT_THERE = (
    "TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND", "CATALOG_NOT_FOUND", "PATH_NOT_FOUND",
)
# SQL states of a missing table or database, and the class of connection failures.
MISSING_STATES, CONNECTION_CLASS = ("42S02", "42P01", "3D000"), "08"
# Network failures, which drivers may pass on without an SQL state.
UNREACHABLE = (
    "java.net.ConnectException", "java.net.UnknownHostException", "java.net.NoRouteToHostException",
    "java.net.SocketTimeoutException",
)


def _states(error: BaseException) -> Iterator[tuple[str, str | None]]:
    """Class and SQL state of the JVM exception of an error and of its causes."""
    cause = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while cause is not None:
        kind = cause.getClass()
        is_sql = False
        above = kind
        while above is not None and not is_sql:
            is_sql = above.getName() == "java.sql.SQLException"
            above = above.getSuperclass()
        yield kind.getName(), cause.getSQLState() if is_sql else None
        cause = cause.getCause()


def is_missing(error: BaseException) -> bool:
    """Whether an error says that a source is not there or cannot be reached.

    A refused login, a missing right, a broken query or a value of a wrong type
    is none of these.
    """
    if isinstance(error, SourceNotFound):
        return True
    if isinstance(error, PySparkException) and error.getCondition() in NOT_THERE:
        return True
    return any(
        kind in UNREACHABLE or (state or "").startswith(CONNECTION_CLASS) or state in MISSING_STATES
        for kind, state in _states(error)
    )


def with_fallback(
    loader: Loader, csv_path: str, config: SalesConfig = SalesConfig(), *, multi_line: bool = False
) -> Loader:
    """The loader's rows or, where its source cannot be reached or is not there,
    the raw CSV reduced-enriched. The reason is logged. Any other error is raised:
    rows that no rule has seen are no answer to a refused login or a broken query.
    """

    def load(spark: SparkSession) -> DataFrame:
        try:
            return loader(spark)
        except (SourceNotFound, Py4JJavaError, PySparkException) as error:
            if not is_missing(error):
                raise
            log.warning("Falling back to %s: %s", csv_path, str(error).splitlines()[0])
            return enrich_reduced(read_csv_dated(spark, csv_path, config, multi_line=multi_line))

    return load


def read_or_fallback(
    spark: SparkSession,
    source: str | Loader,
    csv_path: str,
    config: SalesConfig = SalesConfig(),
    *,
    multi_line: bool = False,
) -> DataFrame:
    """``with_fallback`` at once, from a catalog table's name or any loader."""
    loader = table_loader(source) if isinstance(source, str) else source
    return with_fallback(loader, csv_path, config, multi_line=multi_line)(spark)
