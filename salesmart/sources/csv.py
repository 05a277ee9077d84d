"""CSV files as raw order rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.config import SalesConfig
from salesmart.functions.dates import date_of
from salesmart.functions.numeric import number_from_text
from salesmart.storage import stage

# The texts a CSV reader of the pandas family takes as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Place of a row in its file set. Within one file split the row ids rise with
# the position, so the three together give file order whatever way Spark packs
# splits into partitions.
INGEST_ORDER = ("_ingest_file", "_ingest_block", "_ingest_row")


# Column in which the reader puts the text of a record that does not fit.
BAD_RECORD = "__bad_record"
# Column that marks malformed records.
BAD = "__malformed"
# Files that an error names.
NAMED_FILES = 20


class SourceNotFound(FileNotFoundError):
    """The source to read does not exist."""


class MalformedCsv(ValueError):
    """Records with more fields than the header, or with a quote left open."""


def _malformed(width: int) -> Column:
    """Whether a record's text is over-long or broken; short records are neither."""
    text = F.col(BAD_RECORD)
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    bare = F.regexp_replace(text, '"(?:[^"]|"")*+"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    # Sound records have no text there.
    return F.coalesce((quotes % 2 == 1) | (fields > width), F.lit(False))


def _refuse(marked: DataFrame) -> None:
    """An error that names the files of malformed records and counts them."""
    # A data column is named too: Spark refuses to read the text of bad records alone.
    any_column = F.count(F.col(f"`{marked.columns[0]}`"))
    counts = marked.filter(BAD).groupBy(INGEST_ORDER[0]).agg(F.count("*").alias("n"), any_column.alias("_"))
    first = counts.orderBy(INGEST_ORDER[0]).limit(NAMED_FILES + 1).collect()
    shown = ", ".join(f"{row[0]}: {row.n}" for row in first[:NAMED_FILES])
    more = " and more files" if len(first) > NAMED_FILES else ""
    raise MalformedCsv(
        f"Records with too many fields or an open quote: {shown}{more}. "
        "Quoted line breaks need multi_line=True"
    )


def _scan(
    spark: SparkSession, path: str, config: SalesConfig, multi_line: bool
) -> DataFrame:
    """All columns, ``INGEST_ORDER``, ``BAD``, and the text of records that do not fit."""
    options = dict(
        header=True, inferSchema=False, enforceSchema=False, quote='"', escape='"',
        multiLine=multi_line,
    )
    try:
        names = spark.read.options(**options).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise SourceNotFound(f"File not found: {path}") from error
        raise
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*names, BAD_RECORD)])
    # Without pruning every field is parsed: only then are bad records noticed.
    lines = spark.read.options(
        **options, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_RECORD, columnPruning=False
    ).schema(schema).csv(path)
    columns = []
    for name in names:
        text = F.when(~F.col(f"`{name}`").isin(*MISSING_TOKENS), F.col(f"`{name}`"))
        columns.append((number_from_text(text) if name in config.numeric else text).alias(name))
    file, block, row = INGEST_ORDER
    return lines.select(
        *columns,
        F.col("_metadata.file_path").alias(file),
        F.col("_metadata.file_block_start").alias(block),
        F.monotonically_increasing_id().alias(row),
        _malformed(len(names)).alias(BAD),
        F.col(BAD_RECORD),
    )


@dataclass(frozen=True)
class CsvFeed:
    """Rows of CSV files in one lazy scan that counts its malformed records.

    Whoever uses the rows calls ``verify`` after the first action over them and
    before anything made from them is shown to others: rows must be used once,
    as by a step that stages what it makes of them.
    """

    rows: DataFrame
    counted: Observation
    marked: DataFrame

    def verify(self) -> None:
        """An error if the scan met malformed records; it reads the files once more
        to name them. Tasks that ran twice count twice, which changes nothing."""
        if self.counted.get["bad"]:
            _refuse(self.marked)


def scan_csv(
    spark: SparkSession, path: str, config: SalesConfig = SalesConfig(), *, multi_line: bool = False
) -> CsvFeed:
    """Header CSV as ``read_csv`` gives it, without a pass or a copy of its own."""
    marked = _scan(spark, path, config, multi_line)
    counted = Observation()
    rows = marked.drop(BAD_RECORD).observe(counted, F.count_if(BAD).alias("bad")).drop(BAD)
    return CsvFeed(rows, counted, marked)


def read_csv(
    spark: SparkSession,
    path: str,
    config: SalesConfig = SalesConfig(),
    *,
    multi_line: bool = False,
    check_first: bool = True,
) -> DataFrame:
    """Header CSV as text columns, missing texts as NULL, numbers as doubles.

    ``date`` stays text for the quality rules; columns beyond the known ones
    pass through. The columns of ``INGEST_ORDER`` are added. Files stay
    splittable unless quoted line breaks (``multi_line``) are asked for.

    A record shorter than the header has NULL at its end. One with more fields,
    or with a quote left open, is an error that names the files, raised before
    any row is used: the files are read once, into a written copy that counts
    such records as it is made, and the rows are read from the copy. Without
    ``check_first`` there is no copy, and the query that meets such a record
    ends there. ``scan_csv`` needs neither where rows are staged anyway.
    """
    marked = _scan(spark, path, config, multi_line)
    if check_first:
        counted = Observation()
        checked = marked.drop(BAD_RECORD).observe(counted, F.count_if(BAD).alias("bad"))
        copy = stage(checked, "csv")
        if counted.get["bad"]:
            try:
                _refuse(copy.rows)
            finally:
                copy.release()
        return copy.rows.drop(BAD)
    file = INGEST_ORDER[0]
    stop = F.raise_error(F.concat(F.lit("Malformed CSV record in "), file, F.lit(": "), BAD_RECORD))
    # A filter, so that the check is made whichever columns are used.
    sound = marked.filter(F.when(F.col(BAD), stop.cast("string")).otherwise(F.col(file)).isNotNull())
    return sound.drop(BAD, BAD_RECORD)


def read_csv_dated(
    spark: SparkSession,
    path: str,
    config: SalesConfig = SalesConfig(),
    *,
    multi_line: bool = False,
    check_first: bool = True,
) -> DataFrame:
    """The CSV scan with ``date`` parsed; unparseable dates are NULL."""
    rows = read_csv(spark, path, config, multi_line=multi_line, check_first=check_first)
    return rows.withColumn("date", date_of(rows, "date", config.date_format)).drop(*INGEST_ORDER)
