"""Dense numbers over whole tables, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.storage import Staged, stage

_PART, _FILE, _ROW = "__number_part", "__number_file", "__number_row"


def number_written(copy: Staged, name: str) -> DataFrame:
    """The rows of a written copy with a long ``name`` that counts them from 0.

    Rows are counted file by file, in the order of the partitions that wrote
    them. Only the rows of each file are counted up; a number is the place of a
    row in its file and the number of rows in files before. The table of files,
    one row each, is what is broadcast. Reading again gives the same numbers.
    """
    place = F.col("_metadata.file_name")
    rows = copy.rows.select(
        "*",
        F.regexp_extract(place, r"part-(\d+)", 1).cast("long").alias(_PART),
        F.regexp_extract(place, r"-c(\d+)\.", 1).try_cast("long").alias(_FILE),
        F.col("_metadata.row_index").alias(_ROW),
    )
    sizes = rows.groupBy(_PART, _FILE).agg(F.count("*").alias("n"))
    before = W.orderBy(_PART, _FILE).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(_PART).alias("part"), F.col(_FILE).alias("file"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
    )
    same = (F.col(_PART) == F.col("part")) & F.col(_FILE).eqNullSafe(F.col("file"))
    return rows.join(F.broadcast(starts), same).select(
        *[F.col(f"`{column}`") for column in copy.rows.columns],
        (F.col(_ROW) + F.col("start")).alias(name),
    )


def ranked(df: DataFrame, *order: Column | str, name: str) -> tuple[DataFrame, Staged]:
    """Rows with a long ``name`` that counts them from 0 in the given order.

    Rows are dealt to tasks by ranges of the order, sorted there and written;
    rows of equal order are numbered as they were written. Equal keys share a
    task: where one may hold a large share of all rows, ``order`` must go on to
    columns that tell its rows apart. The written copy comes back too, to be
    released when the numbers are used.
    """
    copy = stage(df.repartitionByRange(*order).sortWithinPartitions(*order), "ranked")
    return number_written(copy, name), copy
