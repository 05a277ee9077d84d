"""Values to choose filters from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.operators.numbering import ranked

# The filters in their order, and their first entries.
FILTERS = {
    "year": "All Years",
    "quarter": "All Quarters",
    "category": "All Categories",
    "product": "All Products",
    "region": "All Regions",
}


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"))


def filter_options(df: DataFrame) -> DataFrame:
    """Every filter's choices as (filter, label, value), in the order to show them.

    ``filter_pos`` numbers the filters, ``pos`` the choices of one: its ``all``
    entry is 0, the others follow by value. Combinations are made distinct, by
    each task for its own rows before the shuffle, and only then unpivoted. The
    distinct values are numbered over all tasks, ranges of them in each, so that
    no task holds all products; the written ranges stay in the shared folder for
    as long as the result reads them.
    """
    texts = df.select(*[F.col(name).cast("string").alias(name) for name in FILTERS]).distinct()
    values = texts.unpivot([], list(FILTERS), "filter", "value")
    values = values.filter(F.col("value").isNotNull()).distinct()
    names = F.array(*[F.lit(name) for name in FILTERS])
    placed = values.withColumn("filter_pos", F.array_position(names, F.col("filter")).cast("int"))
    numbered, _ = ranked(placed, "filter_pos", "value", name="place")
    # One row per filter: where its choices begin.
    begins = numbered.groupBy("filter_pos").agg(F.min("place").alias("begin"))
    label = F.when(F.col("filter") == "quarter", F.concat(F.lit("Q"), "value")).otherwise(
        F.col("value")
    )
    chosen = numbered.join(F.broadcast(begins), "filter_pos").select(
        "filter_pos", (F.col("place") - F.col("begin") + 1).cast("int").alias("pos"),
        "filter", label.alias("label"), "value",
    )
    first_entries = [
        F.struct(
            F.lit(n).alias("filter_pos"), F.lit(0).alias("pos"), F.lit(name).alias("filter"),
            F.lit(text).alias("label"), F.lit("all").alias("value"),
        )
        for n, (name, text) in enumerate(FILTERS.items(), start=1)
    ]
    everything = df.sparkSession.range(1).select(F.inline(F.array(*first_entries)))
    return everything.unionByName(chosen).orderBy("filter_pos", "pos")
