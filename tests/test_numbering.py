import random

from pyspark.sql import functions as F

from salesmart.operators.numbering import number_written, ranked
from salesmart.storage import stage


def test_written_rows_are_numbered_without_gaps(spark):
    copy = stage(spark.range(1000, numPartitions=7).filter("id % 3 > 0"), "rows")
    rows = number_written(copy, "n")
    first = sorted(rows.collect())
    assert sorted(r.n for r in first) == list(range(len(first)))
    assert sorted(rows.repartition(3).collect()) == first
    # The order of the partitions that wrote them.
    assert [r.id for r in sorted(first, key=lambda r: r.n)] == [r.id for r in first]


def test_ranks_follow_the_order_over_all_tasks(spark):
    values = list(range(500)) + [7] * 300
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, n) for n, v in enumerate(values)], "v long, n long")
    # Small tables would be put together to one task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, copy = ranked(df, "v", "n", name="place")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = [(r.v, r.n) for r in rows.orderBy("place").collect()]
    assert got == sorted((v, n) for n, v in enumerate(values))
    # The value that most rows share does not make one task of them.
    per_file = copy.rows.groupBy(F.col("_metadata.file_name")).count().collect()
    assert len(per_file) > 1 and max(r["count"] for r in per_file) < 600


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None,), (2,), (1,), (None,)], "v int")
    rows, _ = ranked(df, F.asc_nulls_first("v"), name="place")
    assert [tuple(r) for r in rows.orderBy("place").collect()] == [(None, 0), (None, 1), (1, 2), (2, 3)]
    rows, _ = ranked(df.limit(0), "v", name="place")
    assert rows.count() == 0
