"""Objects made once on the driver and once per Python worker."""

from __future__ import annotations

from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession


# Rows that Spark hands to Python at a time: its default, and what texts get.
BATCH, DEFAULT, TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def small_batches(spark: SparkSession) -> None:
    """Hand 1,000 rows at a time to Python, unless the session has its own number.

    Rows here are whole texts; ten thousand of them in every worker, and again
    in the buffers of the executor, is memory that no task needs.
    """
    if spark.conf.get(BATCH) == DEFAULT:
        spark.conf.set(BATCH, TEXTS)


def share(spark: SparkSession, thing: Any) -> Broadcast:
    """Broadcast an object with the code of its class; its size must be bounded."""
    small_batches(spark)
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def held(shared: Broadcast) -> Any:
    """The object in a task; a worker keeps it, and what it remembers, for later tasks."""
    made = getattr(shared, "held", None)
    if made is None:
        made = shared.held = cloudpickle.loads(shared.value)
    return made
