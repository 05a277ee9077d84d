"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Everything here may also be set by the cluster; nothing depends on a machine.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join also where its output then has to be shuffled again.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings to a session builder: UTC dates and adaptive execution."""
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return builder
