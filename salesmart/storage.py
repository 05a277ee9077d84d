"""Written intermediate results in the shared folder the cluster names."""

from __future__ import annotations

import logging
import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("salesmart")

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")


def quoted(name: str) -> str:
    """A table or database name checked and quoted, safe to put into SQL text."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"Not a table name: {name!r}")
    return ".".join(f"`{part}`" for part in name.split("."))


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    ``spark.checkpoint.dir`` of the session decides. Where nothing is set, a
    local session gets a temporary folder; a cluster session is an error, since
    a folder of the driver machine would not be seen by the executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise RuntimeError("Set spark.checkpoint.dir to a shared folder")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="salesmart-"))
        configured = context.getCheckpointDir()
    return f"{configured.rstrip('/')}/salesmart/{spark.conf.get('spark.app.id')}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system of the session, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has left in the shared folder."""
    delete_path(spark, work_dir(spark))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Staged:
    """Rows read back from a written copy."""

    rows: DataFrame
    path: str

    def release(self) -> None:
        """Delete the copy. A failure is logged: it must not hide what went before."""
        try:
            delete_path(self.rows.sparkSession, self.path)
        except Exception:
            log.exception("Could not delete %s", self.path)


def stage(df: DataFrame, name: str) -> Staged:
    """Write rows once as Parquet and continue from the written copy.

    Used before steps that read the same rows several times. Unlike
    ``checkpoint()`` the copy is columnar, so each later reader fetches only its
    own columns; its size is known to the planner; and it lives outside the
    executors. Copies that are not released stay, as those of ``checkpoint()``
    do, until the owner of the folder clears it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return Staged(df.sparkSession.read.schema(df.schema).parquet(path), path)
