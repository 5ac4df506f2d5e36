"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one, as in tests, gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="driftloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Rows of ids and hashes that make one checkpoint file at most.
ROWS_PER_FILE = 250_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written to the folder that all executors share, ``spark.checkpoint.dir``, and read from there.

    Where it is known that there are at most ``rows`` narrow rows, they are dealt to as few files as
    ``ROWS_PER_FILE`` allows, so that small tables don't litter the shared store with a file a partition; what
    computes them runs as wide as before.  Spark deletes a checkpoint once nothing refers to it where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    _shared(df.sparkSession)
    return (df if rows is None else df.repartition(max(1, -(-rows // ROWS_PER_FILE)))).checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{_shared(spark)}/{uuid.uuid4()}"


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
