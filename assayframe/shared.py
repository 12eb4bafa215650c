"""What driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode, as in tests; on a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='assayframe-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, so that what a runner did is never done twice."""
    folder = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def bounded_batches(spark: SparkSession | None = None, most: int = 8 << 20) -> None:
    """At most so many bytes in a batch between Spark and Python, whatever the length of texts. Every operator that sends texts to Python asks for the same."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    (spark or SparkSession.active()).conf.set(key, str(most))


def give_back() -> None:
    """Hand memory that a Python worker has freed back to the system, for a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
