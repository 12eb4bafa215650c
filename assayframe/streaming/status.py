"""States and transcripts while they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.operators import status
from assayframe.streaming.upsert import UpsertTable

EVENTS = "case_idx int, iteration int, state string, passed boolean, seq bigint"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """State changes as JSON lines; lines that cannot be read have no state and are dropped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.select(F.from_json("value", EVENTS).alias("e")).select("e.*").where("state is not null and case_idx is not null")


def state_table(spark: SparkSession, path: str, buckets: int = 64) -> UpsertTable:
    """The table of task states at a path, as ``keep_states`` writes it."""
    return UpsertTable(spark, path, ("case_idx", "iteration"), "seq", EVENTS, buckets)


def keep_states(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, buckets: int = 64):
    """A query that keeps the latest state of every task in the table at ``path``: only what a batch touches is written, and a replayed batch changes nothing."""
    table = state_table(events.sparkSession, path, buckets)
    writer = events.writeStream.foreachBatch(lambda batch, batch_id: table.upsert(batch, batch_id)).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def follow_states(events: DataFrame, name: str, checkpoint: str, trigger: dict | None = None):
    """A query that keeps the latest state of every task in an in-memory table of that name, by updates."""
    writer = status.latest_state(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
