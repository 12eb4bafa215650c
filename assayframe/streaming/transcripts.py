"""Transcripts of turns put together while their files grow.

Lines of a turn wait in the state store, by place, until the turn's last line has come (a result, or a turn that was completed or failed) or no line has come for
``idle``; then they are released as one group and leave the state. What is released is read by the batch operators, so a stream's transcripts
are those of ``operators.transcripts`` over the same lines. State is in proportion to the turns that are under way: finished ones leave nothing, but lines that
come after a turn's end are a group of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assayframe.operators import transcripts
from assayframe.streaming.upsert import UpsertTable

#: fixed values: kinds of lines that end a turn
ENDS = ("result", "turn.completed", "turn.failed")
RELEASED = "task_key string, turn int, lines array<struct<line_no:bigint,raw:string>>, ended boolean"
TURNS = "task_key string, turn int, text string, tool_calls array<struct<name:string,input:string>>, session_id string, ended boolean, batch_id bigint"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def named_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, raw) of ``key.turn.jsonl`` files to (task_key, turn, line_no, raw, ends)."""
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.jsonl$", "")
    turn = F.regexp_extract(name, r"\.(\d+)$", 1)
    return lines.select(F.regexp_replace(name, r"\.\d+$", "").alias("task_key"), F.when(turn == "", 0).otherwise(turn.try_cast("int")).alias("turn"), "line_no", "raw", ends_turn(F.col("raw")).alias("ends"))


def ends_turn(raw: Column) -> Column:
    return F.coalesce(F.try_variant_get(transcripts.decode(raw), "$.type", "string").isin(*ENDS), F.lit(False))


class _Turns(StatefulProcessor):
    """Keeps the lines of a turn until it ends."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "line_no bigint, raw string")
        self.due = handle.getValueState("due", "at bigint")

    def _release(self, key: tuple, rows: list[tuple[int, str]], ended: bool) -> Iterator[pd.DataFrame]:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.lines.clear()
        self.due.clear()
        yield pd.DataFrame({"task_key": [key[0]], "turn": pd.array([key[1]], dtype="Int32"), "lines": [[{"line_no": n, "raw": r} for n, r in sorted(rows)]], "ended": [ended]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, ended = [], False
        for part in rows:
            new += zip(part["line_no"].tolist(), part["raw"].tolist())
            ended |= bool(part["ends"].any())
        if ended:
            yield from self._release(key, [*map(tuple, self.lines.get()), *new], True)
            return
        self.lines.appendList(new)
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, list(map(tuple, self.lines.get())), False)

    def close(self) -> None:
        pass


def whole_turns(lines: DataFrame, idle: float = 600.0) -> DataFrame:
    """A stream of (task_key, turn, line_no, raw, ends) to RELEASED: the lines of each turn once it has ended."""
    return lines.groupBy("task_key", "turn").transformWithStateInPandas(_Turns(int(idle * 1000)), outputStructType=RELEASED, outputMode="Append", timeMode="ProcessingTime")


def turns_of(released: DataFrame, stream: str = "block") -> DataFrame:
    """Texts, tool calls and sessions of released turns, by the batch operator of that kind of stream."""
    lines = released.select("task_key", "turn", F.inline("lines"))
    if stream == "block":
        read = transcripts.block_stream(lines)
    else:
        read = transcripts.item_stream(lines).withColumnRenamed("thread_id", "session_id")
    return read.select("task_key", "turn", "text", "tool_calls", "session_id").join(released.groupBy("task_key", "turn").agg(F.max("ended").alias("ended")), ["task_key", "turn"])


def turn_table(spark, path: str, buckets: int = 64) -> UpsertTable:
    return UpsertTable(spark, path, ("task_key", "turn"), "batch_id", TURNS, buckets)


def follow(lines: DataFrame, path: str, checkpoint: str, *, stream: str = "block", idle: float = 600.0, trigger: dict | None = None):
    """A query that keeps the table of turns at ``path`` up to date from a stream of (file, line_no, raw)."""
    spark = lines.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    table = turn_table(spark, path)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        table.upsert(turns_of(batch, stream).withColumn("batch_id", F.lit(batch_id).cast("bigint")), batch_id)
        batch.unpersist()

    writer = whole_turns(named_lines(lines), idle).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
