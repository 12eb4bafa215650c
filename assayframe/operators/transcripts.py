"""Agent transcripts (JSON lines) to texts, tool calls, sessions and errors.

Two shapes are read. *Block streams* have assistant messages with text and tool-use blocks and a final result. *Item
streams* have completed items (messages, commands, ...) and errors. Lines that are blank, malformed or no object are
skipped. A transcript is grouped by its turn; lines of one turn must fit one group's memory.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.shared import bounded_batches

#: fixed values: items that are tool calls, and their keys that are not input
TOOL_ITEMS = ("command_execution", "mcp_tool_call", "file_change", "web_search")
ENVELOPE = ("id", "type", "status")
_STRIP = r"(?U)^\s+|\s+$"


def decode(raw: Column) -> Column:
    """A line as a variant, null unless it is a JSON object."""
    value = F.try_parse_json(raw)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _ordered(name: str, when: Column, value: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(when, F.struct("line_no", value.alias("value"))))).alias(name)


def block_stream(lines: DataFrame, keys: tuple[str, ...] = ("task_key", "turn")) -> DataFrame:
    """(keys, line_no, raw) to text, tool_calls (array of name and input JSON) and session_id of each turn."""
    event = lines.select(*keys, "line_no", decode(F.col("raw")).alias("e")).where("e is not null")
    kind = _get(F.col("e"), "$.type")
    content = _get(F.col("e"), "$.message.content", "array<variant>")
    parts = event.select(
        *keys,
        "line_no",
        F.when((kind == "system") & (_get(F.col("e"), "$.subtype") == "init"), F.nullif(_get(F.col("e"), "$.session_id"), F.lit(""))).alias("session"),
        F.when((kind == "result") & F.schema_of_variant(F.try_variant_get("e", "$.result", "variant")).isin("STRING"), _get(F.col("e"), "$.result")).alias("result"),
        F.when(kind == "assistant", content).alias("content"),
    )
    is_text, is_tool = lambda b: _get(b, "$.type") == "text", lambda b: _get(b, "$.type") == "tool_use"
    parts = parts.select(
        *keys,
        "line_no",
        "session",
        "result",
        F.array_join(F.transform(F.filter("content", is_text), lambda b: F.coalesce(_get(b, "$.text"), F.lit(""))), "").alias("text"),
        F.transform(F.filter("content", is_tool), lambda b: F.struct(_get(b, "$.name").alias("name"), F.to_json(_get(b, "$.input", "variant")).alias("input"))).alias("tools"),
    )
    turns = parts.groupBy(*keys).agg(
        _ordered("texts", F.col("text").isNotNull(), F.col("text")),
        _ordered("tools", F.col("tools").isNotNull(), F.col("tools")),
        F.max_by("session", F.when(F.col("session").isNotNull(), F.col("line_no"))).alias("session_id"),
        F.max_by("result", F.when(F.col("result").isNotNull(), F.col("line_no"))).alias("result"),
    )
    text = F.regexp_replace(F.array_join(F.transform("texts", lambda t: t["value"]), ""), _STRIP, "")
    fallback = F.regexp_replace(F.coalesce("result", F.lit("")), _STRIP, "")
    return turns.select(*keys, F.coalesce(F.nullif(text, F.lit("")), fallback).alias("text"), F.flatten(F.transform("tools", lambda t: t["value"])).alias("tool_calls"), "session_id")


@F.pandas_udf(T.StringType())
def _item_input(items: pd.Series) -> pd.Series:
    """An item without its envelope keys, in the order it came in."""
    return items.map(lambda x: None if x is None else json.dumps({k: v for k, v in json.loads(x)["item"].items() if k not in ENVELOPE}, ensure_ascii=False))


def item_stream(lines: DataFrame, keys: tuple[str, ...] = ("task_key", "turn"), inputs: bool = True) -> DataFrame:
    """(keys, line_no, raw) to text, tool_calls, thread_id and error of each turn; inputs=False leaves tool inputs out and needs no Python."""
    event = lines.select(*keys, "line_no", "raw", decode(F.col("raw")).alias("e")).where("e is not null")
    kind, item = _get(F.col("e"), "$.type"), _get(F.col("e"), "$.item.type")
    done = kind == "item.completed"
    tool = done & item.isin(*TOOL_ITEMS)
    parts = event.select(
        *keys,
        "line_no",
        F.when(done & (item == "agent_message"), F.coalesce(_get(F.col("e"), "$.item.text"), F.lit(""))).alias("text"),
        F.when(kind == "thread.started", _get(F.col("e"), "$.thread_id")).alias("thread"),
        F.when(kind == "turn.failed", _get(F.col("e"), "$.error.message")).when(kind == "error", _get(F.col("e"), "$.message")).alias("error"),
        F.when(tool, item).alias("tool"),
        F.when(tool, F.col("raw")).alias("tool_raw"),
    )
    if inputs:
        bounded_batches(lines.sparkSession)
        parts = parts.withColumn("tool_raw", _item_input("tool_raw"))
    last = lambda c, name: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(name)
    value = F.struct(F.col("tool").alias("name"), (F.col("tool_raw") if inputs else F.lit(None).cast("string")).alias("input"))
    turns = parts.groupBy(*keys).agg(last("text", "text"), last("thread", "thread_id"), last("error", "error"), _ordered("tools", F.col("tool").isNotNull(), value))
    return turns.select(*keys, F.regexp_replace(F.coalesce("text", F.lit("")), _STRIP, "").alias("text"), F.transform("tools", lambda t: t["value"]).alias("tool_calls"), "thread_id", "error")


def whole_answers(turns: DataFrame, key: str = "task_key", placeholder: str = "(no text response)") -> DataFrame:
    """Turns to one answer a task: the last turn's text (a placeholder if empty) and all turns' tool calls in order."""
    joined = turns.groupBy(key).agg(F.max_by("text", "turn").alias("text"), F.array_sort(F.collect_list(F.struct("turn", "tool_calls"))).alias("t"))
    return joined.select(key, F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit(placeholder)).alias("text"), F.flatten(F.transform("t", lambda x: x["tool_calls"])).alias("tool_calls"))


@F.pandas_udf(T.StringType())
def format_tool_calls(calls: pd.Series) -> pd.Series:
    """``- name: input`` with inputs indented by two, one call after the other."""

    def one(own) -> str:
        if own is None or not len(own):
            return "(no tools used)"
        return "\n".join(f"- {c['name']}: {json.dumps(json.loads(c['input']) if c['input'] else {}, indent=2)}" for c in own)

    return calls.map(one)
