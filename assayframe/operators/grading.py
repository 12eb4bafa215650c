"""Deterministic assertions as columns.

An assertion is struct<type,value>. ``messages`` evaluates all of a row's assertions against its response and the
names of its tool calls in one expression: no row is split up and nothing is shuffled. Only ``regex`` needs Python,
for Python's own dialect; the UDF runs only if ``python_regex`` is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.shared import bounded_batches, give_back

Check = Callable[[Column, Column, Column], tuple[Column, Column]]


def _low(x: Column) -> Column:
    return F.lower(x)


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+$", "")


#: type to (holds, message) of (response, tools, value); add to it for types of your own
CHECKS: dict[str, Check] = {
    "contains": lambda r, t, v: (F.contains(_low(r), _low(v)), F.concat(F.lit("contains: expected response to contain '"), v, F.lit("'"))),
    "not_contains": lambda r, t, v: (~F.contains(_low(r), _low(v)), F.concat(F.lit("not_contains: expected response NOT to contain '"), v, F.lit("'"))),
    "starts_with": lambda r, t, v: (F.startswith(_low(r), _low(v)), F.concat(F.lit("starts_with: expected response to start with '"), v, F.lit("'"))),
    "ends_with": lambda r, t, v: (F.endswith(_stripped(_low(r)), _low(v)), F.concat(F.lit("ends_with: expected response to end with '"), v, F.lit("'"))),
    "tool_called": lambda r, t, v: (F.array_contains(t, v), F.concat(F.lit("tool_called: expected tool '"), v, F.lit("' to be called"))),
    "tool_not_called": lambda r, t, v: (~F.array_contains(t, v), F.concat(F.lit("tool_not_called: expected tool '"), v, F.lit("' NOT to be called"))),
}
TYPES = (*CHECKS, "regex")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _regex_messages(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """For each pattern what is wrong, or null; patterns that are null have nothing wrong."""

    def one(response: str, pattern: str | None) -> str | None:
        try:
            return None if pattern is None or re.search(pattern, response) else f"regex: pattern '{pattern}' did not match"
        except re.error as e:
            return f"regex: invalid pattern '{pattern}': {e}"

    for responses, patterns in batches:
        yield pd.Series([[one(r or "", p) for p in own] if own is not None else [] for r, own in zip(responses, patterns)], dtype="object")
    give_back()


def check(kind: str, response: Column, tools: Column, value: Column) -> Column:
    """Whether one assertion of a known type holds."""
    return F.coalesce(CHECKS[kind](response, tools, value)[0], F.lit(False))


def _told(response: Column, tools: Column, assertions: Column, by_regex: Column | None = None) -> Column:
    """What failed, in the assertions' order; ``by_regex`` has a message or null in the place of each assertion."""
    response, tools = F.coalesce(response, F.lit("")), F.coalesce(tools, F.array().cast("array<string>"))

    def one(a: Column, i: Column) -> Column:
        out = F.when(a["type"] == "regex", F.get(by_regex, i) if by_regex is not None else F.lit(None).cast("string"))
        for kind, build in CHECKS.items():
            holds, text = build(response, tools, a["value"])
            out = out.when(a["type"] == kind, F.when(~F.coalesce(holds, F.lit(False)), text))
        return out.otherwise(F.concat(F.lit("unknown assertion type '"), a["type"], F.lit("'")))

    return F.filter(F.transform(assertions, one), lambda m: m.isNotNull())


def messages(response: Column, tools: Column, assertions: Column) -> Column:
    """What failed, in the assertions' order, for the types in CHECKS."""
    return _told(response, tools, assertions)


def grade(rows: DataFrame, python_regex: bool = True) -> DataFrame:
    """Adds judgment (struct<pass,reasoning>) to rows with response, tools (array of names) and assertions."""
    patterns = F.transform("assertions", lambda a: F.when(a["type"] == "regex", F.coalesce(a["value"], F.lit(""))))
    if python_regex:
        bounded_batches(rows.sparkSession)
        rows = rows.withColumn("_regex", F.when(F.exists("assertions", lambda a: a["type"] == "regex"), _regex_messages(F.col("response"), patterns)))
    failed = _told(F.col("response"), F.col("tools"), F.col("assertions"), F.col("_regex") if python_regex else None)
    return rows.withColumn("_failed", failed).withColumn(
        "judgment",
        F.struct((F.size("_failed") == 0).alias("pass"), F.when(F.size("_failed") == 0, F.lit("All assertions passed")).otherwise(F.array_join("_failed", "; ")).alias("reasoning")),
    ).drop("_failed", "_regex")


def validation_errors(assertions: Column) -> Column:
    """What is wrong with a list of assertions, each with its position; empty if nothing."""

    def one(a: Column, i: Column) -> Column:
        at = F.concat(F.lit("assertion "), i.cast("string"), F.lit(": "))
        return (
            F.when(a.isNull(), F.concat(at, F.lit("must be a mapping")))
            .when(a["type"].isNull(), F.concat(at, F.lit("missing 'type'")))
            .when(~a["type"].isin(*TYPES), F.concat(at, F.lit("unknown type '"), a["type"], F.lit("'")))
            .when(a["value"].isNull(), F.concat(at, F.lit("missing 'value'")))
        )

    return F.filter(F.transform(assertions, one), lambda m: m.isNotNull())
