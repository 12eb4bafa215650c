"""Verdicts in judges' answers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions.text import json_in_prose
from assayframe.shared import bounded_batches

# What counts as a boolean in a verdict.
TRUE_WORDS = ("true", "1", "yes", "y", "on", "t")
FALSE_WORDS = ("false", "0", "no", "n", "off", "f")


def _truth(value) -> bool | None:
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) and value in (0, 1):
        return bool(value)
    if isinstance(value, str):
        low = value.lower()
        return True if low in TRUE_WORDS else False if low in FALSE_WORDS else None
    return None


def read_verdict(text: str | None) -> tuple[bool | None, str | None]:
    """(pass, reasoning) of a verdict's JSON; pass is null where it is not a valid verdict."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return None, None
    if not isinstance(value, dict):
        return None, None
    passed = _truth(value.get("pass", value.get("passed")))
    reasoning = value.get("reasoning", "")
    return (passed, reasoning) if passed is not None and isinstance(reasoning, str) else (None, None)


_VERDICT = T.StructType([T.StructField("pass", T.BooleanType()), T.StructField("reasoning", T.StringType())])


@F.pandas_udf(_VERDICT)
def _verdicts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts:
        yield pd.DataFrame([read_verdict(t) for t in texts], columns=["pass", "reasoning"]).astype({"pass": "object", "reasoning": "object"})


def verdict(answer: Column) -> Column:
    """struct<pass,reasoning> of an answer, exact in what counts as a boolean; pass is null if there is no valid verdict."""
    bounded_batches()
    return _verdicts(json_in_prose(answer))


def plain_verdict(answer: Column) -> Column:
    """The same without Python, for verdicts whose pass is a JSON boolean."""
    value = F.try_parse_json(json_in_prose(answer))
    passed = F.coalesce(F.try_variant_get(value, "$.pass", "boolean"), F.try_variant_get(value, "$.passed", "boolean"))
    return F.struct(passed.alias("pass"), F.when(passed.isNotNull(), F.coalesce(F.try_variant_get(value, "$.reasoning", "string"), F.lit(""))).alias("reasoning"))
