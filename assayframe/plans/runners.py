"""Where answers and verdicts come from.

A runner gets tasks as a DataFrame and returns answers for them. ``Replay`` looks them up in recorded tables, which keeps every
plan deterministic; ``Calls`` makes them with a function in the executors. Both run a task's scripts around its answer.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions.text import format_prompt, template
from assayframe.functions.verdicts import verdict
from assayframe.operators import scripts
from assayframe.operators.transcripts import format_tool_calls
from assayframe.shared import bounded_batches

KEYS = ("case_key", "agent", "skill_key", "iteration")
JUDGE_ATTEMPTS = 2
#: what can go wrong in a run but for its answer
ERRORS = ("script_error", "call_error", "teardown_error")
JUDGE_PROMPT = "Decide whether the response meets the expectation.\n\nPrompt:\n$prompt\n\nResponse:\n$response\n\nTools used:\n$tools\n\nExpected:\n$expected\n\nAnswer with a JSON object {\"pass\": true or false, \"reasoning\": text}."


class Runner(Protocol):
    def answers(self, tasks: DataFrame) -> DataFrame:
        """tasks with response (null: the run failed) and tool_calls; where scripts ran, with the errors of scripts.ADDED."""

    def verdicts(self, asked: DataFrame) -> DataFrame:
        """(KEYS, attempt, answer) for rows with KEYS and judge_prompt."""


class Replay:
    """Answers and verdicts from recorded tables."""

    def __init__(self, answers: DataFrame, verdicts: DataFrame | None = None):
        self._answers, self._verdicts = answers, verdicts

    def answers(self, tasks: DataFrame) -> DataFrame:
        found = tasks.join(self._answers.select(*KEYS, "response", "tool_calls"), list(KEYS), "left")
        if not {"setup", "teardown"} <= set(tasks.columns):
            return found
        # only tasks with scripts leave the JVM
        has = F.coalesce("setup", "teardown").isNotNull()
        plain = found.where(~has).withColumns({c: F.lit(None).cast("string") for c in ERRORS})
        return plain.unionByName(scripts.around(found.where(has)))

    def verdicts(self, asked: DataFrame) -> DataFrame:
        if self._verdicts is None:
            return asked.select(*KEYS, F.lit(1).alias("attempt"), F.lit(None).cast("string").alias("answer"))
        return asked.select(*KEYS).join(self._verdicts, list(KEYS)).select(*KEYS, "attempt", "answer")


class Calls:
    """Answers and verdicts from functions that are called in the executors.

    ``ask(task, home)`` gives (response, [(tool, input as JSON)]); ``judge(prompt)`` gives a verdict's text. A call that raises counts as a failed run,
    and one of the judge as an attempt without a verdict. ``parallel`` is the number of Spark tasks that make calls at a time.
    """

    def __init__(self, ask: scripts.Ask, judge: Callable[[str], str] | None = None, *, parallel: int = 3, cwd: str | None = None, timeout: float = scripts.TIMEOUT):
        self._ask, self._judge, self._parallel, self._cwd, self._timeout = ask, judge, parallel, cwd, timeout

    def answers(self, tasks: DataFrame) -> DataFrame:
        return scripts.around(tasks, self._ask, cwd=self._cwd, timeout=self._timeout, parallel=self._parallel)

    def verdicts(self, asked: DataFrame) -> DataFrame:
        judge = self._judge
        none = asked.select(*KEYS, F.lit(1).alias("attempt"), F.lit(None).cast("string").alias("answer"))
        if judge is None:
            return none

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row, prompt = batch.slice(i, 1), batch.column("judge_prompt")[i].as_py()
                    for attempt in range(1, JUDGE_ATTEMPTS + 1):
                        try:
                            answer = judge(prompt)
                        except Exception:
                            answer = None
                        yield pa.RecordBatch.from_arrays([*[row.column(c) for c in KEYS], pa.array([attempt], pa.int32()), pa.array([answer], pa.string())], [*KEYS, "attempt", "answer"])
                        if answer is not None and _is_verdict(answer):
                            break

        return asked.repartition(self._parallel).mapInArrow(run, none.schema)


def _is_verdict(answer: str) -> bool:
    """Whether an answer holds a JSON object with a truth value for pass; what is taken from it is read on Spark."""
    start, end = answer.find("{"), answer.rfind("}")
    try:
        found = json.loads(answer[start : end + 1])
    except ValueError:
        return False
    return isinstance(found, dict) and any(isinstance(found.get(k), bool) for k in ("pass", "passed"))


def judge_prompt(rows: DataFrame) -> DataFrame:
    """rows with judge_prompt: what the case asked, the answer, each tool call with its input, and what was expected."""
    bounded_batches(rows.sparkSession)
    return rows.withColumn("judge_prompt", template(JUDGE_PROMPT, prompt=format_prompt(F.col("prompt"), F.col("prompt_is_list")), response=F.col("response"), tools=format_tool_calls("tool_calls"), expected=F.col("expected")))


def first_valid(answers: DataFrame) -> DataFrame:
    """The first valid verdict of at most JUDGE_ATTEMPTS attempts; pass is null where there is none."""
    read = answers.where(F.col("attempt") <= JUDGE_ATTEMPTS).withColumn("v", verdict(F.col("answer")))
    valid = F.when(F.col("v.pass").isNotNull(), F.col("attempt"))
    return read.groupBy(*KEYS).agg(F.min_by("v", valid).alias("judgment"))
