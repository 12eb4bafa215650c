"""States of tasks, for reports while a run goes on and after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.operators.numbering import numbered

#: fixed values: state symbols
SYMBOLS = {"pending": "○", "cached": "●", "running": "◐", "pass": "✓", "fail": "✗"}


def task_key(case_idx: Column, iteration: Column) -> Column:
    return F.concat_ws(":", case_idx, iteration)


def latest_state(events: DataFrame) -> DataFrame:
    """The last state of each task, from (case_idx, iteration, state, passed, seq); works on a stream in update mode."""
    last = F.max_by(F.struct("state", "passed"), "seq").alias("last")
    return events.groupBy("case_idx", "iteration").agg(last).select("case_idx", "iteration", "last.state", "last.passed")


def bucket(state: Column, passed: Column) -> Column:
    """pass or fail for what is done; cached is a bucket of its own whatever the result."""
    return F.when(state == "done", F.when(passed, "pass").otherwise("fail")).otherwise(state)


def symbol(kind: Column) -> Column:
    out = None
    for name, sign in SYMBOLS.items():
        out = F.when(kind == name, sign) if out is None else out.when(kind == name, sign)
    return out.otherwise("?")


def state_counts(states: DataFrame, *keys: str) -> DataFrame:
    """Tasks in each bucket."""
    kind = bucket(F.col("state"), F.col("passed"))
    return states.groupBy(*keys).agg(*[F.count_if(kind == name).alias(f"n_{name}") for name in ("pass", "fail", "running", "cached", "pending")])


def case_percent(states: DataFrame, final: bool) -> DataFrame:
    """Pass percentage of each case: while running only where every task is done, at the end over all its tasks."""
    done, good = F.col("state").isin("done", "cached"), F.coalesce("passed", F.lit(False))
    counted = states.groupBy("case_idx").agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(done & good).alias("good"))
    rate = F.col("good") / F.col("total") * 100.0
    return counted.select("case_idx", "total", "done", F.when(F.lit(final) | (F.col("done") == F.col("total")), rate).alias("percent"))


def compact_percent(states: DataFrame) -> DataFrame:
    """Passes of all that passed or failed in this run, in percent; cached results are left out."""
    counts = state_counts(states)
    over = F.col("n_pass") + F.col("n_fail")
    return counts.select(F.when(over > 0, F.col("n_pass") / over * 100.0).alias("percent"))


def report(states: DataFrame) -> DataFrame:
    """The lines of a report in order of the cases: (line, case_idx, symbols of the iterations, percent); line counts from 1."""
    kinds = states.withColumn("s", symbol(bucket(F.col("state"), F.col("passed"))))
    lines = kinds.groupBy("case_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("iteration", "s"))), lambda x: x["s"]), " ").alias("symbols"))
    both = lines.join(case_percent(states, False).select("case_idx", "percent"), "case_idx")
    return numbered(both, "case_idx", name="line", first=1)
