"""Prompts for writing and improving skills, as columns over tables of cases, failures and rounds.

Only what a prompt shows is gathered: the first few failures and cases and the last few rounds, each cut by a top-n that tasks apply first. A draft
shows every case of its set, as one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.text import template

DRAFT = "Write a skill document (SKILL.md, with name and description in its frontmatter) for the skill $name. These cases say what it has to do.\n\n$cases$extra"
IMPROVE = "Improve this skill document so that the runs below would have met their expectations.\n\nDocument:\n$skill\n\nRuns:\n$failures\n$tip"
PROPOSE = "Propose a better instruction than the current one.\n\nCurrent:\n$skill\n\nFailed runs:\n$failures\n\nEarlier tries:\n$history\n\nExamples:\n$examples"
NO_FAILURES, NO_HISTORY = "(none failed)", "(none yet)"
#: failures, rounds and cases that a proposal shows, and characters of a response and of an instruction
SHOWN, RESPONSE_CHARS, INSTRUCTION_CHARS = 3, 200, 100


def _first(rows: DataFrame, order: list[Column], line: Column, most: int | None = None) -> DataFrame:
    """One row (told): the lines of the first rows in that order, one below the other."""
    chosen = rows.select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("o"), line.alias("line"))
    if most is not None:
        chosen = chosen.orderBy("o").limit(most)
    return chosen.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("told"))


def _one(prompt: DataFrame, **texts: DataFrame) -> DataFrame:
    """One-row tables side by side, joined on a constant."""
    out = prompt.withColumn("_k", F.lit(1))
    for name, rows in texts.items():
        out = out.join(rows.select(F.lit(1).alias("_k"), F.col("told").alias(name)), "_k")
    return out.drop("_k")


def _shown(text: Column, most: int) -> Column:
    return F.concat(F.left(text, F.lit(most)), F.lit("..."))


def draft_prompt(cases: DataFrame, name: str, extra: str | None = None) -> DataFrame:
    """One row (prompt) that asks for a skill document from cases (case_idx, prompt, expected), numbered from 1."""
    line = template("## Case $n\nPrompt: $prompt\nExpected: $expected\n", n=F.col("case_idx") + 1, prompt=F.array_join("prompt", "\n"), expected=F.col("expected"))
    told = _first(cases, [F.col("case_idx")], line)
    return told.select(template(DRAFT, name=F.lit(name), cases=F.col("told"), extra=F.lit(f"\nAlso: {extra}\n" if extra else "")).alias("prompt"))


def _failure_lines(failures: DataFrame) -> Column:
    return template("- Prompt: $prompt\n  Expected: $expected\n  Got: $got\n  Reason: $reason", prompt=F.array_join("prompt", "\n"), expected=F.col("expected"), got=F.col("response_preview"), reason=F.col("reasoning"))


def improve_prompt(skill: str, failures: DataFrame, tip: str | None = None) -> DataFrame:
    """One row (prompt) that asks for an improved document, given what failed (``evaluate.failure_summaries``)."""
    told = _first(failures, [F.col("source"), F.col("iteration")], _failure_lines(failures))
    return told.select(template(IMPROVE, skill=F.lit(skill), failures=F.col("told"), tip=F.lit(f"Style: {tip}\n" if tip else "")).alias("prompt"))


def proposal_prompt(skill: str, failures: DataFrame, rounds: DataFrame, cases: DataFrame) -> DataFrame:
    """One row (prompt) that asks for a better instruction: SHOWN failures, last rounds with their rates, and cases."""
    failed = template("- Prompt: $prompt\n  Expected: $expected\n  Got: $got", prompt=F.array_join("prompt", "\n"), expected=F.col("expected"), got=_shown(F.col("response_preview"), RESPONSE_CHARS))
    tried = template("- Score: $rate%\n  Instruction: $skill", rate=F.format_string("%.0f", "pass_rate"), skill=_shown(F.col("skill"), INSTRUCTION_CHARS))
    example = template("- Input: $prompt\n  Expected: $expected", prompt=F.array_join("prompt", "\n"), expected=F.col("expected"))
    last = rounds.orderBy(F.desc("round")).limit(SHOWN)
    texts = {
        "failures": _first(failures, [F.col("source"), F.col("iteration")], failed, SHOWN),
        "history": _first(last, [F.col("round")], tried),
        "examples": _first(cases, [F.col("case_idx")], example, SHOWN),
    }
    row = _one(cases.sparkSession.range(1).select(F.lit(skill).alias("skill")), **texts)
    or_else = lambda name, text: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(text))
    return row.select(template(PROPOSE, skill=F.col("skill"), failures=or_else("failures", NO_FAILURES), history=or_else("history", NO_HISTORY), examples=F.col("examples")).alias("prompt"))
