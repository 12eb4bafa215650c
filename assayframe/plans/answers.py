"""Answers that a JSON schema accepts, asked for in rounds.

A round asks for what has no valid answer yet and tells what was wrong with the one before; its answers are checked by the schema's column and kept, so no
call is made twice. The rounds are few and each is smaller than the one before.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.errors import JudgeError
from assayframe.functions.schema import problems
from assayframe.functions.text import json_in_prose, with_schema
from assayframe.shared import kept

ATTEMPTS = 2
NO_ANSWER = "no answer"


def _prompt(prompt: Column, wrong: Column) -> Column:
    again = F.concat(prompt, F.lit("\n\nYour last answer was not accepted:\n"), F.array_join(F.transform(wrong, lambda w: F.concat(F.lit("- "), w)), "\n"))
    return F.when(wrong.isNotNull(), again).otherwise(prompt)


def valid_answers(asked: DataFrame, call: Callable[[DataFrame], DataFrame], schema: dict, *, keys: tuple[str, ...] = ("path",), attempts: int = ATTEMPTS) -> DataFrame:
    """(keys, answer, attempt, problems) for rows with keys and prompt: the first answer that the schema accepts as JSON text, else null and what was wrong last.

    ``call`` gets (keys, prompt) and gives (keys, answer); a row that it leaves out has no answer, which is a reason to ask again.
    """
    names = list(keys)
    plain = kept(asked.select(*names, with_schema(F.col("prompt"), json.dumps(schema)).alias("prompt")))
    todo = plain.withColumn("_wrong", F.lit(None).cast("array<string>"))
    done, last = None, None
    for attempt in range(1, attempts + 1):
        answers = call(todo.select(*names, _prompt(F.col("prompt"), F.col("_wrong")).alias("prompt")))
        read = todo.select(*names).join(answers.select(*names, json_in_prose(F.col("answer")).alias("answer")), names, "left")
        wrong = F.when(F.col("answer").isNull(), F.array(F.lit(NO_ANSWER))).otherwise(problems(F.col("answer"), schema))
        last = kept(read.select(*names, "answer", F.lit(attempt).alias("attempt"), wrong.alias("problems")))
        good = last.where(F.size("problems") == 0)
        done = good if done is None else done.unionByName(good)
        bad = last.where(F.size("problems") > 0)
        todo = plain.join(done.select(*names), names, "left_anti").join(bad.select(*names, F.col("problems").alias("_wrong")), names)
        if attempt < attempts and bad.isEmpty():
            break
    return done.unionByName(last.where(F.size("problems") > 0).withColumn("answer", F.lit(None).cast("string")))


def require_valid(answers: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """The answers, or JudgeError with what is wrong if one has none."""
    if bad := answers.where("answer is null").first():
        raise JudgeError(f"no valid answer for {', '.join(str(bad[k]) for k in keys)}: {'; '.join(bad['problems'])}")
    return answers
