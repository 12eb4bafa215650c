"""The improvement loop: evaluate, record, stop at the target, propose, repeat; a run that was interrupted goes on where it stopped.

A run is a folder. ``run.json`` says what it is of and when it began; each round is one evaluation on Spark, whose results go to ``evals/round=N`` and whose
outcome, with the proposal for the next round, then to ``rounds/round=N``. That second write is the round's end: a run that starts again reads the rounds that
ended, takes up the last proposal, and evaluates only what is left. Results stay on Spark; the driver sees one rate and one skill document a round.
"""

from __future__ import annotations

import json
import platform
import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.errors import SkillError
from assayframe.operators.rounds import best_round
from assayframe.plans.evaluate import Evaluation, evaluate
from assayframe.plans.runners import Runner
from assayframe.shared import shared_dir
from assayframe.sources.results import exists, read_text, run_json, write_text

VERSION = "0.3"
_EVAL = "source string, passed boolean, reasoning string, response string, tool_calls array<struct<name:string,input:string>>, score double, round int"
_ROUND = "run string, pass_rate double, skill string, tip string, proposed string, round int"
#: the document of a run
DOCUMENT = (
    "metadata struct<version:string,python_version:string,platform:string,started_at:string,completed_at:string,eval_set:string,original_skill_path:string>, "
    "config struct<max_rounds:int,target_pass_rate:double,samples:int,parallel:int>, result struct<success:boolean,final_pass_rate:double,rounds_completed:int,best_round:int>, "
    "original_skill string, best_skill string, rounds array<struct<round:int,pass_rate:double,skill_content:string,tip_used:string,"
    "evals:array<struct<source:string,passed:boolean,reasoning:string,response:string,tool_calls:array<struct<name:string,input:string>>>>>>"
)


def eval_results(results: DataFrame) -> DataFrame:
    """Results of an evaluation as a round keeps them, with the score of each: 1 or 0."""
    return results.select(
        F.col("case_source").alias("source"), "passed", F.coalesce("judgment.reasoning", F.lit("")).alias("reasoning"), F.coalesce("response", F.lit("")).alias("response"), "tool_calls", F.col("passed").cast("double").alias("score")
    )


def _now() -> str:
    return datetime.now(UTC).isoformat()


@dataclass
class TuneRun:
    """A run as its folder has it."""

    spark: SparkSession
    path: str

    def head(self) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/run.json"))

    @property
    def rounds(self) -> DataFrame:
        """(run, round, pass_rate, skill, tip, proposed) of the rounds that ended."""
        ended = [n for n in range(1, self.head()["config"]["max_rounds"] + 1) if exists(self.spark, f"{self.path}/rounds/round={n}/_SUCCESS")]
        if not ended:
            return self.spark.createDataFrame([], _ROUND)
        return self.spark.read.schema(_ROUND).option("basePath", f"{self.path}/rounds").parquet(*[f"{self.path}/rounds/round={n}" for n in ended])

    @property
    def evals(self) -> DataFrame:
        """Results of those rounds: (source, passed, reasoning, response, tool_calls, score, round)."""
        numbers = [r["round"] for r in self.rounds.select("round").collect()]
        if not numbers:
            return self.spark.createDataFrame([], _EVAL)
        return self.spark.read.schema(_EVAL).option("basePath", f"{self.path}/evals").parquet(*[f"{self.path}/evals/round={n}" for n in numbers])

    def _best(self) -> tuple[int, float, str]:
        """(round, rate, skill) of the best round, the latest of equals; round 0 if none ended."""
        best = best_round(self.rounds).first()
        if best is None:
            return 0, 0.0, self.head()["original_skill"]
        return best["best_round"], best["best_rate"], self.rounds.where(F.col("round") == best["best_round"]).first()["skill"]

    @property
    def best_round(self) -> int:
        return self._best()[0]

    @property
    def best_rate(self) -> float:
        return self._best()[1]

    @property
    def best_skill(self) -> str:
        return self._best()[2]

    @property
    def success(self) -> bool:
        return self.best_round > 0 and self.best_rate >= self.head()["config"]["target_pass_rate"]

    def document(self) -> DataFrame:
        """One row with all of the run: metadata, config, result, the first and the best skill, and the rounds with their results."""
        number, rate, skill = self._best()
        head = self.head()
        told = self.evals.groupBy("round").agg(F.array_sort(F.collect_list(F.struct("source", "passed", "reasoning", "response", "tool_calls"))).alias("evals"))
        rows = self.rounds.join(told, "round", "left").select(F.struct("round", "pass_rate", F.col("skill").alias("skill_content"), F.col("tip").alias("tip_used"), F.coalesce("evals", F.array()).alias("evals")).alias("r"))
        whole = rows.agg(F.array_sort(F.collect_list("r")).alias("rounds"), F.count("*").alias("n"))
        result = {"success": self.success, "final_pass_rate": rate, "best_round": number}
        text = F.lit(json.dumps({**head, "result": result, "best_skill": skill}))
        read = whole.select(F.from_json(text, DOCUMENT).alias("d"), "rounds", F.col("n").cast("int").alias("n"))
        return read.select("d.metadata", "d.config", F.col("d.result").withField("rounds_completed", F.col("n")).alias("result"), "d.original_skill", "d.best_skill", "rounds")

    def save(self, path: str) -> None:
        """The document as one indented JSON file, for people and for ``load_document``."""
        write_text(self.spark, path, run_json(self.document().first()), overwrite=True)


def load_document(spark: SparkSession, path: str) -> DataFrame:
    """The document of a run, as ``TuneRun.save`` writes it."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=True)


def begin(spark: SparkSession, path: str, skill: str, config: dict, set_name: str = "", skill_path: str = "") -> TuneRun:
    """The run in a folder: a new one, or the one that is there, which has to be of the same skill; its settings are those given now."""
    run, started = TuneRun(spark, path.rstrip("/")), _now()
    if exists(spark, f"{run.path}/run.json"):
        head = run.head()
        if head["original_skill"] != skill:
            raise SkillError(f"{path} holds a run of another skill")
        started = head["metadata"]["started_at"]
    about = {"version": VERSION, "python_version": f"{sys.version_info.major}.{sys.version_info.minor}", "platform": platform.system()}
    about |= {"started_at": started, "completed_at": "", "eval_set": set_name, "original_skill_path": skill_path}
    write_text(spark, f"{run.path}/run.json", json.dumps({"metadata": about, "config": config, "original_skill": skill}, indent=2), overwrite=True)
    return run


def tune(
    cases: DataFrame,
    skill: str,
    runner: Callable[[str, int], Runner],
    propose: Callable[[str, Evaluation], str],
    *,
    agent: str,
    max_rounds: int = 5,
    target: float = 100.0,
    samples_per_case: int = 1,
    parallel: int = 3,
    on_round: Callable[[int, float], None] | None = None,
    store: str | None = None,
    set_name: str = "",
    skill_path: str = "",
    tip: str | None = None,
) -> TuneRun:
    """Each round is one uncached evaluation; ``runner(skill, round)`` gives the round's runner. In a ``store`` with rounds of the run, only those left are run.

    The best round is the one with the highest rate, the latest of equals; the proposal after the last round is not asked for.
    """
    spark = cases.sparkSession
    path = store or f"{shared_dir(spark)}/tune-{uuid.uuid4().hex}"
    run = begin(spark, path, skill, {"max_rounds": max_rounds, "target_pass_rate": target, "samples": samples_per_case, "parallel": parallel}, set_name, skill_path)
    plain = cases.drop("assertions", "setup", "teardown").selectExpr("*", "cast(null as array<struct<type:string,value:string>>) as assertions", "cast(null as string) as setup", "cast(null as string) as teardown")
    last = run.rounds.orderBy(F.desc("round")).first()
    number, rate = (last["round"], last["pass_rate"]) if last else (0, -1.0)
    if last and last["proposed"] is not None:
        skill = last["proposed"]
    while number < max_rounds and rate < target:
        number += 1
        got = evaluate(plain, runner(skill, number), agent=agent, skill_key=f"round-{number}", samples_per_case=samples_per_case, skip_cache=True)
        eval_results(got.results).write.mode("overwrite").parquet(f"{run.path}/evals/round={number}")
        rate = float(got.summary.first()["pass_rate"])
        proposed = propose(skill, got) if rate < target and number < max_rounds else None
        row = spark.createDataFrame([("run", rate, skill, tip, proposed)], _ROUND.rsplit(", ", 1)[0])
        row.coalesce(1).write.mode("overwrite").parquet(f"{run.path}/rounds/round={number}")
        if on_round:
            on_round(number, rate)
        skill = proposed
    head = run.head()
    head["metadata"]["completed_at"] = _now()
    write_text(spark, f"{run.path}/run.json", json.dumps(head, indent=2), overwrite=True)
    return run


def write_back(run: TuneRun, path: str, spark: SparkSession) -> bool:
    """Put the best skill in the place of the original, once the run is over; False if the original was the best."""
    best = run.best_skill
    if best == run.head()["original_skill"]:
        return False
    write_text(spark, path, best, overwrite=True)
    return True
