"""The evaluation of a set of cases: expand, look up, run, grade, keep, summarise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.errors import CaseValidationError, JudgeError
from assayframe.functions.text import case_cache_key, template
from assayframe.operators import grading, samples
from assayframe.plans.runners import ERRORS, KEYS, Runner, first_valid, judge_prompt
from assayframe.shared import kept
from assayframe.sources.store import ResultStore

NO_TEXT = "(no text response)"
RUN_FAILED, NO_VERDICT = "run failed", "no valid verdict"


@dataclass
class Evaluation:
    results: DataFrame
    summary: DataFrame
    per_case: DataFrame
    total_cases: int
    sampled_cases: int


def _grade(answered: DataFrame, runner: Runner) -> DataFrame:
    """judgment and infra_failure for answered tasks: by assertions where a task has any, else by the judge.

    A failed setup or call is the run's response and its reason, and a failure of the surroundings; a failed teardown changes nothing.
    """
    for name in ERRORS:
        if name not in answered.columns:
            answered = answered.withColumn(name, F.lit(None).cast("string"))
    broken = F.coalesce("script_error", F.regexp_extract("call_error", r"^(?s:[^:]*: (.*))$", 1))
    answered = answered.withColumn("broken", F.when(F.col("response").isNull() | broken.isNotNull(), F.coalesce(broken, F.lit(RUN_FAILED))))
    why = F.coalesce(F.regexp_replace("script_error", r"^Setup failed \(exit -?\d+\)", "Setup script failed"), "call_error", F.lit(RUN_FAILED))
    ran = answered.where("broken is null").withColumns({"tools": F.transform("tool_calls", lambda t: t["name"]), "response": F.coalesce(F.nullif(F.col("response"), F.lit("")), F.lit(NO_TEXT))})
    failed = answered.where("broken is not null").withColumns({"judgment": F.struct(F.lit(False).alias("pass"), why.alias("reasoning")), "infra_failure": F.lit(True), "response": F.col("broken")})
    asserted = grading.grade(ran.where("size(assertions) > 0")).withColumn("infra_failure", F.lit(False)).drop("tools")
    judged = ran.where("assertions is null or size(assertions) = 0").drop("tools")
    verdicts = first_valid(runner.verdicts(judge_prompt(judged).select(*KEYS, "judge_prompt")))
    none = F.struct(F.lit(False).alias("pass"), F.lit(NO_VERDICT).alias("reasoning"))
    judged = judged.join(verdicts, list(KEYS), "left").withColumn("infra_failure", F.col("judgment.pass").isNull()).withColumn("judgment", F.when(F.col("infra_failure"), none).otherwise(F.col("judgment")))
    return asserted.unionByName(judged).unionByName(failed)


def evaluate(
    cases: DataFrame,
    runner: Runner,
    *,
    agent: str,
    skill_key: str = "baseline",
    set_name: str = "",
    samples_per_case: int = 3,
    max_cases: int | None = None,
    seed: int = 0,
    cache: DataFrame | ResultStore | str | None = None,
    skip_cache: bool = False,
    trust_scripts: bool = False,
) -> Evaluation:
    """Runs every case ``samples_per_case`` times. Tasks found in the cache are not run; results of failed surroundings count as failed but are not cached.

    A cache that is a path or a store is written through: fresh results are stored, under ``skip_cache`` as well, which only keeps them from being looked up.
    A table of results is only read.
    """
    has_scripts = {"setup", "teardown"} <= set(cases.columns)
    if has_scripts and not trust_scripts and not samples.scripts(cases).isEmpty():
        raise CaseValidationError("cases have scripts; pass trust_scripts=True to run them")
    total = cases.count()
    chosen = samples.sample_cases(cases, max_cases, seed)
    keyed = chosen.withColumns({"case_key": case_cache_key(F.col("source"), F.col("content")), "agent": F.lit(agent), "skill_key": F.lit(skill_key), "set_name": F.lit(set_name)})
    tasks = samples.expand(keyed, samples_per_case)
    payload = ["response", "tool_calls", "judgment"]
    names = ["case_idx", "source", *samples.CACHE_KEYS]
    store = ResultStore(cases.sparkSession, cache) if isinstance(cache, str) else cache if isinstance(cache, ResultStore) else None
    if cache is None or skip_cache:
        found, todo = None, tasks
    elif store:
        looked = store.look_up(tasks, set_name, agent, skill_key)
        found = kept(looked.where("cached").select(*names, *payload, F.lit(False).alias("infra_failure"), "cached"))
        todo = looked.where("not cached").drop(*payload, "cached")
    else:
        known = cache.select(*samples.CACHE_KEYS, *payload)
        found = tasks.join(known, list(samples.CACHE_KEYS)).select(*names, *payload, F.lit(False).alias("infra_failure"), F.lit(True).alias("cached"))
        todo = samples.not_cached(tasks, known)
    answered = kept(runner.answers(todo))  # three kinds of grading read it
    fresh = kept(_grade(answered, runner).select(*names, *payload, "infra_failure", F.lit(False).alias("cached")))
    if store:
        store.record(fresh)
        if store is not cache:
            store.close()  # what was found is kept
    results = fresh if found is None else found.unionByName(fresh)
    results = results.withColumns({"passed": F.col("judgment.pass"), "case_source": F.col("source")})
    counted = samples.summary(results)
    return Evaluation(results, counted, samples.per_case(results, samples_per_case), total, total if not max_cases else min(total, max_cases))


def failure_summaries(evaluation: Evaluation, cases: DataFrame) -> DataFrame:
    """What a summariser is told of each failed run."""
    from assayframe.functions.text import truncate_response

    failed = samples.failures(evaluation.results).join(cases.select("source", "prompt", "expected"), "source")
    return failed.select("source", "iteration", "prompt", "expected", truncate_response(F.col("response")).alias("response_preview"), F.coalesce("judgment.reasoning", F.lit("")).alias("reasoning"))


def wants_summary(evaluation: Evaluation, no_summary: bool = False) -> bool:
    """Whether failures are to be summarised: there are some, something was really run, and nobody declined."""
    found = evaluation.summary.first()
    return not no_summary and found["fresh_count"] > 0 and found["total_runs"] > found["total_pass"]


SUMMARY_PROMPT = "These runs did not meet their expectations. Say in a few sentences what they have in common.\n\n$failures"


def summary_prompt(failures: DataFrame) -> DataFrame:
    """One row with the prompt for a summary of failure_summaries; the failures told are those of one evaluation, each a preview."""
    one = template("Case: $source\nExpected: $expected\nResponse: $response_preview\nReason: $reasoning", **{c: F.col(c) for c in ("source", "expected", "response_preview", "reasoning")})
    told = failures.select("source", "iteration", one.alias("told")).agg(F.array_sort(F.collect_list(F.struct("source", "iteration", "told"))).alias("f"))
    return told.select(template(SUMMARY_PROMPT, failures=F.array_join(F.transform("f", lambda x: x["told"]), "\n\n")).alias("prompt"))


def require_verdicts(evaluation: Evaluation) -> Evaluation:
    """The evaluation, or JudgeError if a run that was answered has no valid verdict."""
    if bad := evaluation.results.where(F.col("infra_failure") & (F.col("judgment.reasoning") == NO_VERDICT)).select("case_source").first():
        raise JudgeError(f"no valid verdict for {bad['case_source']}")
    return evaluation
