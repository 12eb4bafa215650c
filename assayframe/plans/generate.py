"""Candidate cases: from a generator's answers to rows that can be written."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.errors import CaseValidationError
from assayframe.functions.text import DOMAINS, bullets, json_in_prose, parse_domain, template
from assayframe.operators import lint, samples
from assayframe.plans.answers import require_valid, valid_answers
from assayframe.sources import documents
from assayframe.shared import kept
from assayframe.sources.results import write_candidates

_CANDIDATES = "candidates array<struct<prompt:string,expected:string,name:string,category:string,domain:string,source:string,confidence:double,rationale:string>>"
PROMPT = "Write test cases for the skill $name.\n\nDescription: $description\n\nGoals:\n$goals\n\nProhibitions:\n$prohibitions\n\nExamples:\n$examples\n\nKnown findings:\n$findings"


def generation_prompts(analysis: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(path, prompt) of each analysed skill; findings of the linter are told only if given."""
    rows = analysis
    if findings is not None:
        told = findings.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "message"))).alias("f")).select("path", F.transform("f", lambda x: x["message"]).alias("findings"))
        rows = rows.join(told, "path", "left")
    else:
        rows = rows.withColumn("findings", F.lit(None).cast("array<string>"))
    parts = {c: F.coalesce(bullets(F.col(c)), F.lit("")) for c in ("goals", "prohibitions", "findings")}
    return rows.select("path", template(PROMPT, name=F.col("name"), description=F.col("description"), examples=F.array_join("first_examples", "\n\n"), **parts).alias("prompt"))


def candidates(answers: DataFrame, *, domains: list[str] | None = None, max_per_category: int | None = None) -> DataFrame:
    """(path, answer) to candidates in the order given; an answer with one key around the list is unwrapped."""
    for domain in domains or ():
        if domain not in DOMAINS:
            raise CaseValidationError(f"unknown domain {domain}; choose from {', '.join(DOMAINS)}")
    text = json_in_prose(F.col("answer"))
    direct = F.from_json(text, _CANDIDATES)["candidates"]
    wrapped = F.map_values(F.from_json(text, f"map<string, struct<{_CANDIDATES.replace(' ', ':', 1)}>>"))[0]["candidates"]
    rows = answers.select("path", F.posexplode(F.coalesce(direct, wrapped)).alias("ord", "c")).select("path", "ord", "c.*").withColumn("domain", parse_domain(F.col("domain")))
    rows = samples.in_domains(rows, domains)
    return rows if max_per_category is None else samples.limit_per_category(rows.withColumn("_group", F.struct("path", "category")), max_per_category, "_group").drop("_group")


_CANDIDATE = {
    "type": "object",
    "required": ["prompt", "expected", "name", "category", "source", "confidence", "rationale"],
    "properties": {n: {"type": "string"} for n in ("prompt", "expected", "name", "category", "source", "rationale")} | {"confidence": {"type": "number", "minimum": 0, "maximum": 1}, "domain": {"type": ["string", "null"]}},
}
_LIST = {"type": "object", "required": ["candidates"], "properties": {"candidates": {"type": "array", "items": _CANDIDATE}}}
#: what a generator's answer has to be: the list, or one key around it
SCHEMA = {"anyOf": [_LIST, {"type": "object", "required": ["output"], "properties": {"output": _LIST}}]}


def generate_evals(
    skills: DataFrame,
    call: Callable[[DataFrame], DataFrame],
    *,
    folder: str | None = None,
    use_lint: bool = True,
    max_per_category: int = 5,
    domains: list[str] | None = None,
    attempts: int = 2,
    now: datetime | None = None,
) -> DataFrame:
    """Candidates for every skill of ``skills`` (``documents.load_skills``), of answers that the schema accepts; with a folder, written there, a folder for each skill.

    ``call`` gets (path, prompt) and gives (path, answer). A skill without a valid answer is an error.
    """
    told = documents.analysis(skills)
    prompts = generation_prompts(told, lint.lint(skills) if use_lint else None)
    answers = require_valid(valid_answers(prompts, call, SCHEMA, attempts=attempts))
    found = kept(candidates(answers.select("path", "answer"), domains=domains, max_per_category=max_per_category))
    if folder is not None:
        now = now or datetime.now(UTC)
        names = told.select("path", "name").join(found.select("path").distinct(), "path").orderBy("path").collect()  # one row a skill that is written
        for i, row in enumerate(names):
            own = folder if len(names) == 1 else f"{folder.rstrip('/')}/{row['name'] or i}"
            write_candidates(found.where(F.col("path") == row["path"]), own, now.strftime("%Y%m%d-%H%M%S"), now.isoformat(), row["name"] or None)
    return found
