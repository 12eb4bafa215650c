"""The command line: evaluate, tune, create, lint and generate-evals, each one call into the library.

Answers come from a runner, named as ``module:attribute``: an object with the methods of ``plans.runners.Runner``, or ``propose`` and ``write``
functions for the commands that write documents (prompt to text). There is no default. Exit status: 0 good, 1 with findings or failed runs, 2 for errors.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.errors import EvaluationError
from assayframe.functions.text import comma_list, first_lines
from assayframe.operators import lint, samples
from assayframe.plans import evaluate as evaluation
from assayframe.plans import generate, prompts, tune
from assayframe.shared import kept
from assayframe.sources import documents, results


def named(what: str):
    """The object that ``module:attribute`` names."""
    module, _, attribute = what.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="assayframe", description="Evaluate and improve skills of AI agents.")
    commands = parser.add_subparsers(dest="command", required=True)
    own = commands.add_parser("eval", help="run cases, with a skill or without")
    own.add_argument("name")
    own.add_argument("skill", nargs="?")
    own.add_argument("--agent", required=True)
    own.add_argument("--runner", required=True)
    own.add_argument("-s", "--samples", type=int, default=3)
    own.add_argument("-m", "--max-evals", type=int)
    own.add_argument("--tools")
    own.add_argument("--skip-cache", action="store_true")
    own.add_argument("--trust", action="store_true")
    own.add_argument("--no-summary", action="store_true")
    own.add_argument("--root", default="")
    own = commands.add_parser("tune", help="improve a skill until its cases pass")
    own.add_argument("name")
    own.add_argument("skill")
    own.add_argument("--agent", required=True)
    own.add_argument("--runner", required=True, help="a function of (skill document, round)")
    own.add_argument("--write", required=True, help="a function from prompt to text")
    own.add_argument("-r", "--rounds", type=int, default=5)
    own.add_argument("-t", "--target", type=float, default=100.0)
    own.add_argument("-s", "--samples", type=int, default=1)
    own.add_argument("-o", "--output")
    own.add_argument("--store", help="the run's folder; one that was interrupted goes on")
    own.add_argument("--root", default="")
    own = commands.add_parser("create", help="draft a skill from its cases")
    own.add_argument("name")
    own.add_argument("-d", "--dir", required=True)
    own.add_argument("--write", required=True)
    own.add_argument("--prompt")
    own.add_argument("--root", default="")
    own = commands.add_parser("lint", help="check skill documents")
    own.add_argument("path", nargs="?")
    own.add_argument("--list-rules", action="store_true")
    own = commands.add_parser("generate-evals", help="write candidate cases for a skill")
    own.add_argument("skill")
    own.add_argument("--write", required=True)
    own.add_argument("-o", "--output", required=True)
    own.add_argument("--max", type=int, default=5)
    own.add_argument("-d", "--domain", action="append")
    return parser


def _skill_key(spark: SparkSession, path: str | None) -> str:
    if not path:
        return "baseline"
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.lit("skill").alias("folder"), F.col("_metadata.file_path").alias("rel"), F.col("value").alias("content"))
    return samples.directory_hash(files).first()["dir_hash"]


def _mapped(asked: DataFrame, write: Callable[[str], str]) -> DataFrame:
    """(path, answer) of (path, prompt), by a text function."""

    def run(batches):
        for batch in batches:
            yield batch.assign(answer=[write(p) for p in batch["prompt"]])[["path", "answer"]]

    return asked.mapInPandas(run, "path string, answer string")


def run_eval(spark: SparkSession, args: argparse.Namespace, say: Callable[[str], None]) -> int:
    cases = documents.load_cases(spark, args.name, args.root)
    if not args.trust:
        shown = samples.scripts(cases).select("source", "kind", *(c.alias(n) for c, n in zip(first_lines(F.col("script")), ("head", "more"))))
        for row in shown.orderBy("source", "kind").limit(20).collect():
            say(f"{row['source']} {row['kind']}: {' | '.join(row['head'])}" + (f" (and {row['more']} lines more)" if row["more"] else ""))
    if args.tools:
        cases = cases.withColumn("allowed_tools", comma_list(F.lit(args.tools)))
    found = evaluation.evaluate(
        cases, named(args.runner), agent=args.agent, skill_key=_skill_key(spark, args.skill), set_name=results.cache_name(spark, args.name), samples_per_case=args.samples,
        max_cases=args.max_evals, cache=f"{args.root.rstrip('/')}/cache" if args.root else None, skip_cache=args.skip_cache, trust_scripts=args.trust,
    )
    for row in samples.per_case(found.results, args.samples).orderBy("case_source").toLocalIterator():
        say(f"{row['case_source']}: {row['c']} of {row['n']}")
    total = found.summary.first()
    say(f"pass rate {total['pass_rate']:.0f}% ({total['total_pass']} of {total['total_runs']}, {total['cached_count']} cached)")
    if evaluation.wants_summary(found, args.no_summary):
        say(evaluation.summary_prompt(evaluation.failure_summaries(found, cases)).first()["prompt"])
    return int(total["total_pass"] < total["total_runs"])


def run_tune(spark: SparkSession, args: argparse.Namespace, say: Callable[[str], None]) -> int:
    cases, path, write = documents.load_cases(spark, args.name, args.root), documents.skill_file(spark, args.skill), named(args.write)
    skill = results.read_text(spark, path)

    out = args.output or results.tune_path(args.name, datetime.now(UTC).strftime("%Y%m%d-%H%M%S"), args.root)
    store = args.store or f"{out.removesuffix('.json')}.run"

    def propose(current: str, got: evaluation.Evaluation) -> str:
        before = tune.TuneRun(spark, store).rounds
        return write(prompts.proposal_prompt(current, evaluation.failure_summaries(got, cases), before, cases).first()["prompt"]).strip()

    run = tune.tune(cases, skill, named(args.runner), propose, agent=args.agent, max_rounds=args.rounds, target=args.target, samples_per_case=args.samples, store=store, set_name=args.name, skill_path=path, on_round=lambda n, rate: say(f"round {n}: {rate:.0f}%"))
    tune.write_back(run, path, spark)
    run.save(out)
    say(f"best round {run.best_round} at {run.best_rate:.0f}%, kept in {out}")
    return int(not run.success)


def run_create(spark: SparkSession, args: argparse.Namespace, say: Callable[[str], None]) -> int:
    cases = documents.load_cases(spark, args.name, args.root)
    text = named(args.write)(prompts.draft_prompt(cases, args.name, args.prompt).first()["prompt"])
    say(results.create_skill(spark, f"{args.dir.rstrip('/')}/{results.cache_name(spark, args.name)}", text))
    return 0


def run_lint(spark: SparkSession, args: argparse.Namespace, say: Callable[[str], None]) -> int:
    if args.list_rules:
        for rule in lint.RULES:
            say(rule)
        return 0
    if not args.path:
        say("a path is needed, or --list-rules")
        return 2
    findings = kept(lint.lint(documents.load_skills(spark, args.path)))
    for row in findings.orderBy("path", "ord").toLocalIterator():
        say(f"{row['path']}{f':{row['line']}' if row['line'] else ''}: [{row['severity']}] {row['message']}")
    n = lint.finding_counts(findings).first()["n_findings"]
    say(f"{n} findings" if n else "no findings")
    return int(n > 0)


def run_generate(spark: SparkSession, args: argparse.Namespace, say: Callable[[str], None]) -> int:
    skills = documents.load_skills(spark, documents.skill_file(spark, args.skill))
    found = generate.generate_evals(skills, lambda asked: _mapped(asked, named(args.write)), folder=args.output, max_per_category=args.max, domains=args.domain)
    say(f"{found.count()} candidates in {args.output}")
    return 0


COMMANDS = {"eval": run_eval, "tune": run_tune, "create": run_create, "lint": run_lint, "generate-evals": run_generate}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, say: Callable[[str], None] = print) -> int:
    args = _parser().parse_args(argv)
    try:
        return COMMANDS[args.command](spark or SparkSession.builder.getOrCreate(), args, say)
    except EvaluationError as e:
        say(f"error: {e}")
        return 2


if __name__ == "__main__":
    sys.exit(main())
