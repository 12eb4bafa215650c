"""Evaluation of AI agents with Spark DataFrames."""

from assayframe.errors import CaseValidationError, EmptyFolderError, EvaluationError, JudgeError, SkillError
from assayframe.operators.lint import lint
from assayframe.plans.evaluate import Evaluation, evaluate
from assayframe.plans.generate import candidates, generation_prompts
from assayframe.plans.runners import Calls, Replay, Runner
from assayframe.plans.tune import TuneRun, tune
from assayframe.sources.documents import load_cases, load_skills, load_transcripts
from assayframe.sources.results import create_skill, load_run, read_cache, save_run, write_cache, write_candidates
from assayframe.sources.store import ResultStore

__all__ = [
    "Calls", "CaseValidationError", "EmptyFolderError", "Evaluation", "EvaluationError", "JudgeError", "Replay", "ResultStore", "Runner", "SkillError", "TuneRun", "candidates", "create_skill", "evaluate",
    "generation_prompts", "lint", "load_cases", "load_run", "load_skills", "load_transcripts", "read_cache", "save_run", "tune", "write_cache", "write_candidates",
]
