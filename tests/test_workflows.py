import json

import pytest
from pyspark.sql import functions as F

from assayframe.errors import CaseValidationError, EmptyFolderError, SkillError
from assayframe.operators import lint
from assayframe.plans import generate
from assayframe.plans.evaluate import evaluate, failure_summaries
from assayframe.plans.runners import Replay
from assayframe.plans.tune import tune
from assayframe.sources import documents, results
from assayframe.streaming import status as stream

CASE = "timestamp: 2025-01-01T00:00:00Z\nname: {n}\nprompt: {p}\nexpected: fine\n{extra}"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "evals" / "set" / "sub").mkdir(parents=True)
    base = tmp_path / "evals" / "set"
    (base / "b.yaml").write_text(CASE.format(n="b", p="hello", extra="assertions:\n  - type: contains\n    value: hi\n"))
    (base / "a.yaml").write_text(CASE.format(n="a", p="[one, two]", extra=""))
    (base / "sub" / "c.yaml").write_text(CASE.format(n="c", p="x", extra=""))
    (base / "note.txt").write_text("no case")
    return tmp_path


def test_load_folder(spark, folder):
    cases = documents.load_cases(spark, "set", str(folder)).orderBy("case_idx").collect()
    assert [(c["source"], c["prompt"], c["prompt_is_list"]) for c in cases] == [("a.yaml", ["one", "two"], True), ("b.yaml", ["hello"], False), ("sub/c.yaml", ["x"], False)]
    assert cases[1]["assertions"][0]["value"] == "hi"


def test_load_errors(spark, folder):
    base = folder / "evals" / "set"
    assert documents.load_cases(spark, str(base / "a.yaml")).first()["source"] == "a.yaml"
    with pytest.raises(CaseValidationError):
        documents.load_cases(spark, str(base / "note.txt"))
    with pytest.raises(EmptyFolderError):
        documents.load_cases(spark, "missing", str(folder))
    (base / "bad.yaml").write_text("name: x\n")
    with pytest.raises(CaseValidationError, match="expected, prompt, timestamp"):
        documents.load_cases(spark, str(base))
    (base / "bad.yaml").write_text("a: [")
    with pytest.raises(CaseValidationError, match="invalid YAML"):
        documents.load_cases(spark, str(base))


def _answers(spark, cases, responses):
    from assayframe.functions.text import case_cache_key

    keyed = cases.select(case_cache_key(F.col("source"), F.col("content")).alias("case_key"), "source")
    said = spark.createDataFrame([(s, i, r) for s, own in responses.items() for i, r in enumerate(own, 1)], "source string, iteration int, response string")
    return keyed.join(said, "source").select("case_key", F.lit("x").alias("agent"), F.lit("baseline").alias("skill_key"), "iteration", "response", F.array(F.struct(F.lit("Bash").alias("name"), F.lit("{}").alias("input"))).alias("tool_calls"))


def test_evaluate_and_cache(spark, folder, tmp_path):
    cases = documents.load_cases(spark, "set", str(folder))
    answers = _answers(spark, cases, {"a.yaml": ["1", "2"], "b.yaml": ["oh hi", "no"], "sub/c.yaml": ["3", None]})
    keys = answers.select("case_key", "agent", "skill_key", "iteration")
    verdicts = keys.crossJoin(spark.createDataFrame([(1, "garbage"), (2, '{"pass": true, "reasoning": "good"}')], "attempt int, answer string"))
    runner = Replay(answers, verdicts)
    got = evaluate(cases, runner, agent="x", set_name="set", samples_per_case=2)
    assert got.summary.first().asDict() == {"total_runs": 6, "total_pass": 4, "cached_count": 0, "fresh_count": 6, "pass_rate": pytest.approx(400 / 6)}
    by = {(r["source"], r["iteration"]): r for r in got.results.collect()}
    assert by["a.yaml", 1]["judgment"]["reasoning"] == "good" and by["b.yaml", 2]["judgment"]["reasoning"].startswith("contains:") and by["sub/c.yaml", 2]["infra_failure"]
    assert {r["case_source"]: r["pass_at_k"] for r in got.per_case.collect()} == {"a.yaml": 1.0, "b.yaml": 1.0, "sub/c.yaml": 1.0}
    assert failure_summaries(got, cases).count() == 2
    path = str(tmp_path / "cache")
    results.write_cache(got.results.select("set_name", "case_key", "agent", "skill_key", "iteration", "response", "tool_calls", "judgment", "infra_failure", "cached"), path)
    again = evaluate(cases, Replay(answers.limit(0)), agent="x", set_name="set", samples_per_case=2, cache=results.read_cache(spark, path, set_name="set"))
    assert again.summary.first().asDict() == {"total_runs": 6, "total_pass": 4, "cached_count": 5, "fresh_count": 1, "pass_rate": pytest.approx(400 / 6)}


def test_scripts_need_trust(spark, folder):
    (folder / "evals" / "set" / "d.yaml").write_text(CASE.format(n="d", p="x", extra="setup: touch x\n"))
    with pytest.raises(CaseValidationError, match="scripts"):
        evaluate(documents.load_cases(spark, "set", str(folder)), Replay(spark.range(0)), agent="x")


def test_tune(spark, folder):
    cases = documents.load_cases(spark, "set", str(folder))

    def runner(skill, number):
        answers = _answers(spark, cases, {s: ["r"] for s in ("a.yaml", "b.yaml", "sub/c.yaml")}).withColumn("skill_key", F.lit(f"round-{number}"))
        verdicts = answers.select("case_key", "agent", "skill_key", "iteration", F.lit(1).alias("attempt"), F.lit(json.dumps({"pass": skill == "s++"})).alias("answer"))
        return Replay(answers, verdicts)

    seen = []
    run = tune(cases, "s", runner, lambda skill, _: skill + "+", agent="x", on_round=lambda n, r: seen.append((n, r)))
    assert seen == [(1, 0.0), (2, 0.0), (3, 100.0)] and run.success and run.best_skill == "s++" and run.rounds.count() == 3


def test_skills_and_lint(spark, tmp_path):
    good, bad = tmp_path / "good-one", tmp_path / "Bad"
    good.mkdir()
    bad.mkdir()
    (good / "SKILL.md").write_text("---\nname: good-one\ndescription: d\nlicense: MIT\ncompatibility: all\nmetadata: {a: 1}\n---\n## Goals\n1. win\n")
    (bad / "SKILL.md").write_text("---\nname: 123\ndescription:\n---\n" + "w " * 5001)
    (bad / "README.md").write_text("x")
    skills = documents.load_skills(spark, str(tmp_path))
    assert skills.where("folder = 'good-one'").first()["goals"] == ["win"]
    found = lint.lint(skills)
    assert found.where("path like '%good-one%'").count() == 0
    rules = {r["rule"] for r in found.collect()}
    assert rules == {"frontmatter-valid", "folder-kebab-case", "name-matches-folder", "body-word-count", "no-readme", "field-license", "field-compatibility", "field-metadata"}
    assert documents.analysis(skills).where("name = 'good-one'").first()["example_count"] == 0


@pytest.mark.parametrize("n,fires", [(5000, False), (5001, True)])
def test_word_limit(spark, n, fires):
    docs = documents.parse_skills(spark.createDataFrame([("a/SKILL.md", "---\nname: a\n---\n" + "w " * n)], "path string, content string"), exact=False).withColumn("has_readme", F.lit(False))
    assert bool(lint.lint(docs, ["body-word-count"]).count()) is fires


def test_candidates(spark, tmp_path):
    own = [{"prompt": "p", "expected": "e", "name": n, "category": c, "domain": d, "source": "s", "confidence": 0.5, "rationale": "r"} for n, c, d in (("a", "x", "Functional"), ("a", "x", None), ("b", "y", "odd"), ("c", "x", "triggering"))]
    answers = spark.createDataFrame([("k", "Sure:\n```json\n" + json.dumps({"candidates": own}) + "\n```"), ("w", json.dumps({"output": {"candidates": own[:1]}}))], "path string, answer string")
    every = generate.candidates(answers)
    assert every.count() == 5
    assert generate.candidates(answers, domains=["functional"]).count() == 2
    assert sorted((r["path"], r["ord"]) for r in generate.candidates(answers, max_per_category=2).collect()) == [("k", 0), ("k", 1), ("k", 2), ("w", 0)]
    with pytest.raises(CaseValidationError):
        generate.candidates(answers, domains=["nope"])
    files = results.candidate_files(every.where("path = 'k'"), spark.createDataFrame([("b.yaml",)], "file string"), "20250101-000000")
    assert {r["ord"]: r["file"] for r in files.collect()} == {0: "a.yaml", 1: "a-20250101-000000-2.yaml", 2: "b-20250101-000000-3.yaml", 3: "c.yaml"}
    text = results.candidate_yaml(own[0] | {"domain": "functional"}, "2025-01-01", "sk")
    assert "#   confidence: 0.5" in text and "#   skill_name: sk" in text and text.count("\nprompt: p\n") == 1
    folder = str(tmp_path / "out")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "b.yaml").write_text("x")
    names = results.write_candidates(every.where("path = 'k'"), folder, "s", "2025-01-01")
    assert names == ["a.yaml", "a-s-2.yaml", "b-s-3.yaml", "c.yaml"] and (tmp_path / "out" / "b.yaml").read_text() == "x"
    cases = documents.load_cases(spark, folder + "/a.yaml").first()
    assert (cases["name"], cases["prompt"], cases["expected"]) == ("a", ["p"], "e")


def test_skill_folders(spark, tmp_path):
    path = results.create_skill(spark, str(tmp_path / "own"), "---\nname: own\n---\n")
    assert open(path).read().startswith("---")
    with pytest.raises(SkillError):
        results.create_skill(spark, str(tmp_path / "own"), "x")
    assert open(results.create_skill(spark, str(tmp_path / "own"), "x", overwrite=True)).read() == "x"
    assert results.tune_path("a/b/", "s", "/r") == "/r/tunes/b/s.json"


def test_stream_of_states(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    rows = [{"case_idx": 0, "iteration": 1, "state": "running", "passed": None, "seq": 1}, {"case_idx": 0, "iteration": 1, "state": "done", "passed": True, "seq": 2}]
    (src / "1.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nbroken\n")
    query = stream.follow_states(stream.read_events(spark, str(src)), "states_now", str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert [(r["state"], r["passed"]) for r in spark.table("states_now").collect()] == [("done", True)]


def test_transcripts_from_files(spark, tmp_path):
    (tmp_path / "t1.0.jsonl").write_text('{"a":1}\n{"b":2}')
    (tmp_path / "t2.jsonl").write_text('{"a":1}')
    rows = documents.load_transcripts(spark, str(tmp_path)).orderBy("task_key", "line_no").collect()
    assert [(r["task_key"], r["turn"], r["line_no"]) for r in rows] == [("t1", 0, 0), ("t1", 0, 1), ("t2", 0, 0)]
