import json
import os
import re

import pytest
from pyspark.sql import functions as F

from assayframe import Calls, cli
from assayframe.errors import SkillError
from assayframe.operators import rounds
from assayframe.plans import evaluate, generate, prompts, tune
from assayframe.sources import documents, results

CASE = "timestamp: 2025-01-01T00:00:00Z\nname: {n}\nprompt: say {n}\nexpected: {n} is said\n"


@pytest.fixture
def folder(tmp_path):
    base = tmp_path / "evals" / "set"
    base.mkdir(parents=True)
    for n in "abc":
        (base / f"{n}.yaml").write_text(CASE.format(n=n))
    return tmp_path


def runner(skill, number):
    """Passes one case more for every plus sign of the skill."""
    plus = skill.count("+")

    def ask(task, home):
        return f"{task['name']} under {skill}", [("Bash", "{}")]

    def judge(prompt):
        case = re.search(r"say (\w)", prompt)[1]
        return json.dumps({"pass": "abc".index(case) < plus, "reasoning": "counted"})

    return Calls(ask, judge)


def run(spark, folder, **more):
    cases = documents.load_cases(spark, "set", str(folder))
    return tune.tune(cases, "s", runner, lambda skill, _: skill + "+", agent="x", store=str(folder / "run"), set_name="set", **more)


def test_run_goes_on_where_it_stopped(spark, folder):
    seen = []

    def stop(number, rate):
        seen.append(number)
        if number == 3:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        run(spark, folder, on_round=stop)
    began = tune.TuneRun(spark, str(folder / "run")).head()["metadata"]["started_at"]
    os.makedirs(folder / "run" / "rounds" / "round=4")  # a round that had not ended
    done = run(spark, folder, on_round=lambda n, r: seen.append(n))
    assert seen == [1, 2, 3, 4] and done.success and done.best_round == 4 and done.best_skill == "s+++" and done.best_rate == 100.0
    assert done.head()["metadata"]["started_at"] == began and done.head()["metadata"]["completed_at"] > began
    again = run(spark, folder, on_round=lambda n, r: seen.append(n))
    assert seen == [1, 2, 3, 4] and again.rounds.count() == 4
    with pytest.raises(SkillError):
        tune.begin(spark, str(folder / "run"), "other", {})


def test_document_holds_the_whole_run(spark, folder):
    done = run(spark, folder, max_rounds=2, tip="short")
    path = str(folder / "out.json")
    done.save(path)
    row = tune.load_document(spark, path).first().asDict(recursive=True)
    assert row == done.document().first().asDict(recursive=True) == json.loads(open(path).read())
    assert row["config"] == {"max_rounds": 2, "target_pass_rate": 100.0, "samples": 1, "parallel": 3}
    assert row["result"]["rounds_completed"] == 2 and row["result"]["best_round"] == 2 and not row["result"]["success"] and row["result"]["final_pass_rate"] == pytest.approx(100 / 3)
    assert (row["original_skill"], row["best_skill"], row["metadata"]["eval_set"]) == ("s", "s+", "set")
    second = row["rounds"][1]
    assert (second["round"], second["skill_content"], second["tip_used"]) == (2, "s+", "short") and [(e["source"], e["passed"], e["reasoning"]) for e in second["evals"]] == [("a.yaml", True, "counted"), ("b.yaml", False, "counted"), ("c.yaml", False, "counted")]
    assert second["evals"][0]["tool_calls"] == [{"name": "Bash", "input": "{}"}]
    skill = folder / "SKILL.md"
    skill.write_text("s")
    assert tune.write_back(done, str(skill), spark) and skill.read_text() == "s+"
    nothing = tune.begin(spark, str(folder / "new"), "s", {"max_rounds": 1, "target_pass_rate": 1.0, "samples": 1, "parallel": 1})
    assert nothing.document().first()["rounds"] == [] and nothing.best_skill == "s" and not tune.write_back(nothing, str(skill), spark)


def test_prompts(spark, folder):
    cases = documents.load_cases(spark, "set", str(folder))
    got = evaluate.evaluate(cases, runner("s+", 1), agent="x", samples_per_case=1)
    assert evaluate.wants_summary(got) and not evaluate.wants_summary(got, no_summary=True)
    failures = evaluate.failure_summaries(got, cases)
    summary = evaluate.summary_prompt(failures).first()["prompt"]
    assert "Case: b.yaml" in summary and "Response: c under s+" in summary and "Case: a.yaml" not in summary
    assert evaluate.require_verdicts(got) is got
    draft = prompts.draft_prompt(cases, "own", "be short").first()["prompt"]
    assert draft.index("## Case 1\nPrompt: say a") < draft.index("## Case 3\nPrompt: say c\nExpected: c is said") and draft.endswith("Also: be short\n")
    improve = prompts.improve_prompt("DOC $x", failures, "terse").first()["prompt"]
    assert "Document:\nDOC $x\n" in improve and "  Got: b under s+\n  Reason: counted" in improve and improve.endswith("Style: terse\n")
    tried = spark.createDataFrame([(n, 10.0 * n, f"skill {n} " + "y" * 200) for n in range(1, 6)], "round int, pass_rate double, skill string")
    proposal = prompts.proposal_prompt("DOC", failures, tried, cases).first()["prompt"]
    assert [int(x) for x in re.findall(r"Score: (\d+)%", proposal)] == [30, 40, 50] and proposal.count("Got:") == 2 and proposal.count("- Input:") == 3 and "y" * 110 not in proposal
    bare = prompts.proposal_prompt("DOC", failures.limit(0), tried.limit(0), cases).first()["prompt"]
    assert prompts.NO_FAILURES in bare and prompts.NO_HISTORY in bare


def test_missing_verdicts_are_errors_on_request(spark, folder):
    from assayframe.errors import JudgeError

    cases = documents.load_cases(spark, "set", str(folder))
    tries = evaluate.evaluate(cases, Calls(lambda t, h: ("x", []), lambda p: "no verdict"), agent="x", samples_per_case=1)
    assert {r["infra_failure"] for r in tries.results.collect()} == {True}
    with pytest.raises(JudgeError):
        evaluate.require_verdicts(tries)

    def fail(task, home):
        raise OSError("gone")

    broken = evaluate.evaluate(cases, Calls(fail), agent="x", samples_per_case=1)
    assert {(r["response"], r["judgment"]["reasoning"]) for r in broken.results.collect()} == {("gone", "Error (OSError): gone")}
    assert evaluate.require_verdicts(broken) is broken


def test_score_lists_are_bounded_rows(spark):
    trials = spark.range(1000).selectExpr("case when id < 900 then 'hot' when id < 990 then 'cold' end as parameters", "id * 7919 % 1000 as trial", "cast(id as double) as score").repartition(6)
    got = rounds.score_lists(trials, 128).collect()
    assert max(len(r["scores"]) for r in got) == 128
    for name in ("hot", "cold", None):
        own = sorted((r for r in got if r["parameters"] == name), key=lambda r: r["chunk"])
        want = sorted((r["trial"], r["score"]) for r in trials.collect() if r["parameters"] == name)
        assert [x for r in own for x in zip(r["trials"], r["scores"])] == want and [r["chunk"] for r in own] == list(range(len(own)))
    assert rounds.score_lists(trials.limit(0)).collect() == []


def skill_folder(tmp_path):
    own = tmp_path / "greeter"
    own.mkdir()
    (own / "SKILL.md").write_text("---\nname: greeter\ndescription: greets\n---\n## Goals\n1. be kind\n")
    return own


def candidate(name, **more):
    return {"prompt": "p", "expected": "e", "name": name, "category": "positive", "domain": "functional", "source": "goal:1", "confidence": 0.875, "rationale": "r"} | more


def test_generate_evals_from_answers_to_files(spark, tmp_path):
    own, asked = skill_folder(tmp_path), []

    def call(todo):
        asked.append(todo.first()["prompt"])
        bad = json.dumps({"candidates": [candidate("a", confidence=7)]})
        good = json.dumps({"output": {"candidates": [candidate("a b"), candidate("c", domain=None), candidate("d")]}})
        return todo.select("path", F.lit(bad if len(asked) == 1 else good).alias("answer"))

    found = generate.generate_evals(documents.load_skills(spark, str(own)), call, folder=str(tmp_path / "out"), max_per_category=2)
    assert len(asked) == 2 and "- be kind" in asked[0] and "Missing recommended field: license" in asked[0] and "fits none" in asked[1]
    assert [r["name"] for r in found.orderBy("ord").collect()] == ["a b", "c"] and sorted(os.listdir(tmp_path / "out"))[-2:] == ["a-b.yaml", "c.yaml"]
    text = (tmp_path / "out" / "a-b.yaml").read_text()
    assert "skill_name: greeter" in text and "sure: 88%" in text
    assert documents.load_cases(spark, str(tmp_path / "out")).count() == 2


def test_command_line(spark, folder, monkeypatch):
    said, answer = [], json.dumps({"candidates": [candidate("x")]})
    monkeypatch.setattr(cli, "named", lambda what: {"run": runner("++", 1), "tune": runner, "skill": lambda prompt: "---\nname: set\n---\n" + "+" * (prompt.count("- Score") + 1), "cases": lambda prompt: answer}[what])
    go = lambda *args: cli.main(args, spark, said.append)
    root = str(folder)
    assert go("eval", "set", "--agent", "x", "--runner", "run", "-s", "1", "--root", root) == 1 and said[-1].startswith("These runs did not meet") and any(s.startswith("pass rate 67% (2 of 3, 0 cached)") for s in said)
    assert go("eval", "set", "--agent", "x", "--runner", "run", "-s", "1", "--root", root, "-m", "3") == 1 and said[-1] == "pass rate 67% (2 of 3, 3 cached)"
    assert go("create", "set", "-d", root, "--write", "skill", "--root", root) == 0 and (folder / "set" / "SKILL.md").read_text().endswith("+")
    assert go("create", "set", "-d", root, "--write", "skill", "--root", root) == 2 and said[-1].startswith("error: ")
    assert go("lint", f"{root}/set") == 1 and said[-1].endswith("findings") and any("[warning] Missing recommended field: license" in s for s in said)
    assert go("lint") == 2 and go("lint", "--list-rules") == 0 and said[-1] == "field-metadata"
    assert go("tune", "set", f"{root}/set", "--agent", "x", "--runner", "tune", "--write", "skill", "--root", root, "-o", f"{root}/t.json") == 0
    assert said[-1] == f"best round 4 at 100%, kept in {root}/t.json" and (folder / "set" / "SKILL.md").read_text().endswith("+++") and json.loads((folder / "t.json").read_text())["result"]["success"]
    assert go("generate-evals", f"{root}/set", "--write", "cases", "-o", f"{root}/new") == 0 and said[-1] == f"1 candidates in {root}/new"
    assert go("eval", "missing", "--agent", "x", "--runner", "run", "--root", root) == 2
    monkeypatch.undo()
    assert cli.named("json:dumps") is json.dumps and results.cache_name(spark, "set") == "set" and results.cache_name(spark, f"{root}/set/") == "set"
