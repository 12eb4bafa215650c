import os
import subprocess
import sys
import time

import pytest

from assayframe import Calls, Replay, evaluate
from assayframe.errors import CaseValidationError
from assayframe.operators import scripts
from assayframe.sources import documents
from assayframe.sources.store import ResultStore, coded

CASE = "timestamp: 2025-01-01T00:00:00Z\nname: {n}\nprompt: hello\nexpected: fine\nassertions:\n  - type: contains\n    value: hi\n{extra}"


def _echo():
    def echo(task, home):  # a function of its own, which goes to the executors by value
        return f"hi from {os.path.exists(os.path.join(home, 'made'))}", [("Bash", "{}")]

    return echo


echo = _echo()


def gone(group, seconds=5.0):
    end = time.time() + seconds
    while time.time() < end:
        try:
            os.killpg(group, 0)
        except ProcessLookupError:
            return True
        time.sleep(0.05)
    return False


def test_home_is_shared_by_setup_call_and_teardown(tmp_path):
    seen = tmp_path / "seen"
    got = scripts.run_task({"setup": "touch $HOME/made; echo $CASE_ATTEMPT > $HOME/attempt", "teardown": f"cat $HOME/attempt > {seen}; echo $HOME >> {seen}"}, echo, attempt=3)
    assert got["response"] == "hi from True" and got["script_error"] is got["call_error"] is got["teardown_error"] is None
    attempt, home = seen.read_text().split()
    assert attempt == "3" and not os.path.exists(home)


def test_failed_setup_keeps_call_and_teardown_from_running(tmp_path):
    mark = tmp_path / "mark"
    called = []
    got = scripts.run_task({"setup": "echo boom >&2; exit 3", "teardown": f"touch {mark}"}, lambda *a: called.append(a))
    assert got["script_error"] == "Setup failed (exit 3): boom\n" and not mark.exists() and not called


def test_failed_call_is_followed_by_teardown(tmp_path):
    mark = tmp_path / "mark"

    def fail(task, home):
        raise KeyError("x")

    got = scripts.run_task({"teardown": f"touch {mark}; exit 2"}, fail)
    assert got["call_error"] == "Error (KeyError): 'x'" and mark.exists() and got["teardown_error"].startswith("Teardown failed (exit 2)")


def test_time_limit_kills_the_whole_group(tmp_path):
    pid = tmp_path / "pid"
    began = time.time()
    got = scripts.run_task({"setup": f"sleep 60 & echo $$ > {pid}; sleep 60"}, echo, timeout=0.5)
    assert time.time() - began < 10 and got["script_error"] == "Setup failed (exit -1): Script timed out after 0.5s"
    assert gone(int(pid.read_text()))


def test_background_processes_live_until_teardown_is_over(tmp_path):
    pid, alive = tmp_path / "pid", tmp_path / "alive"
    scripts.run_task({"setup": f"sleep 60 & echo $$ > {pid}", "teardown": f"pgrep -g $(cat {pid}) > {alive}"}, echo)
    assert alive.read_text().strip() and gone(int(pid.read_text()))


def test_long_output_is_told_from_its_end():
    got = scripts.run_task({"setup": "yes x | head -c 300000; echo end >&1; exit 1"}, echo)
    assert len(got["script_error"]) < scripts.TOLD + 100 and got["script_error"].endswith("end\n")


@pytest.fixture
def cases(spark, tmp_path):
    base = tmp_path / "evals"
    base.mkdir()
    (base / "a.yaml").write_text(CASE.format(n="a", extra=f"setup: echo a >> {tmp_path}/log\nteardown: echo A >> {tmp_path}/log\n"))
    (base / "b.yaml").write_text(CASE.format(n="b", extra="setup: exit 7\n"))
    (base / "c.yaml").write_text(CASE.format(n="c", extra=""))
    return documents.load_cases(spark, str(base))


def test_trusted_scripts_run_once_for_each_sample(spark, cases, tmp_path):
    with pytest.raises(CaseValidationError):
        evaluate(cases, Calls(echo), agent="x")
    store = str(tmp_path / "store")
    got = evaluate(cases, Calls(echo), agent="x", samples_per_case=2, trust_scripts=True, cache=store)
    rows = {(r["source"], r["iteration"]): r for r in got.results.collect()}
    assert sorted((tmp_path / "log").read_text().split()) == ["A", "A", "a", "a"]
    assert rows["a.yaml", 1]["passed"] and rows["c.yaml", 2]["passed"]
    bad = rows["b.yaml", 1]
    assert bad["infra_failure"] and not bad["passed"] and bad["response"] == "Setup failed (exit 7): " and bad["judgment"]["reasoning"] == "Setup script failed: "
    # what failed in its surroundings is not stored, and runs again
    again = evaluate(cases, Calls(echo), agent="x", samples_per_case=2, trust_scripts=True, cache=store)
    assert {(r["source"], r["cached"]) for r in again.results.collect()} == {("a.yaml", True), ("b.yaml", False), ("c.yaml", True)}
    assert len((tmp_path / "log").read_text().split()) == 4


def test_recorded_answers_run_scripts_too(spark, cases, tmp_path):
    answers = cases.selectExpr("source").crossJoin(spark.range(1)).selectExpr("source")
    from pyspark.sql import functions as F

    from assayframe.functions.text import case_cache_key

    keyed = cases.select(case_cache_key(F.col("source"), F.col("content")).alias("case_key"), F.lit("x").alias("agent"), F.lit("baseline").alias("skill_key"), F.lit(1).alias("iteration"), F.lit("hi").alias("response"), F.array().cast(scripts.CALLS).alias("tool_calls"))
    got = evaluate(cases, Replay(keyed), agent="x", samples_per_case=1, trust_scripts=True)
    assert {r["source"]: r["passed"] for r in got.results.collect()} == {"a.yaml": True, "b.yaml": False, "c.yaml": True}
    assert (tmp_path / "log").read_text().split() == ["a", "A"] and answers.count() == 3


RETRY = """
import os, sys
from pyspark.sql import SparkSession
from pyspark import TaskContext
from assayframe.operators import scripts
spark = SparkSession.builder.master("local[1,3]").config("spark.ui.enabled", "false").getOrCreate()
def ask(task, home):
    if TaskContext.get().attemptNumber() == 0 and task["k"] == 2:
        os._exit(9)  # the worker is lost in the middle of a task
    return open(os.path.join(home, "n")).read().strip(), []
rows = spark.createDataFrame([(1, "echo x >> $HOME/n", "true"), (2, "echo x >> $HOME/n", "true")], "k int, setup string, teardown string").coalesce(1)
print("GOT", [(r["k"], r["response"], r["script_error"]) for r in scripts.around(rows, ask).collect()])
"""


def test_a_task_that_spark_runs_again_starts_from_a_new_home():
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", RETRY], cwd=repo, env=os.environ | {"PYTHONPATH": repo}, capture_output=True, text=True, timeout=240)
    assert "GOT [(1, 'x', None), (2, 'x', None)]" in out.stdout, out.stderr[-2000:]


def _results(spark, rows):
    return spark.createDataFrame(
        [("s", k, "a", "b", i, r, [("T", "{}")], (True, "ok"), bad) for k, i, r, bad in rows],
        "set_name string, case_key string, agent string, skill_key string, iteration int, response string, tool_calls array<struct<name:string,input:string>>, judgment struct<pass:boolean,reasoning:string>, infra_failure boolean",
    )


def test_store_latest_lifetime_and_compaction(spark, tmp_path):
    from datetime import timedelta

    store = ResultStore(spark, str(tmp_path / "store"), buckets=4)
    store.record(_results(spark, [("k1", 1, "old", False), ("k2", 1, "x", True)]))
    store.record(_results(spark, [("k1", 1, "new", False), ("k3", 2, "y", False)]))
    found = lambda s: {(r["case_key"], r["iteration"]): r["response"] for r in s.entries("s", "a", "b").collect()}
    assert found(store) == {("k1", 1): "new", ("k3", 2): "y"}
    assert found(ResultStore(spark, store.path)) == found(store) and store.entries("s", "a", "other").count() == 0
    tables = len(spark.catalog.listTables())
    store.close()
    assert len(spark.catalog.listTables()) == tables - 1 and found(store) == {("k1", 1): "new", ("k3", 2): "y"}
    store.compact()
    assert found(store) == found(ResultStore(spark, store.path)) == {("k1", 1): "new", ("k3", 2): "y"}
    assert spark.read.parquet(f"{store.path}/v1").count() == 2 and not os.path.exists(f"{store.path}/v0")
    old = ResultStore(spark, store.path, lifetime=timedelta(seconds=0))
    assert found(old) == {}
    old.compact()
    assert found(ResultStore(spark, store.path)) == {}


def test_repeated_and_interrupted_writes(spark, tmp_path, monkeypatch):
    store = ResultStore(spark, str(tmp_path / "store"), buckets=4)
    rows = _results(spark, [("k1", 1, "x", False), ("k2", 1, "y", False)])
    store.record(rows, "t1")
    store.record(rows, "t1")  # a repeated write adds nothing
    assert spark.table(store._table()).count() == 2
    # the process ends between the journal and the table
    monkeypatch.setattr(ResultStore, "_settle", lambda self, token: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        store.record(_results(spark, [("k3", 1, "z", False)]), "t2")
    monkeypatch.undo()
    assert store.entries("s", "a", "b").count() == 2
    os.makedirs(f"{store.path}/pending/t3")  # a journal entry that was not written whole
    again = ResultStore(spark, store.path)
    assert sorted(r["response"] for r in again.entries("s", "a", "b").collect()) == ["x", "y", "z"] and not os.listdir(f"{store.path}/pending")
    # the process ends between the table and the removal of the journal
    rows = lambda *r: coded(_results(spark, list(r)).drop("infra_failure")).selectExpr("*", "current_timestamp() as stored_at", "'t4' as token")
    store._append(rows(("k4", 1, "w", False)), again._table())
    rows(("k4", 1, "w", False), ("k5", 1, "v", False)).write.parquet(f"{store.path}/pending/t4")
    assert ResultStore(spark, store.path).entries("s", "a", "b").count() == 5
    assert spark.read.parquet(f"{store.path}/v0").where("case_key = 'k4'").count() == 1


def test_lookup_does_not_move_the_store(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), buckets=4)
    store.record(_results(spark, [(f"k{i}", i % 2 + 1, "x", False) for i in range(50)]))
    tasks = spark.range(80).selectExpr("concat('k', id) as case_key", "cast(id % 2 + 1 as int) as iteration")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        looked = store.look_up(tasks, "s", "a", "b")
        plan = looked._jdf.queryExecution().executedPlan().toString()
        assert looked.where("cached").count() == 50 and looked.count() == 80
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "PartitionFilters: [isnotnull(set_name" in plan


def test_written_through_under_skip_cache_and_over_a_crash(spark, tmp_path, monkeypatch):
    base, log, store = tmp_path / "evals", tmp_path / "calls", str(tmp_path / "store")
    base.mkdir()
    for n in "ab":
        (base / f"{n}.yaml").write_text(CASE.format(n=n, extra=""))
    cases = documents.load_cases(spark, str(base))
    path = str(log)

    def ask(task, home):
        with open(path, "a") as file:
            file.write(task["name"])
        return "hi", []

    def run(**more):
        return {(r["source"], r["cached"], r["passed"]) for r in evaluate(cases, Calls(ask), agent="x", samples_per_case=1, cache=store, **more).results.collect()}

    with monkeypatch.context() as own:  # the process ends after the journal is written
        own.setattr(ResultStore, "_settle", lambda self, token: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            run()
    assert sorted(log.read_text()) == ["a", "b"]
    assert run() == {("a.yaml", True, True), ("b.yaml", True, True)} and len(log.read_text()) == 2
    assert run(skip_cache=True) == {("a.yaml", False, True), ("b.yaml", False, True)} and len(log.read_text()) == 4
    assert run() == {("a.yaml", True, True), ("b.yaml", True, True)} and len(log.read_text()) == 4
