"""Small functions and sinks, each with what it gives."""

import json

from pyspark.sql import functions as F

from assayframe.functions import text
from assayframe.operators import status, transcripts
from assayframe.plans import tune
from assayframe.sources import documents, results


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rendered_lists_and_schemas(spark):
    assert one(spark, text.numbered_sections(F.array(F.lit("a"), F.lit("b\nc")), "Case")) == "## Case 1\na\n\n## Case 2\nb\nc"
    assert one(spark, text.numbered_sections(F.array().cast("array<string>"), "Case")) == ""
    got = one(spark, text.with_schema(F.lit("Do it."), '{"type":"object"}'))
    assert got.startswith("Do it.\n\nAnswer with one JSON object") and got.endswith('\n{"type":"object"}')


def test_tool_calls_as_told_to_a_judge(spark):
    rows = spark.createDataFrame([(1, [("Bash", '{"a": [1, {"b": "é"}], "c": {}}'), ("Read", None)]), (2, []), (3, None)], "i int, calls array<struct<name:string,input:string>>")
    got = {r["i"]: r["t"] for r in rows.select("i", transcripts.format_tool_calls("calls").alias("t")).collect()}
    assert got[1] == "- Bash: " + json.dumps({"a": [1, {"b": "é"}], "c": {}}, indent=2) + "\n- Read: {}"
    assert got[2] == got[3] == "(no tools used)"


def test_states_of_tasks(spark):
    assert one(spark, status.task_key(F.lit(3), F.lit(2))) == "3:2"
    kinds = [("done", True, "pass", "✓"), ("done", False, "fail", "✗"), ("done", None, "fail", "✗"), ("cached", False, "cached", "●"), ("running", None, "running", "◐"), ("pending", None, "pending", "○"), ("odd", None, "odd", "?")]
    rows = spark.createDataFrame([k[:2] for k in kinds], "state string, passed boolean")
    kind = status.bucket(F.col("state"), F.col("passed"))
    assert [tuple(r) for r in rows.select(kind, status.symbol(kind)).collect()] == [k[2:] for k in kinds]


def test_results_as_a_round_keeps_them(spark):
    rows = spark.createDataFrame([("a", True, (True, None), None, []), ("b", False, (False, "why"), "r", None)], "case_source string, passed boolean, judgment struct<pass:boolean,reasoning:string>, response string, tool_calls array<string>")
    got = [tuple(r) for r in tune.eval_results(rows).select("source", "passed", "reasoning", "response", "score").collect()]
    assert got == [("a", True, "", "", 1.0), ("b", False, "why", "r", 0.0)]


def test_templates_in_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("\nHi $name, ${what} costs $$5 $other\n")
    assert one(spark, documents.load_template(spark, str(tmp_path / "t.txt"), name=F.lit("$what"), what=F.lit("é"))) == "Hi $what, é costs $5 $other"


def test_training_rows(spark):
    cases = spark.createDataFrame([(["p"], "e", "n")], "prompt array<string>, expected string, name string")
    assert documents.training_rows(cases).columns == ["prompt", "expected"]


def test_runs_as_json(spark, tmp_path):
    schema = "name string, rounds array<struct<round:int,rate:double>>, note string"
    run = spark.createDataFrame([("r", [(1, 0.5), (2, None)], None)], schema)
    results.save_run(run, str(tmp_path / "run"))
    assert results.load_run(spark, str(tmp_path / "run"), schema).collect() == run.collect()
    assert '"note":null' in next((tmp_path / "run").glob("part-*.json")).read_text()
    assert json.loads(results.run_json(run.first())) == {"name": "r", "rounds": [{"round": 1, "rate": 0.5}, {"round": 2, "rate": None}], "note": None}


def test_words_are_counted_as_python_splits_them(spark):
    texts = ["", " ", "a", " a ", "a b", "\x1ca\x1d\x85b c\n", "x" * 50, "é 𝄞\t\tz ", " \n ", "​ a", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[1] for r in rows.select("t", text.word_count(F.col("t"))).collect()]
    assert got == [None if t is None else len(t.split()) for t in texts] or got == [-1 if t is None else len(t.split()) for t in texts]
