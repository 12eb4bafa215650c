import math
import re

import pytest
from pyspark.sql import functions as F

from assayframe.errors import CaseValidationError
from assayframe.functions import metrics, text, verdicts
from assayframe.operators import grading, rounds, samples, status, transcripts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_metrics_by_binomials(spark):
    rows = spark.createDataFrame([(n, c, k) for n in range(7) for c in range(n + 1) for k in range(8)], "n int, c int, k int")
    for n, c, k, at, power in rows.select("n", "c", "k", metrics.pass_at_k("n", "c", "k"), metrics.pass_pow_k("n", "c", "k")).collect():
        if n == 0 or k > n:
            assert at is None and power is None
        else:
            assert at == pytest.approx(0.0 if c == 0 else 1 - math.comb(n - c, k) / math.comb(n, k))
            assert power == pytest.approx(0.0 if c < k else math.comb(c, k) / math.comb(n, k))


def test_rates(spark):
    assert one(spark, metrics.pass_rate(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, metrics.percent_text(F.lit(12.5))) == "12%"
    assert one(spark, metrics.rate_colour(F.lit(50.0))) == "yellow"


@pytest.mark.parametrize(
    "kind,value,response,holds",
    [
        ("contains", "HELLO", "say hello", True),
        ("not_contains", "x", "abc", True),
        ("starts_with", "A", "abc", True),
        ("starts_with", "a", " abc", False),
        ("ends_with", "C", "abc  \n", True),
        ("ends_with", "c ", "abc ", False),
        ("regex", r"^a.c$", "abc", True),
        ("regex", r"B", "abc", False),
        ("regex", r"(", "abc", False),
        ("contains", "a", None, False),
    ],
)
def test_assertions(spark, kind, value, response, holds):
    rows = spark.createDataFrame([(response, ["Bash"], [(kind, value)])], "response string, tools array<string>, assertions array<struct<type:string,value:string>>")
    got = grading.grade(rows).first()["judgment"]
    assert got["pass"] is holds
    assert (got["reasoning"] == "All assertions passed") is holds


def test_all_assertions_are_told(spark):
    asked = [("contains", "zz"), ("regex", "q"), ("tool_called", "Write"), ("regex", "b"), ("regex", "("), ("tool_not_called", "Bash")]
    rows = spark.createDataFrame([("abc", ["Bash"], asked)], "response string, tools array<string>, assertions array<struct<type:string,value:string>>")
    reason = grading.grade(rows).first()["judgment"]["reasoning"]
    assert [r.split(":")[0] for r in reason.split("; ")] == ["contains", "regex", "tool_called", "regex", "tool_not_called"]


def test_long_responses_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 1 << 26)
    try:
        rows = spark.range(0, 12, 1, 1).select(F.repeat(F.lit("x"), 4 << 20).alias("response"), F.array().cast("array<string>").alias("tools"), F.array(F.struct(F.lit("regex").alias("type"), F.lit("y").alias("value"))).alias("assertions"))
        graded = grading.grade(rows)
        size = F.pandas_udf(lambda texts: texts.str.len() * 0 + len(texts), "long")  # rows that came in one batch
        assert max(r["n"] for r in rows.select(size("response").alias("n")).collect()) <= 3
        assert [r["judgment"]["pass"] for r in graded.select("judgment").collect()] == [False] * 12
    finally:
        spark.conf.set(key, before)


def test_assertion_validation(spark):
    rows = spark.createDataFrame([([("contains", "a"), (None, "b"), ("odd", "c"), ("regex", None), None],)], "a array<struct<type:string,value:string>>")
    assert rows.select(grading.validation_errors(F.col("a")).alias("e")).first()["e"] == ["assertion 1: missing 'type'", "assertion 2: unknown type 'odd'", "assertion 3: missing 'value'", "assertion 4: must be a mapping"]


@pytest.mark.parametrize(
    "answer,passed,reasoning",
    [
        ('{"pass": true, "reasoning": "ok"}', True, "ok"),
        ('```json\n{"passed": "no"}\n```', False, ""),
        ('I think {"pass": 1} is right', True, ""),
        ('{"pass": 2}', None, None),
        ("no json", None, None),
        ("[1]", None, None),
        (None, None, None),
    ],
)
def test_verdicts(spark, answer, passed, reasoning):
    rows = spark.createDataFrame([(answer,)], "answer string")
    got = rows.select(verdicts.verdict(F.col("answer")).alias("v")).first()["v"]
    assert (got["pass"], got["reasoning"]) == (passed, reasoning)


def test_text_functions(spark):
    assert one(spark, text.parse_domain(F.lit("\t\u2003Functional\n"))) == "functional"
    assert one(spark, text.word_count(F.lit("\u00a0a\u3000\x1fb "))) == 2 and one(spark, text.word_count(F.lit(" \n"))) == 0
    assert one(spark, text.raw_frontmatter(F.lit(" ---\r\na: 1\r\nb\n--- \nrest"))) == "a: 1\nb" and one(spark, text.raw_frontmatter(F.lit("---\n---"))) == ""
    assert one(spark, text.raw_frontmatter(F.lit("---\na"))) is None and one(spark, text.raw_frontmatter(F.lit("x\n---\n---"))) is None
    assert one(spark, text.first_lines(F.lit("a\nb\nc"), 2)[0]) == ["a", "b"] and one(spark, text.first_lines(F.lit("a\nb\nc"), 2)[1]) == 1
    assert one(spark, text.word_count(F.lit("  a b\tc\n"))) == 3
    assert one(spark, text.word_count(F.lit(""))) == 0
    assert one(spark, text.name_part(F.lit("  Über cool!! "), F.lit(4))) == "Über-cool"
    assert one(spark, text.name_part(F.lit("!!!"), F.lit(4))) == "candidate-5"
    assert one(spark, text.template("$a ${b} $$ $c", a=F.lit("${b}"), b=F.lit("x"))) == "${b} x $ $c"
    assert one(spark, text.case_cache_key(F.lit("a.yaml/b.yaml"), F.lit(""))) == "a/b-e3b0c44298fc"
    assert one(spark, text.section_items(F.lit("## goals\n\n- a\n* b\n## Next\n1. c\n"), "Goals")) == ["a", "b"]
    assert one(spark, text.code_examples(F.lit("```py\nx\n```\n```\ny\n```"))) == ["x\n", "y\n"]


@pytest.mark.parametrize("content", ["---\na: 1\n---\nbody", "---\na: 1\nno end", "plain", "", "---\n---\n\nb", "---x\n---y"])
def test_frontmatter_split(spark, content):
    front, body = spark.range(1).select(*text.split_frontmatter(F.lit(content))).first()
    found = re.match(r"---([\s\S]*?)\n---\n?([\s\S]*)", content)
    assert body == (found[2] if found else content)
    assert (front is None) == (found is None)


def test_expand_and_cache(spark):
    cases = spark.createDataFrame([(0, "", []), (1, "run", [("contains", "x")])], "case_idx int, setup string, assertions array<struct<type:string,value:string>>")
    tasks = samples.expand(cases.withColumn("teardown", F.lit("")), 2)
    rows = {(r["case_idx"], r["iteration"]): r for r in tasks.collect()}
    assert len(rows) == 4 and rows[0, 1]["setup"] is None and rows[0, 1]["assertions"] is None and rows[1, 2]["setup"] == "run"
    assert samples.expand(cases, 0).count() == 0
    cache = spark.createDataFrame([(0, 1, True)], "case_idx int, iteration int, passed boolean")
    keys = ("case_idx", "iteration")
    assert samples.with_cache(tasks, cache, keys).where("cached").count() == 1
    assert samples.with_cache(tasks, cache, keys, skip=True).where("cached").count() == 0
    assert samples.not_cached(tasks, cache, keys).count() == 3
    with pytest.raises(CaseValidationError):
        samples.sample_cases(cases, -1)
    assert samples.sample_cases(cases, 1).count() == 1 and samples.sample_cases(cases, 0).count() == 2
    assert samples.sample_cases(cases, 2).columns == cases.columns and [r["case_idx"] for r in samples.sample_cases(cases, 5).collect()] == [0, 1]


def test_best_rounds_take_the_latest_of_equals(spark):
    rows = spark.createDataFrame([("r", 1, 50.0), ("r", 2, 80.0), ("r", 3, 80.0), ("r", 4, 10.0)], "run string, round int, pass_rate double")
    assert rounds.best_round(rows).first()["best_round"] == 3
    assert [r["best_round"] for r in rounds.running_best(rows).orderBy("round").collect()] == [1, 2, 3, 3]
    assert rounds.first_at_target(rows, 80).first()["stop_round"] == 2
    assert rounds.gain(rows).first()["gain"] == 30.0


def test_block_stream(spark):
    raw = ['{"type":"system","subtype":"init","session_id":"s1"}', "", "oops", "[]", '{"type":"result","result":" end "}', '{"type":"assistant","message":{"content":[{"type":"tool_use","name":"Bash","input":{"b":1,"a":2}}]}}']
    lines = spark.createDataFrame([("t", 0, i, r) for i, r in enumerate(raw)] + [("t", 1, 0, '{"type":"assistant","message":{"content":[{"type":"text","text":" hi"},{"type":"text","text":" there "}]}}')], "task_key string, turn int, line_no int, raw string")
    turns = transcripts.block_stream(lines)
    first, second = turns.orderBy("turn").collect()
    assert (first["text"], first["session_id"], [t["name"] for t in first["tool_calls"]]) == ("end", "s1", ["Bash"])
    assert second["text"] == "hi there"
    whole = transcripts.whole_answers(turns).first()
    assert whole["text"] == "hi there" and len(whole["tool_calls"]) == 1


def test_item_stream(spark):
    raw = ['{"type":"thread.started","thread_id":"h"}', '{"type":"item.completed","item":{"type":"agent_message","text":"a"}}', '{"type":"item.completed","item":{"id":"1","type":"command_execution","status":"ok","command":"ls"}}', '{"type":"item.completed","item":{"type":"agent_message","text":" b "}}', '{"type":"turn.failed","error":{"message":"bad"}}']
    lines = spark.createDataFrame([("t", 0, i, r) for i, r in enumerate(raw)], "task_key string, turn int, line_no int, raw string")
    got = transcripts.item_stream(lines).first()
    assert (got["text"], got["thread_id"], got["error"], got["tool_calls"][0]["name"], got["tool_calls"][0]["input"]) == ("b", "h", "bad", "command_execution", '{"command": "ls"}')


def test_status(spark):
    events = spark.createDataFrame([(0, 1, "pending", None, 0), (0, 1, "done", True, 5), (0, 2, "cached", True, 3), (1, 1, "running", None, 4)], "case_idx int, iteration int, state string, passed boolean, seq int")
    states = status.latest_state(events)
    assert status.state_counts(states).first().asDict() == {"n_pass": 1, "n_fail": 0, "n_running": 1, "n_cached": 1, "n_pending": 0}
    assert [r["percent"] for r in status.case_percent(states, False).orderBy("case_idx").collect()] == [100.0, None]
    assert status.compact_percent(states).first()["percent"] == 100.0
