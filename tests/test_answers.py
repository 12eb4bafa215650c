import json

import pytest
from pyspark.sql import functions as F

from assayframe.errors import JudgeError
from assayframe.functions import schema
from assayframe.plans.answers import NO_ANSWER, require_valid, valid_answers

SCHEMA = {
    "type": "object",
    "required": ["a", "n"],
    "additionalProperties": False,
    "properties": {
        "a": {"type": ["string", "null"], "minLength": 2, "pattern": "^x"},
        "n": {"$ref": "#/$defs/n"},
        "l": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["q"], "properties": {"q": {"enum": [1, "two", None, True]}}}},
        "o": {"anyOf": [{"type": "integer"}, {"type": "object", "required": ["z"]}]},
        "c": {"const": "k"},
        "b": {"allOf": [{"minimum": 3}, {"maximum": 5.5}]},
    },
    "$defs": {"n": {"type": "number"}},
}
CASES = {
    '{"a":"xy","n":1}': [],
    '{"a":null,"n":2.5,"l":[{"q":1},{"q":"two"},{"q":null},{"q":true}],"o":3,"c":"k","b":4}': [],
    '{"a":"x","n":"1"}': ["$.a is shorter than 2", "$.n is not of type number"],
    '{"a":"yy","n":1,"m":0,"k":0}': ["$.a does not match ^x", "$ has also k, m"],
    '{"n":1,"l":[]}': ["$ has no a", "$.l has fewer than 1 entries"],
    '{"a":"xy","n":1,"l":[{"q":1},{},{"q":2}]}': ["$.l[1] has no q", '$.l[2].q is not one of 1, "two", null, true'],
    '{"a":"xy","n":1,"o":{"y":1},"c":"l","b":2}': ["$.o fits none of the schemas allowed", '$.c is not one of "k"', "$.b is less than 3"],
    '{"a":"xy","n":1,"b":6}': ["$.b is more than 5.5"],
    "[1]": ["$ is not of type object"],
    "3": ["$ is not of type object"],
    "{broken": ["$ is not JSON"],
}


def test_violations_are_told_by_place(spark):
    rows = spark.createDataFrame([(t,) for t in CASES], "t string")
    got = {r["t"]: r["p"] for r in rows.select("t", schema.problems(F.col("t"), SCHEMA).alias("p")).collect()}
    assert {t: sorted(p) for t, p in got.items()} == {t: sorted(p) for t, p in CASES.items()}


def test_integers_and_types(spark):
    one = lambda kind, text: spark.range(1).select(schema.problems(F.lit(text), {"type": kind})).first()[0] == []
    assert one("integer", "3") and one("integer", "3.0") and not one("integer", "3.5") and one("number", "3.5") and one("null", "null") and one("boolean", "true") and not one("string", "true")


def test_schemas_that_cannot_be_compiled():
    loop = {"$ref": "#/$defs/x", "$defs": {"x": {"properties": {"y": {"$ref": "#/$defs/x"}}}}}
    with pytest.raises(ValueError, match="itself"):
        schema.problems(F.lit("{}"), loop)
    with pytest.raises(ValueError, match="not in this schema"):
        schema.problems(F.lit("{}"), {"$ref": "other.json"})


def test_nesting_does_not_multiply_the_work(spark):
    def deep(n):
        return {"type": "object", "required": ["x"], "properties": {"x": deep(n - 1)}} if n else {"type": "integer", "minimum": 3}

    told = [str(schema.problems(F.col("t"), deep(n))) for n in (1, 2, 3)]
    reads = [x.count("variant_get") for x in told]
    assert all(x.count("parse_json") == 1 for x in told) and reads[2] - reads[1] == reads[1] - reads[0] > 0
    value = F.lit('{"x":' * 3 + "2" + "}" * 3)
    assert spark.range(1).select(schema.problems(value, deep(3))).first()[0] == ["$.x.x.x is less than 3"]


def test_rounds_ask_again_with_what_was_wrong(spark):
    asked = spark.createDataFrame([(k, f"prompt {k}") for k in ("good", "late", "never", "silent")], "path string, prompt string")
    rounds = []

    def call(todo):
        rounds.append({r["path"]: r["prompt"] for r in todo.collect()})
        reply = F.when(F.col("path") == "good", 'Sure: ```json\n{"a":"xy","n":1}\n```').when(F.col("path") == "late", F.lit('{"a":"xy"}' if len(rounds) == 1 else '{"a":"xy","n":5}')).otherwise("{}")
        return todo.where("path <> 'silent'").select("path", reply.alias("answer"))

    got = valid_answers(asked, call, SCHEMA, attempts=3)
    rows = {r["path"]: (r["answer"] and json.loads(r["answer"]), r["attempt"], r["problems"]) for r in got.collect()}
    assert rows["good"] == ({"a": "xy", "n": 1}, 1, []) and rows["late"] == ({"a": "xy", "n": 5}, 2, [])
    assert rows["never"][0] is None and rows["never"][1] == 3 and sorted(rows["never"][2]) == ["$ has no a", "$ has no n"] and rows["silent"][2] == [NO_ANSWER]
    assert [sorted(r) for r in rounds] == [["good", "late", "never", "silent"], ["late", "never", "silent"], ["never", "silent"]]
    assert "$ has no n" in rounds[1]["late"] and "$ has no n" not in rounds[0]["late"] and NO_ANSWER in rounds[1]["silent"]
    with pytest.raises(JudgeError, match="has no a"):
        require_valid(got.where("path = 'never'"))
    assert require_valid(got.where("path = 'good'")).count() == 1
