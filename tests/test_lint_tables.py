import pytest

from assayframe.operators import lint, lint_tables
from assayframe.sources import documents


def _rules():
    """Rules of one's own; made here, they go to the tasks by value."""

    class Shouting:
        rule = "no-shouting"

        def setup(self):
            self.most = 3

        def check(self, document):
            for i, line in enumerate(document["content"].split("\n"), 1):
                if sum(w.isupper() and len(w) > 1 for w in line.split()) > self.most:
                    yield f"Line shouts in '{document['fields'].get('name', '')}'", "warning", i

    class Broken:
        rule = "broken"

        def setup(self):
            pass

        def check(self, document):
            if "boom" in document["content"]:
                raise ValueError("boom")
            return iter(())

    return [Shouting(), Broken()]


@pytest.fixture
def skills(spark):
    head = "---\nname: {n}\ndescription: d\nlicense: x\ncompatibility: x\nmetadata: x\n---\n"
    rows = [(f"skills/{n}/SKILL.md", head.format(n=n) + body) for n, body in (("quiet", "all well\n"), ("loud", "ONE TWO THREE FOUR\n"), ("odd", "boom\n"))]
    docs = documents.parse_skills(spark.createDataFrame(rows, "path string, content string").repartition(2))
    return docs.selectExpr("*", "false as has_readme")


def test_both_kinds_of_rules_in_one_result(skills):
    got = sorted(map(tuple, lint_tables.lint_with(skills, _rules()).collect()))
    n = len(lint.RULES)
    assert got == [("skills/loud/SKILL.md", "no-shouting", "Line shouts in 'loud'", "warning", 8, n), ("skills/odd/SKILL.md", "rule-failed", "broken: ValueError: boom", "error", None, n + 1)]
    assert [r["rule"] for r in lint_tables.lint_with(skills, _rules(), only=["frontmatter-valid", "no-shouting"]).collect()] == ["no-shouting"]
    assert lint_tables.lint_with(skills, []).count() == 0
    plan = lint_tables.lint_with(skills, _rules())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPythonUDTF") == 1


def test_sql_callable(spark, skills):
    lint_tables.register(spark, _rules(), "own_rules")
    skills.select("path", "content", "fields").createOrReplaceTempView("own_skills")
    rows = spark.sql("SELECT rule, line FROM own_rules(TABLE(SELECT path, content, fields FROM own_skills)) ORDER BY rule").collect()
    assert [tuple(r) for r in rows] == [("no-shouting", 8), ("rule-failed", None)]
    with pytest.raises(Exception, match="column path"):
        spark.sql("SELECT * FROM own_rules(TABLE(SELECT content FROM own_skills))").collect()
