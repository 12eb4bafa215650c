"""Lint rules that are no columns, as table functions.

A rule of this kind reads one document and yields findings: a class with ``rule`` and ``check(document) -> Iterator[(message, severity, line)]``. ``setup`` is
called once in each Spark task, so what a rule needs (a client, a model, a word list) is made there. All of them run in one pass: a Python table function with a
table argument goes over the documents once, partition by partition, and calls every rule for each; columns that no rule reads are not sent. A rule that raises
gives a finding of its own kind instead of ending the run.

The same function is there in SQL: ``SELECT * FROM lint_documents(TABLE(SELECT path, content FROM skills))``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from assayframe.operators import lint

FAILED = "rule-failed"
FINDINGS = T.StructType([T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("message", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("ord", T.IntegerType())])


class DocumentRule(Protocol):
    """A rule over whole documents."""

    rule: str

    def setup(self) -> None:
        """Called once in each task, before the first document."""

    def check(self, document: dict) -> Iterator[tuple[str, str, int | None]]:
        """(message, severity, line) of each finding in a document: a dict of the table's columns."""


def _class_for(rules: list[DocumentRule], first: int):
    """The table function of some rules; its classes go to the tasks with it."""

    class LintDocuments:
        @staticmethod
        def analyze(documents: AnalyzeArgument) -> AnalyzeResult:
            if not documents.isTable or "path" not in documents.dataType.fieldNames():
                raise ValueError("a table with a column path is needed")
            return AnalyzeResult(FINDINGS)

        def __init__(self) -> None:
            self.ready = False

        def eval(self, documents):
            if not self.ready:
                for rule in rules:
                    rule.setup()
                self.ready = True
            document = documents.asDict(recursive=True)
            for i, rule in enumerate(rules, first):
                try:
                    for message, severity, line in rule.check(document):
                        yield document["path"], rule.rule, message, severity, line, i
                except Exception as e:
                    yield document["path"], FAILED, f"{rule.rule}: {type(e).__name__}: {e}", "error", None, i

    return LintDocuments


def table_function(rules: list[DocumentRule], first: int = 0):
    """A polymorphic table function of some rules, for ``asTable()`` arguments."""
    return F.udtf(_class_for(rules, first))


def register(spark: SparkSession, rules: list[DocumentRule], name: str = "lint_documents") -> None:
    """Make the rules callable from SQL."""
    spark.udtf.register(name, table_function(rules))


def lint_with(skills: DataFrame, rules: list[DocumentRule], columns: tuple[str, ...] = ("path", "content", "fields", "body"), only: list[str] | None = None) -> DataFrame:
    """Findings of the column rules and of these: one projection and, if there are any, one pass of the table function."""
    columns_only = None if only is None else [r for r in only if r in lint.RULES]
    found = lint.lint(skills.limit(0) if columns_only == [] else skills, columns_only)
    chosen = [r for r in rules if only is None or r.rule in only]
    if not chosen:
        return found
    more = table_function(chosen, first=len(lint.RULES))(skills.select(*columns).asTable())
    return found.unionByName(more.select(*found.columns))
