"""Findings in skill documents: every rule is a column, all run in one projection.

Input rows have path, content, filename, folder, has_readme (bool), fields (map of frontmatter keys to text; absent keys are absent)
and body. A rule gives an array of findings; ``RULES`` is open for rules of your own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions import text

# Fixed values of the rules.
RESERVED = ("claude", "anthropic")
MOST_DESCRIPTION, MOST_WORDS = 1024, 5000
RECOMMENDED = ("license", "compatibility", "metadata")
FILE_NAME = "SKILL.md"

_FINDING = "array<struct<rule:string,message:string,severity:string,line:int>>"


def _when(condition: Column, rule: str, message: Column | str, severity: str, line: int | None = None) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    found = F.array(F.struct(F.lit(rule).alias("rule"), message.alias("message"), F.lit(severity).alias("severity"), F.lit(line).cast("int").alias("line")))
    return F.when(F.coalesce(condition, F.lit(False)), found.cast(_FINDING)).otherwise(F.array().cast(_FINDING))


def _field(name: str) -> Column:
    return F.coalesce(F.col("fields")[name], F.lit(""))


def _required(name: str) -> Column:
    return _when(_field(name) == "", "frontmatter-valid", f"Frontmatter missing required field: {name}", "warning", 1)


def _delimiters() -> Column:
    opens, closes = text.opens_frontmatter(F.col("content")), text.closes_frontmatter(F.col("content"))
    return F.concat(
        _when(~opens, "frontmatter-delimiters", "File must start with --- frontmatter delimiter", "error", 1),
        _when(opens & ~closes, "frontmatter-delimiters", "Missing closing --- frontmatter delimiter", "error", 1),
    )


def _reserved() -> Column:
    found = F.filter(F.array(*map(F.lit, RESERVED)), lambda w: F.contains(F.lower(_field("name")), w))
    return _when(F.size(found) > 0, "name-no-reserved", F.concat(F.lit("Name must not contain reserved word '"), found[0], F.lit("'")), "error")


def _quoted(before: str, value: Column, after: str = "'") -> Column:
    return F.concat(F.lit(before), value, F.lit(after))


def _word_count() -> Column:
    # words are counted once, as the element of an array
    one = F.transform(F.array(text.word_count(F.col("body"))), lambda n: _when(n > MOST_WORDS, "body-word-count", _quoted("Body is ", n.cast("string"), f" words (recommended max {MOST_WORDS:,})"), "warning"))
    return F.flatten(one)


#: rule name to findings; order of the report
RULES: dict[str, Callable[[], Column]] = {
    "frontmatter-valid": lambda: F.concat(_required("name"), _required("description")),
    "frontmatter-delimiters": _delimiters,
    "frontmatter-no-xml": lambda: _when(text.raw_frontmatter(F.col("content")).rlike("[<>]"), "frontmatter-no-xml", "Frontmatter must not contain XML angle brackets (< >)", "error"),
    "filename-case": lambda: _when(F.col("filename") != FILE_NAME, "filename-case", _quoted(f"File should be named {FILE_NAME}, got ", F.col("filename"), ""), "warning"),
    "folder-kebab-case": lambda: _when(~text.kebab(F.col("folder")), "folder-kebab-case", _quoted("Folder name must be kebab-case, got '", F.col("folder")), "warning"),
    "name-kebab-case": lambda: _when((_field("name") != "") & ~text.kebab(_field("name")), "name-kebab-case", _quoted("Name must be kebab-case, got '", _field("name")), "warning"),
    "name-matches-folder": lambda: _when(
        (_field("name") != "") & (F.col("folder") != "") & (_field("name") != F.col("folder")),
        "name-matches-folder",
        F.concat(F.lit("Name '"), _field("name"), F.lit("' does not match folder '"), F.col("folder"), F.lit("'")),
        "warning",
    ),
    "name-no-reserved": _reserved,
    "description-length": lambda: _when(
        F.length(_field("description")) > MOST_DESCRIPTION,
        "description-length",
        _quoted("Description is ", F.length(_field("description")).cast("string"), f" chars (max {MOST_DESCRIPTION})"),
        "warning",
    ),
    "body-word-count": _word_count,
    "no-readme": lambda: _when(F.col("has_readme"), "no-readme", "Skill folder should not contain a README.md", "warning"),
} | {
    f"field-{name}": (lambda name=name: _when(~F.map_contains_key("fields", name), f"field-{name}", f"Missing recommended field: {name}", "warning")) for name in RECOMMENDED
}


def lint(skills: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """(path, rule, message, severity, line, ord), one row a finding."""
    chosen = F.concat(*[RULES[name]() for name in rules or RULES])
    return skills.select("path", F.posexplode(chosen).alias("ord", "f")).select("path", "f.*", "ord")


def finding_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings, and errors and warnings among them, of each key; without keys one row over all."""
    kind = F.col("severity")
    return findings.groupBy(*keys).agg(F.count("*").alias("n_findings"), F.count_if(kind == "error").alias("n_errors"), F.count_if(kind == "warning").alias("n_warnings"))
