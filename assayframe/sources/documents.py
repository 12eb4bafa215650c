"""Case files and skill documents as DataFrames.

Files are read whole by Spark (one row each); YAML is parsed in Arrow batches, where a bad file becomes an error in its row.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.errors import CaseValidationError, EmptyFolderError, SkillError
from assayframe.functions import text as texts
from assayframe.operators import grading, samples
from assayframe.operators.numbering import numbered
from assayframe.shared import bounded_batches
from assayframe.sources.results import read_text

_ASSERTIONS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))
CASE_FIELDS = T.StructType(
    [
        T.StructField("keys", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
        T.StructField("timestamp_raw", T.StringType()),
        T.StructField("prompt", T.ArrayType(T.StringType())),
        T.StructField("prompt_is_list", T.BooleanType()),
        *[T.StructField(n, T.StringType()) for n in ("name", "expected", "setup", "teardown", "domain", "actual")],
        T.StructField("assertions", _ASSERTIONS),
    ]
)


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return value.isoformat() if hasattr(value, "isoformat") else json.dumps(value, default=str)


def parse_case(content: str) -> dict:
    """The fields of one case file, with an error instead where it is no YAML mapping."""
    import yaml

    out: dict = {f.name: None for f in CASE_FIELDS.fields} | {"keys": []}
    try:
        data = yaml.safe_load(content)
    except yaml.YAMLError as e:
        return out | {"error": f"invalid YAML: {str(e).splitlines()[0]}"}
    if not isinstance(data, dict):
        return out | {"error": "case must be a mapping"}
    prompt = data.get("prompt")
    out |= {n: _text(data.get(n)) for n in ("name", "expected", "setup", "teardown", "domain", "actual")}
    out |= {"keys": sorted(map(str, data)), "timestamp_raw": _text(data.get("timestamp")), "prompt_is_list": isinstance(prompt, list)}
    out["prompt"] = None if prompt is None else [_text(p) for p in (prompt if isinstance(prompt, list) else [prompt])]
    asked = data.get("assertions")
    if asked is not None and not isinstance(asked, list):
        return out | {"error": "assertions must be a list"}
    out["assertions"] = [{"type": _text(a.get("type")), "value": _text(a.get("value"))} if isinstance(a, dict) else None for a in asked or []]
    return out


@F.pandas_udf(CASE_FIELDS)
def _cases(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_case(c) for c in contents], columns=[f.name for f in CASE_FIELDS.fields])


def parse_cases(files: DataFrame) -> DataFrame:
    """(source, content) to cases; case_idx counts from 0 in order of the sources' path components."""
    bounded_batches(files.sparkSession)
    parsed = files.withColumn("c", _cases("content")).select("source", "content", "c.*")
    # only sources are dealt by their order; contents stay where they are
    numbers = numbered(files.select("source").distinct(), F.split("source", "/"), name="case_idx").withColumn("case_idx", F.col("case_idx").cast("int"))
    return parsed.join(numbers, "source").withColumn("timestamp", F.try_to_timestamp("timestamp_raw"))


def invalid_cases(cases: DataFrame) -> DataFrame:
    """(source, problem) of cases that lack required fields or have bad assertions."""
    missing = samples.missing_fields(F.col("keys"))
    problem = F.coalesce(F.col("error"), F.nullif(F.concat(F.lit("missing required fields: "), F.nullif(missing, F.lit(""))), F.lit("")), F.try_element_at(grading.validation_errors(F.coalesce("assertions", F.array().cast(_ASSERTIONS))), F.lit(1)))
    return cases.select("source", problem.alias("problem")).where("problem is not null")


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    read = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _exists(spark: SparkSession, path: str) -> tuple[bool, bool, str]:
    """Whether a path exists and is a folder, in whatever store it is, and its full name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    there = store.exists(where)
    return there, there and store.getFileStatus(where).isDirectory(), store.makeQualified(where).toString()


def load_cases(spark: SparkSession, name: str, root: str = "") -> DataFrame:
    """Cases of one ``.yaml`` file, of a folder with all below it, or of ``root/evals/name``; validated before anything runs."""
    there, folder, full = _exists(spark, name)
    if not there:
        there, folder, full = _exists(spark, f"{root.rstrip('/')}/evals/{name}" if root else f"evals/{name}")
    if not there:
        raise EmptyFolderError(f"no cases at {name}")
    if not folder:
        if not full.endswith(".yaml"):
            raise CaseValidationError(f"{name} is not a .yaml file")
        files = _files(spark, full, "*.yaml").withColumn("source", F.lit(full.rsplit("/", 1)[1]))
    else:
        plain = F.regexp_replace("path", r"^[a-z]+:/+", "/")
        base = "/" + full.split(":", 1)[-1].lstrip("/").rstrip("/") + "/" if full.startswith("file:") else full.rstrip("/") + "/"
        files = _files(spark, full, "*.yaml").withColumn("source", F.replace(F.url_decode(plain if full.startswith("file:") else F.col("path")), F.lit(base), F.lit("")))
    cases = parse_cases(files.select("source", "content"))
    if cases.isEmpty():
        raise EmptyFolderError(f"no .yaml files in {name}")
    if bad := invalid_cases(cases).orderBy("source").first():
        raise CaseValidationError(f"{bad['source']}: {bad['problem']}")
    return cases


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _fields(fronts: pd.Series) -> pd.Series:
    """All keys of a frontmatter with their values as text; an empty map unless it is a YAML mapping."""
    import yaml

    def one(front):
        if front is None:
            return {}
        try:
            data = yaml.safe_load(front)
        except yaml.YAMLError:
            return {}
        return {str(k): _text(v) for k, v in data.items()} if isinstance(data, dict) else {}

    return fronts.map(one)


def parse_skills(files: DataFrame, exact: bool = True) -> DataFrame:
    """(path, content) to skill documents; exact=False reads only simple ``key: value`` lines, without Python."""
    front, body = texts.split_frontmatter(F.col("content"))
    parts = F.split("path", "/")
    if exact:
        bounded_batches(files.sparkSession)
    fields = _fields(front) if exact else F.coalesce(texts.simple_fields(front), F.create_map().cast("map<string,string>"))
    docs = files.withColumn("fields", fields)
    return docs.select(
        "path",
        "content",
        F.element_at(parts, -1).alias("filename"),
        F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")).alias("folder"),
        "fields",
        body.alias("body"),
        texts.section_items(body, "Goals").alias("goals"),
        texts.section_items(body, "Prohibitions").alias("prohibitions"),
        texts.code_examples(body).alias("examples"),
    )


def skill_file(spark: SparkSession, path: str) -> str:
    """The document of a skill: the file itself, or SKILL.md of a folder."""
    there, folder, full = _exists(spark, path)
    if there and folder:
        full = f"{full.rstrip('/')}/SKILL.md"
        there = _exists(spark, full)[0]
    if not there:
        raise SkillError(f"no skill at {path}")
    return full


def load_skills(spark: SparkSession, path: str) -> DataFrame:
    """Skill documents at a file or below a folder, with whether a README.md lies beside each."""
    folder = _exists(spark, path)[1]
    docs = parse_skills(_files(spark, path if folder else skill_file(spark, path), "*.md" if folder else "*").where(~F.endswith("path", F.lit("README.md"))))
    beside = lambda c: F.regexp_replace(F.regexp_replace(c, "/[^/]*$", ""), "^file:/+", "file:/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "README.md").load(path if folder else skill_file(spark, path).rsplit("/", 1)[0])
    readmes = listed.select(beside(F.col("path")).alias("_dir")).distinct().withColumn("has_readme", F.lit(True))
    return docs.join(readmes, beside(F.col("path")) == F.col("_dir"), "left").drop("_dir").withColumn("has_readme", F.coalesce("has_readme", F.lit(False)))


def analysis(skills: DataFrame) -> DataFrame:
    """What a generator is told of a skill."""
    field = lambda n: F.coalesce(F.col("fields")[n], F.lit("")).alias(n)
    return skills.select("path", field("name"), field("description"), "goals", "prohibitions", F.size("examples").cast("bigint").alias("example_count"), F.slice("examples", 1, 3).alias("first_examples"))


def load_template(spark: SparkSession, path: str, **columns: Column) -> Column:
    """The template in a file, white space at its ends taken off, filled in with columns."""
    return texts.template(read_text(spark, path).strip(), **columns)


def training_rows(cases: DataFrame) -> DataFrame:
    return cases.select("prompt", "expected")


def load_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as (task_key, turn, line_no, raw): one file a task, named ``key.turn.jsonl``."""
    name = F.regexp_replace("_metadata.file_name", r"\.jsonl$", "")
    turn = F.regexp_extract(name, r"\.(\d+)$", 1)
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.regexp_replace(name, r"\.\d+$", "").alias("task_key"), F.when(turn == "", 0).otherwise(turn.try_cast("int")).alias("turn"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "raw"))
