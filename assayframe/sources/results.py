"""Caches, candidates, improvement runs: where results are kept."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.errors import SkillError
from assayframe.functions.text import name_part
from assayframe.operators.samples import CACHE_KEYS, cacheable, latest

PARTITIONS = ("set_name", "agent", "skill_key")


def write_cache(results: DataFrame, path: str) -> None:
    """Append what may be cached, partitioned so that a lookup reads only its own set, agent and skill."""
    cacheable(results).drop("infra_failure", "cached").withColumn("stored_at", F.current_timestamp()).write.partitionBy(*PARTITIONS).mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str, **where: str) -> DataFrame:
    """The latest entry of every key; conditions on PARTITIONS prune folders."""
    entries = spark.read.parquet(path)
    for name, value in where.items():
        entries = entries.where(F.col(name) == value)
    return latest(entries, CACHE_KEYS, "stored_at").drop("stored_at")


def save_run(run: DataFrame, path: str) -> None:
    """An improvement run (one nested row) as JSON."""
    run.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_run(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def candidate_files(candidates: DataFrame, existing: DataFrame, stamp: str) -> DataFrame:
    """Candidates with their file name; a name that exists, or that an earlier candidate has, gets the stamp and its number."""
    named = candidates.withColumn("name_part", name_part(F.col("name"), F.col("ord")))
    first = named.groupBy("name_part").agg(F.min("ord").alias("first_ord"))
    taken = existing.select(F.col("file").alias("_file")).distinct()
    plain = F.concat("name_part", F.lit(".yaml"))
    both = named.join(first, "name_part").join(taken, plain == F.col("_file"), "left")
    free = F.col("_file").isNull() & (F.col("ord") == F.col("first_ord"))
    numbered = F.concat("name_part", F.lit(f"-{stamp}-"), (F.col("ord") + 1).cast("string"), F.lit(".yaml"))
    return both.withColumn("file", F.when(free, plain).otherwise(numbered)).drop("name_part", "first_ord", "_file")


#: what a reviewer is told at the head of a candidate's file
REVIEW_NOTE = "A generated test case, not yet checked: edit it as needed, and drop these comments once it is accepted."


def candidate_yaml(row: dict, timestamp: str, skill_name: str | None = None) -> str:
    """A candidate's file: the case as YAML, under comments with what the generator said of it."""
    import yaml

    def dumped(fields: dict) -> str:
        return yaml.dump(fields, default_flow_style=False, allow_unicode=True, sort_keys=False)

    said = {"generated": True, "skill_name": skill_name} | {k: row.get(k) for k in ("category", "domain", "source", "confidence", "rationale")}
    if row.get("confidence") is not None:
        said["sure"] = f"{row['confidence']:.0%}"
    about = dumped({"_meta": {k: v for k, v in said.items() if v not in (None, "")}})
    head = "".join(f"# {line}\n" for line in (REVIEW_NOTE, *about.splitlines()))
    return head + dumped({"timestamp": timestamp, "name": row["name"], "prompt": row["prompt"], "expected": row["expected"]})


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """One small file in whatever store a path is in; an existing one is an error unless it may be overwritten."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    """One small file in whatever store a path is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def cache_name(spark: SparkSession, name: str) -> str:
    """The name that results of a set are kept under: the last part of its full path if the set is a path that is there, else the name as it is."""
    if not name or not exists(spark, name):
        return name
    where = spark._jvm.org.apache.hadoop.fs.Path(name)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(where).getName()


def write_candidates(candidates: DataFrame, folder: str, stamp: str, timestamp: str, skill_name: str | None = None) -> list[str]:
    """Write each candidate to a file of its own in a folder, beside what is there, and give the names; rows come to the driver one at a time."""
    spark = candidates.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [f.getPath().getName() for f in store.listStatus(where)] if store.exists(where) else []
    named = candidate_files(candidates, spark.createDataFrame([(n,) for n in there], "file string"), stamp)
    names = []
    for row in named.orderBy("ord").toLocalIterator():
        write_text(spark, f"{folder.rstrip('/')}/{row['file']}", candidate_yaml(row.asDict(), timestamp, skill_name))
        names.append(row["file"])
    return names


def create_skill(spark: SparkSession, folder: str, document: str, overwrite: bool = False) -> str:
    """Write a skill's document in a folder of its own and give its path; a folder that is there is replaced only on request."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(where):
        if not overwrite:
            raise SkillError(f"{folder} exists")
        store.delete(where, True)
    path = f"{folder.rstrip('/')}/SKILL.md"
    write_text(spark, path, document)
    return path


def tune_path(name: str, stamp: str, root: str = "") -> str:
    """Where an improvement run of a set of cases is kept unless told otherwise."""
    return "/".join(filter(None, [root.rstrip("/"), "tunes", name.rstrip("/").rsplit("/", 1)[-1], f"{stamp}.json"]))


def run_json(row) -> str:
    """A nested row as indented JSON, for one file that people read."""
    return json.dumps(row.asDict(recursive=True), indent=2, default=str)
