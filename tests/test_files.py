import hashlib
from pathlib import Path, PurePosixPath

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayframe.operators import numbering, samples
from assayframe.sources import documents, files

CASE = "timestamp: 2025-01-01T00:00:00Z\nname: {n}\nprompt: p\nexpected: fine\n"


@pytest.fixture
def folder(tmp_path):
    for n in ("b/x", "a", "a-1", "b/y/z", "c"):
        path = tmp_path / f"{n}.yaml"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(CASE.format(n=n))
    (tmp_path / "note.txt").write_text("no case")
    return tmp_path


def test_cases_format_equals_the_text_reader(spark, folder):
    files.register(spark)
    got = spark.read.format("cases").load(str(folder))
    want = documents.load_cases(spark, str(folder)).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.read.format("cases").load(f"file://{folder}/a.yaml").first()["name"] == "a"


def test_partitions_are_planned_by_bytes(spark, folder):
    files.register(spark)
    read = lambda **o: spark.read.format("cases").options(**o).load(str(folder))
    assert read().rdd.getNumPartitions() == 1 and read(partitionBytes=1).rdd.getNumPartitions() == 5
    assert files.planned([5, 5, 100, 1, 1], 12, 0) == [(0, 2), (2, 3), (3, 5)]
    assert files.planned([], 5, 1) == [] and files.planned([0] * 10, 6, 2) == [(0, 3), (3, 6), (6, 9), (9, 10)]


def test_bad_files_as_asked(spark, folder):
    files.register(spark)
    (folder / "bad.yaml").write_text("a: [")
    (folder / "few.yaml").write_text("name: x\n")
    (folder / "raw.yaml").write_bytes(b"\xff\xfe")
    read = lambda bad: spark.read.format("cases").option("badFiles", bad).load(str(folder))
    rows = {r["source"]: r for r in read("row").collect()}
    assert len(rows) == 8 and rows["bad.yaml"]["error"].startswith("invalid YAML") and rows["raw.yaml"]["error"] == "not UTF-8 at byte 0" and rows["raw.yaml"]["content"] is None
    assert rows["few.yaml"]["error"] == "missing required fields: expected, prompt, timestamp" and rows["few.yaml"]["name"] == "x" and rows["a.yaml"]["error"] is None
    assert read("drop").count() == 5
    with pytest.raises(PySparkException, match="bad.yaml: invalid YAML"):
        read("error").collect()
    with pytest.raises(PySparkException, match="badFiles"):
        read("nothing").collect()


def test_skills_format(spark, tmp_path):
    files.register(spark)
    for n, readme in (("one", True), ("two", False)):
        (tmp_path / n).mkdir()
        (tmp_path / n / "SKILL.md").write_text(f"---\nname: {n}\ndescription: d\n---\n# {n}\n")
        if readme:
            (tmp_path / n / "README.md").write_text("x")
    read = spark.read.format("skills").load(str(tmp_path))
    docs = {r["folder"]: (r["fields"]["name"], r["filename"]) for r in documents.parse_skills(read.select("path", "content")).collect()}
    assert docs == {"one": ("one", "SKILL.md"), "two": ("two", "SKILL.md")}
    assert {r["path"]: r["has_readme"] for r in read.collect()} == {"one/SKILL.md": True, "two/SKILL.md": False}


def test_global_numbers_without_one_task(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    got = numbering.numbered(rows, "x", name="n", parts=4)
    assert all(r["x"] == r["n"] for r in got.collect()) and got.count() == 1000 and got.rdd.getNumPartitions() > 1
    assert numbering.numbered(rows.limit(0), "x").collect() == []
    ties = numbering.numbered(spark.range(50).select(F.lit(1).alias("x"), "id"), "x", first=10)
    assert sorted(r["number"] for r in ties.collect()) == list(range(10, 60)) and ties.collect() == ties.collect()
    down = numbering.numbered(rows, F.desc("x"), name="n")
    assert all(r["x"] + r["n"] == 999 for r in down.collect())


def test_first_seen_order(spark):
    rows = spark.createDataFrame([(5, "b"), (1, "c"), (2, "a"), (3, "c"), (9, "a")], "at int, k string")
    got = numbering.in_first_seen_order(rows.groupBy("k").count(), rows, "k", "at")
    assert [(r["number"], r["k"], r["count"]) for r in got.orderBy("number").collect()] == [(0, "c", 2), (1, "a", 2), (2, "b", 1)]


def test_cases_are_numbered_without_one_task(spark, folder):
    cases = documents.load_cases(spark, str(folder))
    plan = cases._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert [r["source"] for r in cases.orderBy("case_idx").collect()] == ["a-1.yaml", "a.yaml", "b/x.yaml", "b/y/z.yaml", "c.yaml"]


def test_directory_hash_streams(spark, tmp_path):
    names = ["a.txt", "a/b", "a/c/d", "b", "ü/x", "a-1"]
    rows = [("f1", n, f"text {n}\n") for n in names] + [("f2", "only", None), (None, "x", "y")]
    got = {r["folder"]: r["dir_hash"] for r in samples.directory_hash(spark.createDataFrame(rows, "folder string, rel string, content string").repartition(4)).collect()}
    lines = "\n".join(f"{p}:text {p}\n" for p in sorted(map(PurePosixPath, names)))
    short = lambda t: hashlib.sha256(t.encode()).hexdigest()[:12]
    assert got == {"f1": short(lines), "f2": short("only:"), None: short("x:y")}
    assert samples.directory_hash(spark.createDataFrame([], "folder string, rel string, content string")).count() == 0
    assert isinstance(sorted(map(Path, names))[0], Path)


def test_directory_larger_than_a_batch(spark):
    """A folder of 60 MB goes through a task in batches."""
    rows = spark.range(60).select(F.lit("f").alias("folder"), F.format_string("%03d", "id").alias("rel"), F.repeat(F.lit("x"), 1_000_000).alias("content"))
    whole = hashlib.sha256("\n".join(f"{i:03d}:{'x' * 1_000_000}" for i in range(60)).encode()).hexdigest()[:12]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(4 << 20))
    try:
        assert samples.directory_hash(rows).first()["dir_hash"] == whole
    finally:
        spark.conf.set(key, before)
