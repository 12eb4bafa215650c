"""Cases to tasks, cached results, and summaries of what ran."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from assayframe.errors import CaseValidationError
from assayframe.functions.metrics import pass_at_k, pass_pow_k, pass_rate
from assayframe.operators.numbering import in_first_seen_order
from assayframe.shared import bounded_batches

CACHE_KEYS = ("set_name", "case_key", "agent", "skill_key", "iteration")
REQUIRED = ("expected", "name", "prompt", "timestamp")


def sample_cases(cases: DataFrame, most: int | None, seed: int = 0) -> DataFrame:
    """A uniform sample of ``most`` cases, with case_idx anew in sampled order; None, 0, or as many as there are: all, as they are."""
    if most is not None and most < 0:
        raise CaseValidationError(f"cannot sample {most} cases")
    if not most or cases.limit(most + 1).count() <= most:
        return cases
    few = cases.withColumn("_r", F.rand(seed)).orderBy("_r").limit(most)
    return few.withColumn("case_idx", F.row_number().over(Window.orderBy("_r")) - 1).drop("_r")


def expand(cases: DataFrame, samples: int) -> DataFrame:
    """One task for each case and iteration 1..samples; scripts and assertions that are empty become null."""
    if samples < 1:
        tasks = cases.withColumn("iteration", F.lit(1)).limit(0)
    else:
        tasks = cases.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    truthy = {c: F.nullif(F.col(c), F.lit("")) for c in ("setup", "teardown") if c in cases.columns}
    if "assertions" in cases.columns:
        truthy["assertions"] = F.when(F.size("assertions") > 0, F.col("assertions"))
    return tasks.withColumns(truthy | {"total_iterations": F.lit(samples)})


def with_cache(tasks: DataFrame, cache: DataFrame, keys: tuple[str, ...] = CACHE_KEYS, skip: bool = False) -> DataFrame:
    """Tasks with what the cache has of them, and ``cached``; under ``skip`` nothing is found."""
    found = cache.withColumn("cached", F.lit(True))
    if skip:
        found = found.limit(0)
    return tasks.join(found, list(keys), "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def not_cached(tasks: DataFrame, cache: DataFrame, keys: tuple[str, ...] = CACHE_KEYS, skip: bool = False) -> DataFrame:
    return tasks if skip else tasks.join(cache, list(keys), "left_anti")


def cacheable(results: DataFrame) -> DataFrame:
    """Results whose run did not fail for reasons of its surroundings."""
    return results.where(~F.coalesce("infra_failure", F.lit(False)))


def latest(results: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Of rows with equal keys the one of the greatest order."""
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def summary(results: DataFrame) -> DataFrame:
    """One row over all results: runs, passes, cached and fresh ones, and the pass rate in percent."""
    counted = results.agg(F.count("*").alias("total_runs"), F.count_if("passed").alias("total_pass"), F.count_if("cached").alias("cached_count"))
    return counted.select("total_runs", "total_pass", "cached_count", (F.col("total_runs") - F.col("cached_count")).alias("fresh_count"), pass_rate(F.col("total_pass"), F.col("total_runs")).alias("pass_rate"))


def case_totals(results: DataFrame) -> DataFrame:
    """One row: different cases, those with a failure, calls that were really made, and the score from 0 to 1. Runs are counted by case first, so no distinct set is built."""
    rows = results.groupBy("case_source").agg(F.count("*").alias("n"), F.count_if("passed").alias("c"), F.count_if(~F.col("cached")).alias("calls"))
    return rows.agg(F.count("*").alias("n_cases"), F.count_if(F.col("c") < F.col("n")).alias("n_failing"), F.sum("calls").alias("n_calls"), (F.sum("c") / F.sum("n")).alias("score"))


def per_case(results: DataFrame, k: int | Column) -> DataFrame:
    """Runs, passes, pass@k and pass^k of every case."""
    counted = results.groupBy("case_source").agg(F.count("*").alias("n"), F.count_if("passed").alias("c"))
    k = F.lit(k) if isinstance(k, int) else k
    return counted.select("case_source", k.cast("int").alias("k"), "n", "c", pass_at_k("n", "c", k).alias("pass_at_k"), pass_pow_k("n", "c", k).alias("pass_pow_k"))


def per_case_in_order(results: DataFrame, k: int | Column, order: str) -> DataFrame:
    """``per_case`` with ``case_order``: cases numbered from 0 by where each is first met."""
    return in_first_seen_order(per_case(results, k), results, "case_source", order, "case_order")


def script_counts(cases: DataFrame) -> DataFrame:
    """Scripts of each kind, as told before they are trusted."""
    return scripts(cases).groupBy("kind").agg(F.count("*").alias("n_scripts"), F.countDistinct("source").alias("n_cases"))


def failures(results: DataFrame) -> DataFrame:
    return results.where(~F.col("passed"))


def in_domains(rows: DataFrame, domains: list[str] | None) -> DataFrame:
    """Rows of these domains; without any given all, else rows without a domain go."""
    return rows if domains is None else rows.where(F.col("domain").isin(*domains))


def limit_per_category(rows: DataFrame, most: int, category: str = "category", order: str = "ord") -> DataFrame:
    """The first ``most`` rows of each category, in their order; Spark cuts each task's rows down before the shuffle."""
    place = Window.partitionBy(category).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most).drop("_n")


def missing_fields(keys: Column, required: tuple[str, ...] = REQUIRED) -> Column:
    """The required keys that are absent, sorted and joined by commas; empty if none."""
    return F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, required)), keys)), ", ")


def scripts(cases: DataFrame) -> DataFrame:
    """(source, kind, script) for every setup and teardown script that is not empty."""
    return cases.select("source", F.stack(F.lit(2), F.lit("setup"), F.col("setup"), F.lit("teardown"), F.col("teardown")).alias("kind", "script")).where("script <> ''")


def allowed_tools(tools: Column, has_skill: Column, default: list[str], skill_tool: str = "Skill") -> Column:
    """The tools a run may use: with a skill, its tool is put first or the defaults are taken; without, the list as given."""
    with_skill = F.when(tools.isNull(), F.array(*map(F.lit, default))).when(F.array_contains(tools, skill_tool), tools).otherwise(F.concat(F.array(F.lit(skill_tool)), tools))
    return F.when(has_skill, with_skill).otherwise(F.coalesce(tools, F.array().cast("array<string>")))


HASH_DIGITS = 12


def directory_hash(files: DataFrame, folder: str = "folder") -> DataFrame:
    """The first 12 hex digits of the sha256 over a folder's ``rel:content`` lines, in order of the parts of ``rel``: (folder, dir_hash).

    A digest is a chain over a folder's files, so one task reads a folder: sorted by Spark, which spills, and digested as it streams by. A task holds
    one batch of rows and one digest state, whatever the folder's size. Null names and contents are empty.
    """
    bounded_batches(files.sparkSession)
    rows = files.select(F.col(folder).alias("folder"), F.coalesce(F.col("rel"), F.lit("")).alias("rel"), F.coalesce(F.col("content"), F.lit("")).alias("content"))
    ordered = rows.repartition("folder").sortWithinPartitions("folder", F.split("rel", "/"), "content")
    kind = rows.schema["folder"].dataType

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, of = None, None

        def told(schema: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([of], schema), pa.array([state.hexdigest()[:HASH_DIGITS]])], ["folder", "dir_hash"])

        for batch in batches:
            own = batch.schema.field("folder").type
            for name, rel, content in zip(*(batch.column(c).to_pylist() for c in ("folder", "rel", "content"))):
                if state is None or name != of:
                    if state is not None:
                        yield told(own)
                    state, of = hashlib.sha256(), name
                else:
                    state.update(b"\n")
                state.update(rel.encode() + b":")
                state.update(content.encode())
        if state is not None:
            yield told(own)

    return ordered.mapInArrow(digest, T.StructType([T.StructField("folder", kind), T.StructField("dir_hash", T.StringType())])).withColumnRenamed("folder", folder)


def compare_runs(base: DataFrame, other: DataFrame) -> DataFrame:
    """Pass rates of two runs by case, side by side."""
    rate = lambda df, name: df.groupBy("case_source").agg(pass_rate(F.count_if("passed"), F.count("*")).alias(name))
    return rate(base, "base_rate").join(rate(other, "other_rate"), "case_source", "full").withColumn("delta", F.col("other_rate") - F.col("base_rate"))
