"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm._shared import written

#: parts that the rows of one key are dealt to when they look up what it has
SALTS = 8


def looked_up(rows: DataFrame, table: DataFrame, key: str, by: str | Column, how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row for each key; rows of a frequent key go to SALTS tasks by the hash of ``by``."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [key, "_salt"], how).drop("_salt")


def connected_components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (id, component): the smallest id reachable, for every id that has a link.

    Each round takes the smallest label among a node and its neighbours and then follows labels to labels, so paths
    shrink by halves. Labels are written out after each round; a node with very many links only adds rows to a
    grouped minimum, which is combined before the shuffle, and a label that very many nodes have is looked up in parts.
    """
    both = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).select(F.col("a").alias("id"), "component"), "labels")
    while True:
        near = looked_up(both, labels.withColumnRenamed("id", "b"), "b", "a").groupBy("a").agg(F.min("component").alias("near"))
        step = written(labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", "component", F.least("component", "near").alias("lower")), "step")
        over = step.select("lower").distinct().join(labels.select(F.col("id").alias("lower"), F.col("component").alias("over")), "lower")
        new = written(looked_up(step, over, "lower", "id", "left").select("id", F.col("component").alias("old"), F.least("lower", "over").alias("component")), "labels")
        labels = new.select("id", "component")
        if not new.where("old <> component").limit(1).count():
            return labels
