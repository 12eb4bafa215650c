"""One running number over all rows of a table, without bringing them into one task.

Rows are dealt by ranges of their order, sorted in each part, and numbered there; a part's rows start after those of the parts before, whose sizes
are all that is counted. The dealt keys are checkpointed, for a second sample of the ranges could cut them elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.shared import kept

#: Spark's row ids have a part's number above this bit and the row's place in it below
_PLACE_BITS = 33


def numbered(rows: DataFrame, *order: str | Column, name: str = "number", first: int = 0, parts: int | None = None) -> DataFrame:
    """rows with ``name``: first, first + 1, ... by ``order``. Rows of equal order have numbers in any order, the same however often they are read."""
    dealt = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    placed = kept(dealt.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _PLACE_BITS)
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one for each part
    starts, total = [], first
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    inside = F.col("_place") - F.shiftleft(part, _PLACE_BITS)
    start = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts or [first]]), part.cast("int") + 1)
    return placed.withColumn(name, start + inside).drop("_place")


def in_first_seen_order(grouped: DataFrame, rows: DataFrame, key: str, order: str | Column, name: str = "number") -> DataFrame:
    """One row for each key, numbered by where the key first stands in ``rows``."""
    seen = rows.groupBy(key).agg(F.min(F.col(order) if isinstance(order, str) else order).alias("_seen"))
    return numbered(grouped.join(seen, key), "_seen", key, name=name).drop("_seen")
