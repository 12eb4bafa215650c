"""Counters of fixed number over any number of rows: tasks count in arrays, whose slices are added up in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BITS = 14
#: parts that sums are combined in
PARTS = 256
#: tasks that arrays of numbers are added up in, before one task adds up theirs
ADDERS = 8
FIELDS = (("part", pa.int32()), ("slice", pa.int32()), ("counts", pa.binary()))
SCHEMA = "part int, slice int, counts binary"


def _packed(counts: np.ndarray) -> bytes:
    """Counters in the fewest bytes that hold them."""
    return counts.astype(np.min_scalar_type(counts.max())).tobytes()


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, f"u{len(counts) >> SLICE_BITS}").astype(np.uint64)


def columns(counts: np.ndarray) -> list[pa.Array]:
    """The columns of SCHEMA for this task's counters: its slices that are not empty."""
    from pyspark import TaskContext

    own = [(i, _packed(s)) for i, s in enumerate(counts.reshape(-1, 1 << SLICE_BITS)) if s.any()]
    part = TaskContext.get().partitionId()
    return [pa.array([part] * len(own), pa.int32()), pa.array([i for i, _ in own], pa.int32()), pa.array([b for _, b in own], pa.binary())]


def total(sums: DataFrame, n: int) -> np.ndarray:
    """The sum of all tasks' n counters."""

    def add(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << SLICE_BITS, np.uint64)
        for b in table.column("counts"):
            out += _unpacked(b.as_py())
        first = table.slice(0, 1)
        return pa.table({"part": first.column("part"), "slice": first.column("slice"), "counts": pa.array([_packed(out)], pa.binary())})

    parts = (sums.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // PARTS)
        sums = sums.withColumn("part", F.floor(F.col("part") / PARTS).cast("int")).groupBy("slice", "part").applyInArrow(add, SCHEMA)
    out = np.zeros(n, np.uint64)
    for row in sums.collect():  # at most n counters, whatever the input
        out[row["slice"] << SLICE_BITS : (row["slice"] + 1) << SLICE_BITS] = _unpacked(row["counts"])
    return out


def floats(arrays: list[np.ndarray]) -> pa.RecordBatch:
    """This task's arrays of numbers, as a batch of SCHEMA; the slice is the array's place in the list."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([part] * len(arrays), pa.int32()), pa.array(range(len(arrays)), pa.int32()), pa.array([a.astype(np.float64).tobytes() for a in arrays], pa.binary())], [f for f, _ in FIELDS])


def total_floats(sums: DataFrame, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """The sums over all tasks of the arrays that ``floats`` gave."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, own in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                own = np.frombuffer(own.as_py())
                out[at] = out[at] + own if at in out else own
        if out:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(out), pa.int32()), pa.array(list(out), pa.int32()), pa.array([a.tobytes() for a in out.values()], pa.binary())], [f for f, _ in FIELDS])

    # dealt out without a key: as many tasks as are needed, however many partitions a shuffle has
    for n in (ADDERS, 1):
        sums = sums.repartition(n).mapInArrow(add, SCHEMA)
    out = [np.zeros(s) for s in shapes]
    for row in sums.collect():
        out[row["slice"]] = np.frombuffer(row["counts"]).reshape(shapes[row["slice"]])
    return out
