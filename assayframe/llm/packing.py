"""Best-fit packing of token pieces into sequences, by hierarchical residual packing.

Documents become ids (plus an end id) in one pass; only those longer than a sequence are cut, into whole sequences
and a rest. Packing then handles pieces as (length, reference) rows: every partition packs its pieces by best fit,
longest first, and emits the bins that are nearly full. The underfull bins become items of the next round, where the
bins of ``FAN_IN`` neighbouring groups are packed by best fit again, up a tree to one group.

What a group hands on is small, and nothing more could be of use. After best fit at most one bin is half full or less,
as two would have been one. Bins that are fuller never fit together, so all that can still happen to them is to take in
bins half full or less of other groups. Each round brings at most ``FAN_IN`` of those to a group, and there are
fewer than ``ROUNDS`` rounds; so of its fuller bins a group hands on the ``FAN_IN * ROUNDS`` with most room, and emits
the others as they are. A first-round task packs ``RUN`` pieces at a time, each run being a group of its own.

Defined cases: a null or empty text is the end id alone; repeated rows and equal doc_ids are pieces of their own; an
empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm import _tokens
from assayframe.llm._shared import bounded_batches, give_back, written

CAPACITY, END_ID = 2048, 0
#: groups that meet in a round, rounds at most (8**21 groups), and pieces a task packs at a time
FAN_IN, ROUNDS, RUN = 8, 21, 200_000
#: pieces of texts whose ids a worker keeps
CACHE_PIECES = 1_000_000
#: a bin is nearly full if no more than capacity // SLACK ids are free
SLACK = 256
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BINS = "part bigint, number bigint, done boolean, used bigint, items array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokens.encoder(tokenizer, CACHE_PIECES)
        for batch in batches:
            ids, sizes = encoder.encode_all(batch.column("text"))
            ends, rows = np.concatenate([[0], np.cumsum(sizes)]), []
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                own = ids[a:b].astype("<u4") if end_id is None else np.append(ids[a:b].astype("<u4"), np.uint32(end_id))
                for piece, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append((doc_id, piece, at, len(part), zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ITEM)], [f.name for f in _ITEM])
        give_back()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first, each into the fullest bin that takes it."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, number, bins = capacity, bins, bins + 1
        where[i], offset[i] = number, capacity - room
        left = room - size
        if left:
            free[left].append(number)
            mask |= 1 << left
    return where, offset


def _bins(part: int, sizes: np.ndarray, ends: np.ndarray, items: pa.StructArray, capacity: int, last: bool) -> pa.RecordBatch:
    """Bins of the given things (pieces or bins), each of which stands for items[ends[i]:ends[i+1]]."""
    where, _ = best_fit(sizes, capacity)
    order = np.argsort(where, kind="stable")
    n = int(where.max()) + 1
    used = np.bincount(where, weights=sizes, minlength=n).astype(np.int64)
    counts = ends[1:] - ends[:-1]
    begin = np.repeat(ends[:-1][order] - np.concatenate([[0], np.cumsum(counts[order])[:-1]]), counts[order])
    taken = items.take(pa.array(begin + np.arange(len(begin))))
    held = np.concatenate([[0], np.cumsum(np.bincount(where, weights=counts, minlength=n).astype(np.int64))])
    done = (capacity - used <= capacity // SLACK) | last
    fuller = np.flatnonzero(~done & (2 * used > capacity))
    done[fuller[np.argsort(used[fuller], kind="stable")[FAN_IN * ROUNDS :]]] = True
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(n)), pa.array(done), pa.array(used), pa.ListArray.from_arrays(pa.array(held.astype(np.int32)), taken)],
        ["part", "number", "done", "used", "items"],
    )


def _merge(capacity: int, last: bool):
    """Packs the underfull bins of one group; the last group keeps none back."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        items = table.column("items").chunk(0)
        ends = items.offsets.to_numpy().astype(np.int64)
        return pa.Table.from_batches([_bins(int(table.column("part")[0].as_py()), table.column("used").to_numpy(), ends - ends[0], items.flatten(), capacity, last)])

    return merge


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (PIECES, each of length 1 to capacity) with sequence_id and offset; sequences have no gaps."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, run, held, size = TaskContext.get().partitionId(), 0, [], 0

        def pack_run() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            items = pa.StructArray.from_arrays([table.column(f.name).combine_chunks() if table.column(f.name).num_chunks != 1 else table.column(f.name).chunk(0) for f in _ITEM], fields=list(_ITEM))
            return _bins((part << 20) + run, table.column("length").to_numpy(), np.arange(len(table) + 1), items, capacity, False)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= RUN:
                yield pack_run()
                run, held, size = run + 1, [], 0
        if size:
            yield pack_run()
        give_back()

    rounds = [written(pieces.mapInArrow(local, _BINS), "bins")]
    parts, runs = rounds[0].agg(F.max(F.shiftright("part", 20)), F.max(F.col("part").bitwiseAND((1 << 20) - 1))).first()
    groups = ((parts or 0) + 1) * ((runs or 0) + 1)
    # groups are numbered without gaps between the runs of a task
    rounds[0] = rounds[0].withColumn("part", F.shiftright("part", 20) * ((runs or 0) + 1) + F.col("part").bitwiseAND((1 << 20) - 1))
    while groups > 1:
        groups = -(-groups // FAN_IN)
        under = rounds[-1].where("not done").withColumn("part", F.floor(F.col("part") / FAN_IN))
        rounds.append(written(under.groupBy("part").applyInArrow(_merge(capacity, groups == 1), _BINS), "bins"))
    out = None
    for level, bins in enumerate(rounds):
        kept = bins if level == len(rounds) - 1 else bins.where("done")
        # unique: the round, the group in it, the bin in that
        numbered = kept.select((F.lit(level).cast("bigint") * (1 << 58) + F.col("part") * (1 << 26) + F.col("number")).alias("sequence_id"), "items")
        out = numbered if out is None else out.unionAll(numbered)
    before = F.transform("items", lambda x, i: F.struct(x.alias("piece"), F.aggregate(F.slice("items", 1, i), F.lit(0).cast("bigint"), lambda s, y: s + y["length"]).alias("offset")))
    return out.select("sequence_id", F.inline(before)).select("piece.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """Columns of token_pieces with sequence_id and offset."""
    return pack(written(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
