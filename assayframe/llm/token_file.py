"""Token-id files: whole texts as ids in checksummed, independently coded blocks, and their reader.

``write_ids`` orders documents by doc_id across range partitions and each task turns its run of documents into blocks
of about ``id_coder.BLOCK_IDS`` ids, which end at document boundaries. A file is a Parquet table with one row for
each block (part, block, n_docs, n_ids, payload), so Spark's committer makes writing safe against lost tasks and any
task can decode any block by itself. A payload is: ``TID1``, the sizes of its two parts, the compressed table of
documents (null flag, doc_id, ids of each), the coded ids (see id_coder), and a crc32 of all that.

Defined cases: a null or empty text is the end id alone; a null doc_id sorts first and is read back as null; rows with
equal doc_id are ordered by a hash of the text and stay rows of their own; no row gives a table without blocks;
other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayframe.llm import _tokens, id_coder
from assayframe.llm._shared import bounded_batches, give_back

BLOCKS = "part int, block int, n_docs bigint, n_ids bigint, payload binary"
END_ID = 1


def pack_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, n_ids: int) -> bytes:
    null = np.array([d is None for d in doc_ids], np.uint8)
    table = null.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes()
    docs, coded = zlib.compress(table, 6), id_coder.encode(ids, n_ids)
    body = b"TID1" + struct.pack("<QQQ", len(doc_ids), len(docs), len(coded)) + docs + coded
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_block(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and all ids of a block; ValueError if it is damaged."""
    if payload[:4] != b"TID1" or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("damaged block of documents")
    n, n_docs, n_coded = struct.unpack_from("<QQQ", payload, 4)
    table = zlib.decompress(payload[28 : 28 + n_docs])
    null = np.frombuffer(table, np.uint8, n)
    doc_ids = np.frombuffer(table, "<i8", n, n)
    lengths = np.frombuffer(table, "<i8", n, 9 * n)
    ids = id_coder.decode(payload[28 + n_docs : 28 + n_docs + n_coded])
    return [None if x else int(d) for x, d in zip(null, doc_ids)], lengths, ids


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID) -> None:
    """Write doc_id and text of docs to a token-id file, in ascending order of doc_id."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, block = _tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([] if end_id is None else [end_id], encoder.kind)
        n_ids = max(encoder.n_ids, (end_id or 0) + 1)
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        size = 0

        def row() -> pa.RecordBatch:
            payload = pack_block(doc_ids, lengths, np.concatenate(held), n_ids)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "n_docs": [len(doc_ids)], "n_ids": [size], "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            found, counts = encoder.encode_all(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), np.split(found, np.cumsum(counts)[:-1])):
                held += [ids, end]
                doc_ids.append(doc_id)
                lengths.append(len(ids) + len(end))
                size += lengths[-1]
                if size >= id_coder.BLOCK_IDS:
                    yield row()
                    held, doc_ids, lengths, size, block = [], [], [], 0, block + 1
        if doc_ids:
            yield row()
        give_back()

    bounded_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as uint32) and, if wanted, ids."""
    table = spark.read.schema(BLOCKS).parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("part_start"))
    starts = (
        table.select("part", "block", "n_ids")
        .withColumn("n", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(parts, "part")
        .select("part", "block", (F.col("part_start") + F.col("n")).alias("block_start"))
    )
    kind = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column("block_start").to_pylist(), batch.column("payload")):
                doc_ids, lengths, ids = unpack_block(payload.as_py())
                ends = np.concatenate([[0], np.cumsum(lengths)])
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                out = {"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start + ends[:-1]), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(wide.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    # a payload is a few megabytes, one row of a batch at a time
    return table.select("part", "block", "payload").join(starts, ["part", "block"]).select("block_start", "payload").mapInArrow(documents, kind)
