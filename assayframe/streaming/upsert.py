"""A table of the latest row of each key, kept by a stream.

A micro-batch replaces rows by key: it is cut to the latest row of each key, the buckets that its keys lie in are read and written anew, and a manifest
``<path>/manifest/<batch>.json`` then names the folder of every bucket. Creating the manifest is the commit, so readers see a batch whole or not at
all. A batch that was committed is skipped when Spark replays it; one that ended before its commit is done again into a folder of its own. What is
read and written is in proportion to the buckets a batch touches; nothing is kept in Spark's state or in the driver but the manifest, of one entry a bucket.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


@dataclass
class UpsertTable:
    """Rows of ``schema`` by ``keys``, of which the one with the greatest ``order`` counts."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    order: str
    schema: str
    buckets: int = BUCKETS

    def __post_init__(self) -> None:
        self.path = self.path.rstrip("/")
        self._file = self.spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        where = self._file(f"{self.path}/manifest")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where) if s.getLen()]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self) -> dict[str, str]:
        """Folder of each bucket that has rows."""
        done = self._manifests()
        if not done:
            return {}
        source = self._fs.open(self._file(f"{self.path}/manifest/{done[-1]}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)))
        finally:
            source.close()

    def _rows(self, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All rows as of the last committed batch."""
        return self._rows(sorted(self._manifest().values()))

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), self.order).alias("_r")).select(*self.keys, "_r.*")

    def upsert(self, batch: DataFrame, batch_id: int) -> bool:
        """Replace rows by those of a batch; False if that batch is in already. Meant for ``foreachBatch``."""
        done = self._manifests()
        if done and batch_id <= done[-1]:
            return False
        names = self.spark.createDataFrame([], self.schema).columns
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")
        fresh = self._latest(batch.select(*names)).persist()  # as small as the batch
        manifest = self._manifest()
        try:
            touched = [r["bucket"] for r in fresh.select(bucket).distinct().collect()]
            folder = f"data/{batch_id}-{uuid.uuid4().hex}"
            if touched:
                old = self._rows([manifest[str(b)] for b in touched if str(b) in manifest])
                merged = self._latest(old.unionByName(fresh)).select(*names, bucket)
                merged.repartition(min(len(touched), self.buckets), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        finally:
            fresh.unpersist()
        self._commit(batch_id, manifest | {str(b): f"{folder}/bucket={b}" for b in touched})
        return True

    def _commit(self, batch_id: int, manifest: dict[str, str]) -> None:
        """Write aside, then rename: a manifest is there whole or not at all."""
        new = self._file(f"{self.path}/manifest/.{batch_id}.new")
        out = self._fs.create(new, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if not self._fs.rename(new, self._file(f"{self.path}/manifest/{batch_id}.json")):
            raise RuntimeError(f"batch {batch_id} of {self.path} was committed by another writer")

    def vacuum(self) -> None:
        """Delete folders that the last manifest does not name, and manifests before it."""
        done, live = self._manifests(), set(self._manifest().values())
        for old in done[:-1]:
            self._fs.delete(self._file(f"{self.path}/manifest/{old}.json"), False)
        data = self._file(f"{self.path}/data")
        for batch in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = f"data/{batch.getPath().getName()}"
            buckets = [s.getPath() for s in self._fs.listStatus(batch.getPath()) if s.isDirectory()]
            dead = [b for b in buckets if f"{name}/{b.getName()}" not in live]
            for b in dead if len(dead) < len(buckets) else [batch.getPath()]:
                self._fs.delete(b, True)
