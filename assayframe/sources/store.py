"""A store of results that a lookup joins without moving it.

Entries lie in ``<path>/v<N>`` as a bucketed Parquet table: folders by set, agent and skill, and in each the rows in BUCKETS buckets by case and
iteration. A lookup names its set, agent and skill, so only those folders are read, and joins by case and iteration, which the buckets are dealt by: no
exchange of what is stored, whatever its size. ``<path>/CURRENT`` names the version that counts.

Writes go through a journal. ``record`` writes a run's results to ``<path>/pending/<token>`` first and then appends them under that token, which
stays with each row; an append under a token that is in the table, whole or in part, adds only what is missing, so it may be repeated. ``recover``
appends what an interrupted process had recorded: what was run is never run again because of a crash. One process writes to a store at a time.

Of entries of one key the latest counts. Entries older than the lifetime are not found, and ``compact`` leaves them out, as it does replaced ones; it writes
the next version beside the old one and then names it, so readers see either.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.operators.samples import CACHE_KEYS, cacheable

PARTITIONS = ("set_name", "agent", "skill_key")
KEYS = ("case_key", "iteration")
PAYLOAD = "response string, tool_calls array<struct<name:string,input:string>>, judgment struct<pass:boolean,reasoning:string>"
SCHEMA = f"case_key string, iteration int, {PAYLOAD}, stored_at timestamp, token string, set_name string, agent string, skill_key string"
_PAYLOAD = ("response", "tool_calls", "judgment")
LIFETIME = timedelta(days=36_500)
BUCKETS = 32


def coded(rows: DataFrame) -> DataFrame:
    """rows with the columns that name folders as folders can be named: an empty name would be read back as none."""
    return rows.withColumns({c: F.concat(F.lit("="), F.coalesce(c, F.lit(""))) for c in PARTITIONS})


@dataclass
class ResultStore:
    """A store in a folder that driver and executors share."""

    spark: SparkSession
    path: str
    lifetime: timedelta = LIFETIME
    buckets: int = BUCKETS

    def __post_init__(self) -> None:
        self.path = self.path.rstrip("/")
        jvm = self.spark._jvm
        self._file = jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._opened: tuple[int, str] | None = None
        self._names: list[str] = []
        if self._pointer() is None:
            self._point({"version": 0, "buckets": self.buckets})
        self.buckets = self._pointer()["buckets"]
        self.recover()

    # the pointer to the version that counts

    def _pointer(self) -> dict | None:
        for name in ("CURRENT", "CURRENT.new"):  # the second only if a process ended between the two steps of _point
            where = self._file(f"{self.path}/{name}")
            if self._fs.exists(where):
                size = self._fs.getFileStatus(where).getLen()
                source = self._fs.open(where)
                try:
                    data = self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)
                finally:
                    source.close()
                if size:
                    return json.loads(bytes(data))
        return None

    def _point(self, what: dict) -> None:
        new, old = self._file(f"{self.path}/CURRENT.new"), self._file(f"{self.path}/CURRENT")
        out = self._fs.create(new, True)
        try:
            out.write(bytearray(json.dumps(what).encode()))
        finally:
            out.close()
        if self._fs.exists(old):
            self._fs.delete(old, False)
        self._fs.rename(new, old)

    # the table

    def _table(self, version: int | None = None) -> str:
        """The name of a catalog entry for a version of the store; made anew in each session."""
        version = self._pointer()["version"] if version is None else version
        if self._opened is None or self._opened[0] != version:
            name = f"results_{uuid.uuid4().hex}"
            self._fs.mkdirs(self._file(f"{self.path}/v{version}"))
            self.spark.sql(
                f"CREATE TABLE {name} ({SCHEMA}) USING parquet PARTITIONED BY ({', '.join(PARTITIONS)}) CLUSTERED BY ({', '.join(KEYS)}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/v{version}'"
            )
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
            self._opened = (version, name)
            self._names.append(name)
        return self._opened[1]

    def close(self) -> None:
        """Take the store's entries out of the session's catalog; its files stay, and it is opened again when it is used."""
        while self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop()}")
        self._opened = None

    def _append(self, rows: DataFrame, table: str) -> None:
        names = self.spark.table(table).columns
        dealt = rows.repartition(self.buckets, *KEYS).select(*names)  # as the buckets are: one file for each
        dealt.write.mode("append").insertInto(table)

    def entries(self, set_name: str, agent: str, skill_key: str) -> DataFrame:
        """(case_key, iteration, response, tool_calls, judgment): the latest living entry of each key of one set, agent and skill."""
        rows = self.spark.table(self._table()).where((F.col("set_name") == f"={set_name}") & (F.col("agent") == f"={agent}") & (F.col("skill_key") == f"={skill_key}"))
        living = rows.where(F.col("stored_at") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(self.lifetime.total_seconds()).cast("decimal(18,6)")))
        newest = F.max_by(F.struct(*_PAYLOAD), F.struct("stored_at", "token")).alias("r")
        return living.groupBy(*KEYS).agg(newest).select(*KEYS, "r.*")

    def look_up(self, tasks: DataFrame, set_name: str, agent: str, skill_key: str) -> DataFrame:
        """tasks (case_key, iteration, ...) with what is stored of them, and ``cached``."""
        return tasks.join(self.entries(set_name, agent, skill_key).withColumn("cached", F.lit(True)), list(KEYS), "left").withColumn("cached", F.coalesce("cached", F.lit(False)))

    # writing

    def record(self, results: DataFrame, token: str | None = None) -> str:
        """Store those of ``results`` (CACHE_KEYS, payload, infra_failure) whose surroundings did not fail; gives the token of the write."""
        token = token or uuid.uuid4().hex
        pending = f"{self.path}/pending/{token}"
        if not self._fs.exists(self._file(f"{pending}/_SUCCESS")):
            kept = coded(cacheable(results).select(*CACHE_KEYS, *_PAYLOAD)).withColumns({"stored_at": F.current_timestamp(), "token": F.lit(token)})
            kept.write.mode("overwrite").parquet(pending)
        self._settle(token)
        return token

    def _settle(self, token: str) -> None:
        """Move a journal entry into the table. Rows of it that an interrupted append had put there are not added again."""
        pending, table = f"{self.path}/pending/{token}", self._table()
        rows = self.spark.read.parquet(pending)
        self.spark.sql(f"MSCK REPAIR TABLE {table}")
        self.spark.catalog.refreshTable(table)
        there = self.spark.table(table).where(F.col("token") == token).select(*CACHE_KEYS)
        self._append(rows.join(there, list(CACHE_KEYS), "left_anti"), table)
        self._fs.delete(self._file(pending), True)

    def recover(self) -> int:
        """Settle what an interrupted process had recorded whole; what it had not is dropped. Gives how many writes were settled."""
        where, settled = self._file(f"{self.path}/pending"), 0
        if not self._fs.exists(where):
            return 0
        for status in self._fs.listStatus(where):
            token = status.getPath().getName()
            if self._fs.exists(self._file(f"{self.path}/pending/{token}/_SUCCESS")):
                self._settle(token)
                settled += 1
            else:
                self._fs.delete(status.getPath(), True)
        return settled

    def compact(self) -> None:
        """Write the living latest entries as the next version, one file for each bucket and folder, and drop the version before."""
        old = self._pointer()["version"]
        rows = self.spark.table(self._table(old))
        living = rows.where(F.col("stored_at") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(self.lifetime.total_seconds()).cast("decimal(18,6)")))
        newest = F.max_by(F.struct(*_PAYLOAD, "stored_at", "token"), F.struct("stored_at", "token")).alias("r")
        kept = living.groupBy(*CACHE_KEYS).agg(newest).select(*CACHE_KEYS, "r.*")
        self._fs.delete(self._file(f"{self.path}/v{old + 1}"), True)  # of a compaction that did not end
        self._append(kept, self._table(old + 1))
        self._point({"version": old + 1, "buckets": self.buckets})
        self._fs.delete(self._file(f"{self.path}/v{old}"), True)
