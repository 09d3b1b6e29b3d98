"""The store of what is taken in: batches that count once they are committed, in buckets by session.

A batch is a folder `batch=<id>` in each table, and it is nothing until its entry stands in the log, one small file that appears by a rename. Readers
take the batches of the log alone: what a writer that died has left is never read, and `vacuum` removes it. Ids are a number and a random part:
writers at once have ids of their own, and both batches count. Of a session the rows of the last batch that brought it are read.

All tables of a store are dealt into the same number of buckets by session, so that a session's rows, whichever batches brought them, meet in the
task that decides which are the last: reading shuffles neither sessions nor turns. The buckets are known to Spark by external tables in the session's
catalog, named by the store's path; their partitions are batches that were committed.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DEVICES, KINDS, LEDGER, SESSIONS, TOOLS, TURNS, USAGE, Tables
from ..shared import shared_folder

#: Table, its columns, the column by which it is dealt.
SCHEMAS = {
    "sessions": (SESSIONS, "id"), "turns": (TURNS, "session_id"), "tools": (TOOLS, "session_id"), "usage": (USAGE, "session_id"), "kinds": (KINDS, "session_id"), "devices": (DEVICES, "id"), "ledger": (LEDGER, "session_id"),
    "fixes": ("id string, first_prompt string, of string", "id"),
    "raw": ("session_id string, key string, body binary", "session_id"), "synced": ("id string, last_sync timestamp", "id"),
    "postings": ("term string, session_id string, turn long, places array<int>, size int, of string", "term"), "sizes": ("session_id string, turns long, tokens long, of string", "session_id"),
}
ENTRY = "batch string, id string, raw_hash string"
BATCH = r"\d{12}-[0-9a-f]{8}"


@dataclass(frozen=True)
class Files:
    """The few acts on files that Spark's readers and writers don't offer, on whatever file system the path names."""

    spark: SparkSession
    path: str

    def at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))

    def system(self):
        return self.at().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def names(self, *parts: str) -> dict[str, int]:
        """{name: last changed, in milliseconds} of what stands in a folder; empty where there is no such folder."""
        fs, at = self.system(), self.at(*parts)
        return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(at)} if fs.exists(at) else {}

    def rename(self, source: tuple[str, ...], to: tuple[str, ...]) -> None:
        fs = self.system()
        fs.mkdirs(self.at(*to[:-1]))
        if not fs.rename(self.at(*source), self.at(*to)):
            raise OSError(f"{'/'.join(to)} is there already, or {'/'.join(source)} isn't")

    def remove(self, *parts: str) -> bool:
        return self.system().delete(self.at(*parts), True)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    top = shared_folder(spark)
    if top is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{top}/logloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


class Store:
    """A store at a path. buckets: of its tables, for a store that is written for the first time; more for more data, and it never changes."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        self._new_buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # -- log -------------------------------------------------------------------------------------

    def batches(self) -> list[str]:
        """The ids of committed batches, in their order; one name each reaches the driver, and `compact` makes them one."""
        return sorted(m[1] for n in self.files.names("log") if (m := re.fullmatch(rf"({BATCH})\.json", n)))

    def next_batch(self) -> str:
        """An id after those of all batches that are committed now, and of no other writer's."""
        last = self.batches()
        return f"{int(last[-1][:12]) + 1 if last else 0:012d}-{uuid.uuid4().hex[:8]}"

    def commit(self, batch: str, sessions: DataFrame | None = None) -> None:
        """From here on the batch counts, wholly. sessions (id, raw_hash): what `changes` tells of it, in one file, so for batches of a bounded size."""
        entry = self.spark.createDataFrame([(batch, None, None)], ENTRY)
        if sessions is not None:
            entry = entry.union(sessions.select(F.lit(batch), "id", "raw_hash"))
        entry.coalesce(1).write.json(f"{self.path}/log/.{batch}")
        part = next(n for n in self.files.names("log", f".{batch}") if n.startswith("part-"))
        self.files.rename(("log", f".{batch}", part), ("log", f"{batch}.json"))
        self.files.remove("log", f".{batch}")

    def changes(self) -> DataFrame:
        """A stream of (id, raw_hash, batch): sessions as their batches are committed."""
        self.files.system().mkdirs(self.files.at("log"))
        rows = self.spark.readStream.schema(ENTRY).option("pathGlobFilter", "*.json").json(f"{self.path}/log")
        return rows.where("id is not null").select("id", "raw_hash", "batch")

    # -- tables ----------------------------------------------------------------------------------

    def buckets(self) -> int:
        found = [int(m[1]) for n in self.files.names("buckets") if (m := re.fullmatch(r"(\d+)", n))]
        return min(found, default=self._new_buckets)  # two first writers that differ agree on the smaller, and the first batches are read by it

    def write(self, batch: str, name: str, rows: DataFrame) -> None:
        """One table of a batch, not yet committed."""
        columns, by = SCHEMAS[name]
        if not self.files.names("buckets"):
            self.files.system().mkdirs(self.files.at("buckets", str(self._new_buckets)))
        n = self.buckets()
        want = self.spark.createDataFrame([], columns).dtypes
        rows = rows.select(*[F.col(c).cast(k).alias(c) for c, k in want]).repartition(n, by)
        table = f"logloom_writes_{uuid.uuid4().hex}"  # of this act alone: what readers know has committed batches only
        # in the batch's own folder: writers at once would clear away each other's unfinished files in a common one
        rows.write.bucketBy(n, by).sortBy(by).option("path", f"{self.path}/{name}/batch={batch}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files are the store's and stay

    def table(self, name: str, batches: list[str] | None = None) -> DataFrame:
        """All committed rows of a table, those that later batches have replaced too, with their batch. batches: some of them."""
        batches = self.batches() if batches is None else batches
        columns, by = SCHEMAS[name]
        if not batches:
            return self.spark.createDataFrame([], f"{columns}, batch string")
        n = self.buckets()
        table = f"logloom_{hashlib.sha256(f'{self.path} {n}'.encode()).hexdigest()[:24]}_{name}"
        place = f"{self.path}/{name}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}, batch STRING) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({by}) INTO {n} BUCKETS LOCATION '{place}'")
        known = {r[0] for r in self.spark.sql(f"SHOW PARTITIONS {table}").collect()}
        there = self.files.names(name)  # a table of which a batch has no rows has no folder for it
        new = [b for b in batches if f"batch={b}" not in known and f"batch={b}" in there]
        if new:
            self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {' '.join(f"PARTITION (batch='{b}')" for b in new)}")
        return self.spark.table(table).where(F.col("batch").isin(batches))

    def last_batches(self, batches: list[str] | None = None) -> DataFrame:
        """(id, last): each session's last batch. Sessions are in buckets by id, so nothing is shuffled."""
        return self.table("sessions", batches).groupBy("id").agg(F.max("batch").alias("last"))

    def current(self, name: str, batches: list[str] | None = None) -> DataFrame:
        """A table's rows as of the last state, with their batch; first prompts as they were put right.

        No row of a session has a batch after its last, so `not before` is `of`; as an inequality it is no join key, and the buckets alone deal the rows.
        """
        batches = self.batches() if batches is None else batches
        rows, last = self.table(name, batches), self.last_batches(batches).withColumnRenamed("id", "_id")
        rows = rows.join(last, (F.col(SCHEMAS[name][1]) == F.col("_id")) & (F.col("batch") >= F.col("last")), "left_semi")
        if name != "sessions":
            return rows
        fixes = self.table("fixes", batches).groupBy("id", "of").agg(F.max_by("first_prompt", "batch").alias("_better")).withColumnRenamed("id", "_id")
        fixed = rows.join(fixes, (F.col("id") == F.col("_id")) & (F.col("of") >= F.col("batch")) & (F.col("of") <= F.col("batch")), "left")
        return fixed.withColumn("first_prompt", F.coalesce("_better", "first_prompt")).select(*rows.columns)

    def read(self) -> Tables:
        """The store as of its last state. Orchestrators follow from the parents of all sessions, whatever the order in which they came."""
        batches = self.batches()  # once: all tables are of one state
        parts = {n: self.current(n, batches).drop("batch") for n in ("sessions", "turns", "tools", "usage", "kinds")}
        parents = parts["sessions"].select(F.col("parent_session_id").alias("id")).where("id is not null")
        orchestrators = parts["sessions"].select("id").join(parents, "id", "left_semi").select(F.col("id").alias("session_id"), F.lit("orchestrator").alias("kind"))
        parts["kinds"] = parts["kinds"].where("kind <> 'orchestrator'").union(orchestrators)
        named = self.table("devices", batches).groupBy("id").agg(F.max_by("friendly_name", F.when(F.col("friendly_name") != "", F.col("batch"))).alias("friendly_name"))
        return Tables(devices=named, ledger=self.table("ledger", batches).drop("batch"), **parts)

    def append(self, t: Tables, batch: str | None = None, ledger: DataFrame | None = None, tell: bool = True) -> str:
        """A batch of tables, committed when all of them are written; its id. ledger: what of it is known by content, also of files that gave no session.

        tell: `changes` names the batch's sessions, which one task then writes; False for batches of any size that change no session.
        """
        batch = batch or self.next_batch()
        for name in ("sessions", "turns", "tools", "usage", "kinds", "devices"):
            self.write(batch, name, getattr(t, name))
        self.write(batch, "ledger", ledger if ledger is not None else self.spark.createDataFrame([], LEDGER))
        self.commit(batch, self.table_of(batch, "sessions").select("id", "raw_hash") if tell else None)
        return batch

    def has(self, batch: str, name: str) -> bool:
        """Whether a batch has rows of a table; a table of no rows leaves a mark of success alone."""
        return any(n.startswith("part-") for n in self.files.names(name, f"batch={batch}"))

    def table_of(self, batch: str, name: str) -> DataFrame:
        """A table of a batch that is not committed yet, as written."""
        columns, _ = SCHEMAS[name]
        if f"batch={batch}" not in self.files.names(name):
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(f"{self.path}/{name}/batch={batch}")

    def discard(self, batch: str) -> None:
        """Removes what a batch that is not committed has left."""
        if batch in self.batches():
            raise ValueError(f"{batch} is committed")
        for name in SCHEMAS:
            self.files.remove(name, f"batch={batch}")
        self.files.remove("log", f".{batch}")

    def vacuum(self, hours: float = 24, now: Callable[[], float] | None = None) -> list[str]:
        """Removes what batches that were never committed have left, if it is older than so many hours: a writer may be at work on younger ones. Their ids."""
        import time

        done, before = set(self.batches()), ((now or time.time)() - hours * 3600) * 1000
        gone = set()
        for name in SCHEMAS:
            for n, changed in self.files.names(name).items():
                if (m := re.fullmatch(rf"batch=({BATCH})", n)) and m[1] not in done and changed <= before and self.files.remove(name, n):
                    gone.add(m[1])
        for n, changed in self.files.names("log").items():
            if re.fullmatch(rf"\.{BATCH}", n) and changed <= before:
                self.files.remove("log", n)
        return sorted(gone)
