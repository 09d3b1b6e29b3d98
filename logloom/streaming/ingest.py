"""Incremental ingest: a folder of histories is watched, what is new or changed is read, appended to a store, and read back as of its last state.

The store only grows: a batch costs what it brings and not what is stored (see `store`). What was taken in is known by content, in the ledger, which is
committed with its batch: a batch that is run again after a failure finds what is still to do, and does it once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters
from ..schema import Tables
from ..sources.histories import HistorySource
from ..sources.jsonl import once
from .store import Store

#: The version of what importers make of a file; a higher one has every file read again.
PROJECTION_VERSION = 1
Importer = Callable[[SparkSession, list[str]], Tables]


def _ledger(files: DataFrame, version: int) -> DataFrame:
    """files (file, raw_hash) as seen, whether or not they gave a session: what is skipped by rule is not read again."""
    return files.select(F.col("file").alias("session_id"), "raw_hash", F.lit(version).alias("projection_version"))


def append_ledger(files: DataFrame, path: str, version: int = PROJECTION_VERSION) -> str:
    """A batch of files (file, raw_hash) that are known and gave nothing: what is skipped by rule is not read again."""
    s = Store(files.sparkSession, path)
    batch = s.next_batch()
    s.write(batch, "ledger", _ledger(files, version))
    s.commit(batch)
    return batch


def append(t: Tables, path: str) -> str:
    """The tables as a batch of the store; its id. It counts wholly, or not at all where the writer died before its end."""
    return Store(t.sessions.sparkSession, path).append(t, ledger=t.ledger)


def read(spark: SparkSession, path: str) -> Tables:
    """The store as of its last state."""
    return Store(spark, path).read()


def unseen(files: DataFrame, path: str, version: int = PROJECTION_VERSION) -> DataFrame:
    """files (file, raw_hash) whose content the store hasn't seen in this version or a later one."""
    seen = Store(files.sparkSession, path).table("ledger").where(F.col("projection_version") >= version)
    return files.join(seen.select(F.col("session_id").alias("file"), "raw_hash"), ["file", "raw_hash"], "left_anti")


def compact(spark: SparkSession, path: str, to: str, buckets: int | None = None) -> None:
    """The last state of a store as the one batch of a new one, dealt anew where buckets are given; readers of the old one are not disturbed."""
    old = Store(spark, path)
    t = old.read()
    Store(spark, to, buckets or old.buckets()).append(t, ledger=t.ledger.distinct(), tell=False)


def watch(spark: SparkSession, path: str, state: str, glob: str = "*.jsonl", files_at_once: int = 1000) -> DataFrame:
    """A stream of (file, size, raw_hash) of the files under path, each time that one is new, has grown or has changed.

    state: a folder of this stream's own that outlives it, as its checkpoint does.
    """
    spark.dataSource.register(HistorySource)
    return spark.readStream.format(HistorySource.name()).options(path=path, glob=glob, state=state, files=str(files_at_once)).load()


def take_in(batch: DataFrame, store: str, importer: Importer) -> int:
    """Files (file, raw_hash) into the store, those that it hasn't seen, as one batch; their number. What reaches the driver are the names of one batch's files."""
    to = Store(batch.sparkSession, store)
    number = to.next_batch()  # before anything is read: of two writers the one that began later has the last word
    new = once(unseen(batch.select("file", "raw_hash"), store).distinct())
    names = [r["file"] for r in new.select("file").distinct().collect()]
    if names:
        to.append(importer(batch.sparkSession, names), number, _ledger(new, PROJECTION_VERSION))
    return len(names)


def in_parts(files: DataFrame, files_at_once: int):
    """files, so many at a time; each part is of those whose names' hashes fall together."""
    parts = max(1, -(-files.count() // files_at_once))
    part = F.pmod(F.xxhash64("file"), F.lit(parts))
    return (files.where(part == k) for k in range(parts))


def start(stream: DataFrame, store: str, importer: Importer, checkpoint: str, once: bool = True, files_at_once: int = 1000, passes: bool = False):
    """The running query. once: takes in what is there and ends. A batch of the stream becomes a batch of the store for each files_at_once files."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: sweep(df.sparkSession, df, store, importer, files_at_once, passes) and None)
    return (w.trigger(availableNow=True) if once else w).start()


def changes(spark: SparkSession, store: str) -> DataFrame:
    """A stream of (id, raw_hash, batch): sessions as they are added or changed, when their batch is committed."""
    return Store(spark, store).changes()


def run_passes(spark: SparkSession, store: str) -> int:
    """What is put right once a sweep is over: first prompts that are injected messages, of sessions that came since the last pass alone; their number.

    A batch of its own has the corrections, each of the state of the session that it was made of: a session that is brought anew is looked at anew. Batches that
    were looked at are marked after that, so a pass that died is run again, to the same effect. Orchestrators follow from all parents on each reading.
    """
    s = Store(spark, store)
    batches, seen = s.batches(), set(s.files.names("passes"))
    new = [b for b in batches if b not in seen]
    n = 0
    if new:
        came = {name: s.current(name, batches).where(F.col("batch").isin(new)) for name in ("sessions", "turns")}
        sessions = once(came["sessions"].where(filters.starts_as_boilerplate(F.col("first_prompt"))))
        if sessions.limit(1).count():
            none = spark.createDataFrame([], "session_id string")
            clean = filters.denoised(Tables(sessions, came["turns"].drop("batch"), none, none, none, none)).select("id", F.col("first_prompt").alias("_new"))
            better = sessions.join(clean, "id").where("_new <> first_prompt").select("id", F.col("_new").alias("first_prompt"), F.col("batch").alias("of"))
            batch = s.next_batch()
            s.write(batch, "fixes", better)
            n = s.table_of(batch, "fixes").count()
            if n:
                s.commit(batch)
                new.append(batch)
    for b in new:
        s.files.system().mkdirs(s.files.at("passes", b))
    return n


def sweep(spark: SparkSession, files: DataFrame, store: str, importer: Importer, files_at_once: int = 1000, passes: bool = False) -> int:
    """Takes in all of files (file, raw_hash) that the store hasn't seen, so many at a time; their number. passes: then `run_passes`."""
    # files are hashed and held against the ledger once; each batch then takes its part of what is left
    todo = once(unseen(files.select("file", "raw_hash"), store).distinct())
    done = sum(take_in(part, store, importer) for part in in_parts(todo, files_at_once))
    if passes:
        run_passes(spark, store)
    return done


def tallies(files: DataFrame, store: str, read: Tables | None = None) -> DataFrame:
    """(outcome, files) of files (file, raw_hash): 'unchanged' are in the ledger, and of the others 'imported' gave a session of `read` and 'skipped' none."""
    new = unseen(files, store).select("file", F.lit(True).alias("_new"))
    rows = files.select("file").join(new, "file", "left")
    got = (read.sessions.select(F.col("raw_uri").alias("file"), F.lit(True).alias("_got")) if read is not None else rows.limit(0).select("file", F.lit(True).alias("_got"))).distinct()
    outcome = F.when(F.col("_new").isNull(), "unchanged").when(F.col("_got").isNotNull(), "imported").otherwise("skipped")
    return rows.join(got, "file", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("files"))
