"""Pushes: sessions with their raw files, taken into a store together or not at all.

A raw file is staged in its batch before the tables are and counts with them, once the batch is committed; until then, whatever fails, readers see what was there before.
A push that fails removes what it staged; what one that died has left is `vacuum`'s. Files of sessions that were brought anew since are `collect_stale`'s.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, sinks
from ..schema import Tables, validated
from ..sources.jsonl import once
from .store import Store


@dataclass(frozen=True)
class Pushed:
    """The batch, None where nothing was to be taken in; sessions taken in, those that the store has already, and rejected ones (all columns, reason)."""

    batch: str | None
    taken: int
    skipped: int
    rejected: DataFrame


def raw_key(sessions: DataFrame) -> DataFrame:
    """(session_id, _uri, key): agent/year/month/id and the raw file's ending."""
    ending = F.regexp_extract("raw_uri", r"(\.[^./]+)$", 1)
    key = F.concat_ws("/", "agent", F.date_format("started_at", "yyyy/MM"), F.concat(F.col("id"), F.coalesce(ending, F.lit(""))))
    return sessions.select(F.col("id").alias("session_id"), F.col("raw_uri").alias("_uri"), key.alias("key"))


def _of(t: Tables, sessions: DataFrame) -> Tables:
    """The tables of some sessions."""
    ids = sessions.select(F.col("id").alias("session_id"))
    children = {f.name: getattr(t, f.name).join(ids, "session_id", "left_semi") for f in fields(t) if f.name in ("turns", "tools", "usage", "kinds")}
    devices = t.devices.join(sessions.select(F.col("device_id").alias("id")), "id", "left_semi")
    return Tables(sessions, devices=devices, **children)


def push(store: Store, t: Tables, files: DataFrame, now: datetime, overwrite: bool = False) -> Pushed:
    """Takes in sessions with their raw files (raw_uri, body) and notes when their devices were last seen.

    Sessions with a bad id or agent, and those whose raw file is missing or not of the size and hash that they claim, are rejected; those that the store has with the
    same hash are skipped, but with overwrite.
    """
    fit, odd = validated(t.sessions)
    sound, broken = filters.sound_raw(fit, files)
    rejected = odd.unionByName(broken)
    have = store.current("sessions").select("id", F.col("raw_hash").alias("_have"))
    known = once(sound.join(have, "id", "left").withColumn("_same", F.coalesce(F.col("_have") == F.col("raw_hash"), F.lit(False)) & F.lit(not overwrite)))
    new = known.where("not _same").select(*t.sessions.columns)
    counts = known.agg(F.count("*"), F.count_if("_same")).first()
    taken, skipped = counts[0] - counts[1], counts[1]
    if not taken:
        return Pushed(None, 0, skipped, rejected)
    batch = store.next_batch()
    try:
        bodies = files.select(F.col("raw_uri").alias("_uri"), F.col("body").cast("binary").alias("body"))
        store.write(batch, "raw", raw_key(new).join(bodies, "_uri").select("session_id", "key", "body"))
        store.write(batch, "synced", _due(store, new, now))
        store.append(_of(t, new), batch)
    except BaseException:
        store.discard(batch)
        raise
    return Pushed(batch, taken, skipped, rejected)


def last_syncs(store: Store) -> DataFrame:
    """(id, last_sync) of each device."""
    return store.table("synced").groupBy("id").agg(F.max("last_sync").alias("last_sync"))


def _due(store: Store, sessions: DataFrame, now: datetime) -> DataFrame:
    seen = sessions.select(F.col("device_id").alias("id")).where("id is not null").distinct()
    devices = seen.join(last_syncs(store), "id", "left")
    return sinks.touch_last_sync(devices, seen, now).where(F.col("last_sync") == F.lit(now))


def raw_files(store: Store) -> DataFrame:
    """(session_id, key, body): each session's raw file, as of the last state."""
    return store.current("raw").select("session_id", "key", "body")


def collect_stale(store: Store) -> list[str]:
    """Removes the raw files of batches of which no session is the store's last state any more; their ids. Run again, it finds nothing.

    What a batch shares with sessions that still are goes when `compact` writes the last state anew.
    """
    batches = store.batches()
    live = {r[0] for r in store.last_batches(batches).select("last").distinct().collect()}  # a name a batch
    stale = [b for b in batches if b not in live and store.has(b, "raw")]
    for b in stale:
        store.files.remove("raw", f"batch={b}")
    return stale
