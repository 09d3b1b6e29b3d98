"""Hermes: transcripts <id>.jsonl, snapshots session_<id>.json and the sessions of state.db.

A state.db is one file and read by one task, as its store is one machine's; its rows go on as messages like those of the
transcripts. A session of a state.db yields to a transcript of its own that holds more messages than it claims to have.
"""

from __future__ import annotations

import json
from contextlib import closing

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import Tables
from .jsonl import _content_text, assemble, files, first, get, joined, lines, said, stamp

_DB = "file string, id string, parent string, model string, start string, claimed long, raw_hash string, raw_size long, line int, body string"
_COLUMNS = ("role", "content", "timestamp", "model", "tool_calls", "token_count")


def _rows(con, table: str, wanted: tuple[str, ...], order: str) -> list[dict]:
    """The wanted columns that the table has."""
    have = [r[1] for r in con.execute(f"PRAGMA table_info({table})")]
    cols = [c for c in wanted if c in have]
    if not cols:
        return []
    by = ", ".join(c for c in order.split(", ") if c in have) or "rowid"
    return [dict(zip(cols, r, strict=True)) for r in con.execute(f"SELECT {', '.join(cols)} FROM {table} ORDER BY {by}")]


def _message(row: dict) -> str:
    m = {c: row.get(c) for c in _COLUMNS if row.get(c) is not None}
    if isinstance(m.get("tool_calls"), str):
        try:
            m["tool_calls"] = json.loads(m["tool_calls"])
        except ValueError:
            del m["tool_calls"]
    return json.dumps({k: v.decode("utf-8", "replace") if isinstance(v, bytes) else v for k, v in m.items()})


def _databases(batches):
    import hashlib
    import sqlite3

    from .sqlite import opened

    for pdf in batches:
        for path, data in zip(pdf["file"], pdf["content"], strict=True):
            out = []
            try:
                with closing(opened(bytes(data))) as con:
                    heads = _rows(con, "sessions", ("id", "parent_session_id", "model", "started_at", "message_count"), "started_at, id")
                    said_ = _rows(con, "messages", ("session_id", *_COLUMNS), "timestamp, id")
            except sqlite3.DatabaseError:  # no database: nothing to read, as with a line that is no JSON
                continue
            by: dict = {}
            for m in said_:
                by.setdefault(m.get("session_id"), []).append(_message(m))
            for h in heads:
                digest = hashlib.sha256("\n".join(by.get(h["id"], [])).encode())
                start = h.get("started_at")
                for i, body in enumerate(by.get(h["id"], [None])):
                    out.append((f"{path}#{h['id']}", str(h["id"]), h.get("parent_session_id"), h.get("model"), None if start is None else str(start), h.get("message_count"), digest.hexdigest(), len(data), i, body))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _DB.split(", ")]).astype({"claimed": "Int64"})


def state_databases(spark: SparkSession, path: str) -> DataFrame:
    """A row for each message of each session, in order."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "state.db").load(path)
    return f.select(F.col("path").alias("file"), "content").mapInPandas(_databases, _DB)


def _time(c: Column) -> Column:
    """Seconds since 1970 as a number, or ISO 8601."""
    return F.coalesce(F.timestamp_micros((F.try_variant_get(F.try_parse_json(c), "$", "double") * 1_000_000).cast("long")), stamp(c))


def hermes(spark: SparkSession, path: str, profile: str = "default") -> Tables:
    name = F.regexp_extract("file", "([^/]+)$", 1)
    digest = [F.sha2(F.col("body").cast("binary"), 256).alias("raw_hash"), F.octet_length("body").cast("long").alias("raw_size")]
    none = F.lit(None).cast("string")
    snap = files(spark, path, "session_*.json").withColumn("v", F.try_parse_json("body")).where("v is not null")
    sid = F.coalesce(F.nullif(get("session_id"), F.lit("")), F.regexp_extract(name, r"^session_(.*)\.json$", 1))
    snap = snap.select("file", sid.alias("id"), F.nullif(F.trim(get("parent_session_id")), F.lit("")).alias("parent"), get("model").alias("model"), get("session_start").alias("start"), get("last_updated").alias("end"), *digest, get("messages", "array<variant>").alias("m"))
    logs = files(spark, path, "*.jsonl").select("file", F.regexp_extract(name, r"^(.*)\.jsonl$", 1).alias("id"), none.alias("parent"), none.alias("model"), none.alias("start"), none.alias("end"), *digest)
    log_lines = lines(spark, path)
    db = state_databases(spark, path)
    own = log_lines.groupBy("file").agg(F.count("*").alias("n")).join(logs.select("file", "id"), "file").select("id", "n").union(snap.select("id", F.coalesce(F.size("m"), F.lit(0)).cast("long")))
    longer = own.groupBy(F.col("id").alias("_id")).agg(F.max("n").alias("_n"))
    db = db.join(longer, (F.col("id") == F.col("_id")) & (F.col("claimed").isNull() | (F.col("_n") > F.col("claimed"))), "left_anti")
    head = ["file", "id", "parent", "model", "start", "end", "raw_hash", "raw_size"]
    heads = logs.select(head).union(snap.select(head)).union(db.withColumn("end", none).select(head).distinct())
    v = log_lines.union(snap.select("file", F.posexplode("m").alias("line", "v"))).union(db.where("body is not null").select("file", "line", F.parse_json("body")))
    v = v.withColumn("ts", _time(get("timestamp"))).withColumn("role", get("role"))
    text = _content_text("content")
    clean = tx._trim(tx.clean_prompt(text))
    turns = said(v.where("role = 'user'"), "user", F.when(clean == "", text).otherwise(clean), 0, raw=text).union(said(v.where("role = 'assistant'"), "assistant", text, 0))
    uses = v.select("file", "line", F.explode(get("tool_calls", "array<struct<name:string>>")).alias("x")).where("x.name <> ''").select("file", "line", F.lit("").alias("call"), F.col("x.name").alias("name"))
    zero = F.lit(0).cast("long")
    counted = v.select("file", get("token_count", "long").alias("n")).where("n is not null").groupBy("file").agg(F.sum("n").alias("total_tokens"))
    usage = counted.select("file", "total_tokens", *[zero.alias(c) for c in ("input_tokens", "output_tokens", "cached_tokens", "cache_read_tokens", "cache_creation_tokens")], F.lit(True).alias("seen"))
    spoken = v.groupBy("file").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    parent = first(v, F.trim(get("parent_session_id")), "_parent")
    model = first(v.where("role = 'assistant'"), get("model"), "_model")
    heads = joined(heads, spoken, parent, model)
    start, end = _time(F.col("start")), _time(F.col("end"))
    heads = heads.select(
        "file", "id", F.coalesce("parent", "_parent").alias("parent"), none.alias("path"), F.coalesce("_model", F.nullif("model", F.lit(""))).alias("model"),
        F.least(start, "lo").alias("started_at"), F.greatest(end, "hi", start).alias("last_activity_at"), "raw_size", "raw_hash",
    )
    return assemble(heads, turns, uses, usage, "hermes", profile)
