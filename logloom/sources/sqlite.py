"""Histories that agents keep in SQLite: Cursor's store.db and Antigravity's <cascade>.db.

A database is one session's and read by one task; its rows go on as they are, with what their protocol buffers hold, and
everything else is made of them in Spark.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
from contextlib import closing

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import TOKENS, Tables
from .jsonl import assemble, get, is_text, joined, joined_text, once, said
from .wire import fields, inside, integers, readable, strings


def opened(data: bytes):
    """A connection to a database in memory. A log beside the file is not read, so one that asks for it is told that there is none."""
    import sqlite3

    con = sqlite3.connect(":memory:")
    if data[18:20] == b"\x02\x02":
        data = data[:18] + b"\x01\x01" + data[20:]
    con.deserialize(data)
    return con


def _select(con, query: str) -> list[tuple]:
    """Rows; none where the table is missing, as in a store that nothing was said in yet."""
    import sqlite3

    try:
        return con.execute(query).fetchall()
    except sqlite3.OperationalError as e:
        if "no such table" in str(e) or "no such column" in str(e):
            return []
        raise


def _databases(spark: SparkSession, path: str, glob: str, read, schema: str) -> DataFrame:
    """Rows that `read(path, connection)` gives for each database, before them file, raw_hash, raw_size and modified; files that are no database give none."""
    names = ["file", "raw_hash", "raw_size", "modified", *[c.split()[0] for c in schema.split(", ")]]
    types = f"file string, raw_hash string, raw_size long, modified timestamp, {schema}"

    def rows(batches):
        import sqlite3

        for pdf in batches:
            for file, data, modified in zip(pdf["file"], pdf["content"], pdf["modified"], strict=True):
                data = bytes(data)
                try:
                    with closing(opened(data)) as con:
                        found = list(read(file, con))
                except (sqlite3.DatabaseError, ValueError):
                    continue
                head = (file, hashlib.sha256(data).hexdigest(), len(data), modified)
                yield pd.DataFrame([head + r for r in found], columns=names).astype({c.split()[0]: "Int64" for c in schema.split(", ") if c.endswith(" long")})

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).where("length > 0")
    return once(f.select(F.col("path").alias("file"), "content", F.col("modificationTime").alias("modified")).mapInPandas(rows, types))


# -- Cursor ------------------------------------------------------------------------------------

#: The milliseconds since 1970 between which a number is taken for a time.
TIMES = (1_500_000_000_000, 2_500_000_000_000)
#: How messages start that the program writes in the user's name.
SCAFFOLD = ("<user_info>", "<system_reminder>", "<attached_files>")
_QUERY = r"(?s)<user_query>(.*?)(?:</user_query>|$)"


def _is_path(b: bytes) -> bool:
    s = readable(b) if 4 <= len(b) <= 4096 and b[:1] == b"/" else None
    return s is not None and s.count("/") > 1 and not set("\t\n\r") & set(s)


def _state(data: bytes, depth: int = 6) -> tuple[int | None, set[str]]:
    """(latest time, absolute paths) in a message, what comes before a malformed field included."""
    latest, paths = None, set()
    for _, kind, value in fields(data)[0]:
        if kind == 0 and TIMES[0] <= value <= TIMES[1]:
            latest = max(latest or 0, value)
        elif kind == 2 and _is_path(value):
            paths.add(posixpath.normpath(value.decode()))
        elif kind == 2 and depth:
            t, p = _state(value, depth - 1)
            latest, paths = max(latest or 0, t or 0) or None, paths | p
    return latest, paths


def _cursor_rows(file: str, con):
    """(meta, line, body, latest, paths): one for each message and state, or one of the meta alone."""
    meta = next((v for (v,) in _select(con, "SELECT value FROM meta WHERE key = '0'")), None)
    if isinstance(meta, str) and re.fullmatch("(?:[0-9a-fA-F]{2})*", meta):
        meta = bytes.fromhex(meta).decode("utf-8", "replace")
    out = []
    for i, (data,) in enumerate(_select(con, "SELECT data FROM blobs ORDER BY rowid")):
        data = data.encode() if isinstance(data, str) else bytes(data or b"")
        if data[:1] in (b"{", b"["):
            out.append((meta, i, data.decode("utf-8", "replace"), None, []))
        elif data:
            latest, paths = _state(data)
            out.append((meta, i, None, latest, sorted(paths)))
    return out or [(meta, None, None, None, [])]


def workspace_of_plan(uri: Column) -> Column:
    """The folder that holds .cursor in a file:// address; null where there is none."""
    return F.nullif(F.regexp_extract(uri, r"^file://(.+?)/\.cursor/", 1), F.lit(""))


def workspace_of_text(text: Column) -> Column:
    """An absolute path after "Workspace Path:"."""
    p = F.trim(F.regexp_extract(text, r"Workspace Path:[ \t]*([^\r\n<]*)", 1))
    return F.when(p.startswith("/"), p)


def cursor(spark: SparkSession, path: str, profile: str = "default") -> Tables:
    """chats/<md5 of the workspace>/<agent>/store.db. Tokens are never told.

    The workspace is that of the plan's address, else the longest beginning of a path in the states whose MD5 is the folder's name, else what
    the message about the user says. A folder names the session where the database doesn't. Times are those of the chat's start.
    """
    d = _databases(spark, path, "store.db", _cursor_rows, "meta string, line long, body string, latest long, paths array<string>")
    m = F.try_parse_json("meta")
    ms = lambda c: F.timestamp_millis(F.when(c > 0, c))
    created = F.try_variant_get(m, "$.createdAt", "long")
    heads = d.groupBy("file").agg(F.first("raw_hash").alias("raw_hash"), F.first("raw_size").alias("raw_size"), F.first("meta").alias("meta"), F.max("latest").alias("latest"))
    heads = heads.select(
        "file", "raw_hash", "raw_size", F.coalesce(F.nullif(F.try_variant_get(m, "$.agentId", "string"), F.lit("")), F.regexp_extract("file", "([^/]+)/[^/]+$", 1)).alias("id"),
        F.nullif(F.try_variant_get(m, "$.lastUsedModel", "string"), F.lit("")).alias("model"), ms(created).alias("started_at"), ms(F.greatest(created, "latest")).alias("last_activity_at"),
        workspace_of_plan(F.try_variant_get(m, "$.currentPlanUri", "string")).alias("_plan"), F.lit(None).cast("string").alias("parent"),
    )
    v = d.where("body is not null").select("file", "line", F.try_parse_json("body").alias("v"), ms(created).alias("ts")).where(F.coalesce(get("role"), F.lit("")) != "")
    items = "array<struct<type:string,text:string,toolName:string>>"
    text = F.coalesce(F.when(is_text("content"), get("content")), joined_text(get("content", items)))
    v = v.withColumn("role", get("role")).withColumn("text", text)
    tagged, scaffold = F.col("text").contains("<user_query>"), F.lit(False)
    for s in SCAFFOLD:
        scaffold = scaffold | tx._ltrim(F.col("text")).startswith(s)
    query = F.when(tagged, F.trim(F.regexp_extract("text", _QUERY, 1), F.lit(" \t\r\n"))).when(~scaffold, F.col("text"))
    user = v.where("role = 'user'")
    turns = said(user, "user", F.coalesce(F.nullif(query, F.lit("")), F.col("text")), 0, raw=query).union(said(v.where("role = 'assistant'"), "assistant", F.col("text"), 0))
    uses = v.select("file", "line", F.explode(get("content", items)).alias("x")).where("x.type = 'tool-call' and x.toolName <> ''").select("file", "line", F.lit("").alias("call"), F.col("x.toolName").alias("name"))
    # every beginning of every path, by its digest
    chat = F.regexp_extract("file", "/([0-9a-f]{32})/[^/]+/[^/]+$", 1)
    parts = d.select("file", chat.alias("md5"), F.explode("paths").alias("p")).where("md5 <> ''").distinct().withColumn("s", F.split("p", "/"))
    begins = parts.select("file", "md5", F.explode(F.transform(F.sequence(F.lit(2), F.size("s")), lambda n: F.array_join(F.slice("s", 1, n), "/"))).alias("b"))
    by_digest = begins.where(F.md5(F.col("b").cast("binary")) == F.col("md5")).groupBy("file").agg(F.max_by("b", F.length("b")).alias("_digest"))
    told = v.where(F.col("text").contains("Workspace Path:")).groupBy("file").agg(F.min_by("text", "line").alias("_told"))
    heads = joined(heads, by_digest, told).withColumn("path", F.coalesce("_plan", "_digest", workspace_of_text(F.col("_told"))))
    return assemble(heads, turns, uses, _no_usage(spark), "cursor", profile)


def _no_usage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "file string, " + ", ".join(f"{t} long" for t in TOKENS) + ", seen boolean")


# -- Antigravity -------------------------------------------------------------------------------

#: Kinds of step.
USER_INPUT, PLANNER_RESPONSE, CHECKPOINT = 14, 15, 23
#: How the arguments of a tool's call start.
TOOL_JSON = ('{"toolAction"', '{"toolSummary"', '{"AbsolutePath"', '{"CommandLine"', '{"Cwd"', '{"FilePath"', '{"Query"', '{"Pattern"')
_NAME = re.compile(r"(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{1,64}\Z")


def tool_call(payload: bytes | None) -> tuple[str | None, str | None]:
    """The first arguments of a tool in a message, and the last name before them."""
    name = None
    for s in strings(payload):
        if s.startswith(TOOL_JSON):
            return name, s
        if _NAME.match(s):
            name = s
    return None, None


def first_text(payload: bytes | None, least: int = 16) -> str | None:
    """The first string of so many characters that are no tool's arguments."""
    return next((s for s in strings(payload) if len(s) >= least and not s.startswith(TOOL_JSON)), None)


def _micros(metadata: bytes | None) -> int | None:
    """The time in field 1 of a step's metadata: seconds and nanoseconds."""
    t = integers(inside(metadata, 1))
    return None if 1 not in t else t[1] * 1_000_000 + t.get(2, 0) // 1000


def _utf8(b: bytes | None) -> str | None:
    try:
        return b.decode() if b else None
    except UnicodeDecodeError:
        return None


def _antigravity_rows(file: str, con):
    """(cascade, workspace, model, line, step, micros, seen, tokens in, out, written, read, said, tool, args): one for each step, or one of the head alone."""
    cascade = next((v for (v,) in _select(con, "SELECT cascade_id FROM trajectory_meta LIMIT 1")), None)
    about = next((v for (v,) in _select(con, "SELECT data FROM trajectory_metadata_blob WHERE id = 'main' LIMIT 1")), None)
    workspace = next((s.removeprefix("file://") for s in strings(about) if s.startswith("file://")), None)
    runs = _select(con, "SELECT data FROM executor_metadata ORDER BY idx LIMIT 1")
    model = readable(inside(runs[0][0], 10, 1, 28)) if runs else None
    for (data,) in _select(con, "SELECT data FROM gen_metadata ORDER BY idx") if not model else ():
        model = model or next((readable(v) for f, k, v in reversed(fields(inside(data, 1) or b"")[0]) if f == 19 and k == 2 and readable(v)), None)
    head, out = (cascade, workspace, model), []
    for idx, step, meta, payload in _select(con, "SELECT idx, step_type, metadata, step_payload FROM steps ORDER BY idx"):
        stats = inside(meta, 9)
        n = integers(stats) if stats and fields(stats)[1] and fields(stats)[0] else None
        said_, tool, args = None, None, None
        if step == USER_INPUT:
            said_ = _utf8(inside(payload, 19, 2))
        elif step == PLANNER_RESPONSE:
            reply = inside(payload, 20)
            said_ = next((s for f, k, v in fields(reply or b"")[0] if f == 1 and k == 2 and (s := readable(v))), None)
        elif step != CHECKPOINT:
            tool, args = tool_call(payload)
            if not tool:
                tool, args, said_ = None, None, first_text(payload)
        out.append((*head, idx, step, _micros(meta), n is not None, *[(n or {}).get(k, 0) for k in (2, 3, 4, 5)], said_, tool, args))
    return out or [(*head, *[None] * 3, False, *[0] * 4, None, None, None)]


def antigravity(spark: SparkSession, path: str, profile: str = "default") -> Tables:
    """<cascade>.db: steps in order. A step without a time has that of the step before it; only the first message of the user is one.

    The prompt is counted whole: what is read from and written to the cache is part of the input.
    """
    schema = "cascade string, workspace string, model string, line long, step long, micros long, seen boolean, i long, o long, w long, r long, said string, tool string, args string"
    d = _databases(spark, path, "*.db", _antigravity_rows, schema)
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    steps = d.where("line is not null").withColumn("ts", F.timestamp_micros(F.last("micros", ignorenulls=True).over(before)))
    first_said = F.min(F.when((F.col("step") == USER_INPUT) & (F.col("said") != ""), F.col("line"))).over(Window.partitionBy("file"))
    user = steps.withColumn("_first", first_said).where((F.col("step") == USER_INPUT) & (F.col("line") == F.col("_first")))
    tools = steps.where("tool is not null")
    called = tools.select("file", "line", F.lit(0).alias("part"), F.lit(0).alias("nth"), F.lit("tool").alias("role"), F.col("args").alias("content"), F.col("args").alias("content_raw"), "ts", F.lit("tool_result").alias("kind"), F.col("tool").alias("tool_name"))
    turns = said(user, "user", F.col("said"), 0).union(said(steps.where(F.col("step") != USER_INPUT), "assistant", F.col("said"), 0)).union(called)
    uses = tools.select("file", "line", F.lit("").alias("call"), F.col("tool").alias("name"))
    sums = steps.where("seen").groupBy("file").agg(*[F.sum(c).alias(c) for c in "iowr"]).withColumn("i", F.col("i") + F.col("r") + F.col("w"))
    usage = sums.select("file", (F.col("i") + F.col("o")).alias("total_tokens"), F.col("i").alias("input_tokens"), F.col("o").alias("output_tokens"), F.col("r").alias("cached_tokens"), F.col("r").alias("cache_read_tokens"), F.col("w").alias("cache_creation_tokens"), F.lit(True).alias("seen"))
    heads = d.groupBy("file").agg(*[F.first(c).alias(c) for c in ("raw_hash", "raw_size", "modified", "cascade", "model")], F.first("workspace").alias("path"), F.min(F.timestamp_micros("micros")).alias("lo"), F.max(F.timestamp_micros("micros")).alias("hi"))
    start = F.coalesce("lo", "modified")
    heads = heads.select(
        "file", "raw_hash", "raw_size", F.coalesce(F.nullif("cascade", F.lit("")), F.regexp_extract("file", r"([^/]+)\.db$", 1)).alias("id"), "path", "model", start.alias("started_at"),
        F.coalesce("hi", start).alias("last_activity_at"), F.lit(None).cast("string").alias("parent"),
    )
    return assemble(heads, turns, uses, usage, "antigravity", profile)
