"""Histories that agents keep as JSON: one file is one session, read whole, its lines in order.

A file is the unit of work, as long as one history; the files of a store are spread over the cluster.
Lines that are no JSON are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import TOKENS, Tables
from ..shared import shared_folder

UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
BLOCKS = "array<struct<type:string,text:string,thinking:string,name:string,id:string,tool_use_id:string,content:variant>>"


def file_name(uri: Column) -> Column:
    """A file's name as Spark's readers take it and as `histories` gives it: nothing escaped, and two slashes before the path of a local one."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:///")


def files(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """(file, body) of the files under path, or of those named, whose names fit."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(file_name(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("body"))


def once(df: DataFrame) -> DataFrame:
    """df made once for all that is made of it, in the folder that driver and executors share; kept by the executors where a cluster names none."""
    return df.checkpoint() if shared_folder(df.sparkSession) else df.persist(StorageLevel.MEMORY_AND_DISK)


def parsed(spark: SparkSession, path: str, glob: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """(lines (file, line, v): the JSON lines as variants; facts (file, raw_hash, raw_size)). The files are read and parsed once."""
    rows = files(spark, path, glob).select("file", F.posexplode(F.split("body", "\n")).alias("line", "raw"), F.col("body"))
    first_line = F.col("line") == 0
    rows = once(rows.select(
        "file", "line", F.try_parse_json("raw").alias("v"), F.when(first_line, F.sha2(F.col("body").cast("binary"), 256)).alias("raw_hash"), F.when(first_line, F.octet_length("body").cast("long")).alias("raw_size"),
    ).where("v is not null or line = 0"))
    return rows.where("v is not null").select("file", "line", "v"), rows.where("line = 0").select("file", "raw_hash", "raw_size")


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    return parsed(spark, path, glob)[0]


def get(path: str, kind: str = "string", v: str = "v") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def is_text(path: str, v: str = "v") -> Column:
    """Whether the value is a string: a cast would also make text of an array."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")) == "STRING"


def stamp(c: Column) -> Column:
    return F.try_to_timestamp(c)


def joined_text(blocks: Column) -> Column:
    return F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != "")), lambda b: b["text"]), "\n")


def number_turns(turns: DataFrame) -> DataFrame:
    """turns (file, line, part, nth, role, content, ts, kind, tool_name) with `seq`, the place in the session."""
    from pyspark.sql import Window

    return turns.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy("line", "part", "nth")))


def assemble(heads: DataFrame, turns: DataFrame, tools: DataFrame, usage: DataFrame, agent: str, profile: str = "default", device: str = "local") -> Tables:
    """Canonical tables from (file, id, parent, path, model, started_at, last_activity_at, raw_size, raw_hash), turns and counts by file.

    usage: (file, tokens…, seen). Sessions whose usage was told and is nothing are not taken in; those that never told are.
    """
    zero = usage.where("seen and total_tokens = 0 and input_tokens = 0 and output_tokens = 0").select("file")
    heads = heads.where("id is not null").join(zero, "file", "left_anti")
    ids = heads.select("file", "id")
    t = number_turns(turns).join(ids, "file")
    prompts = t.where("role = 'user'").select("id", "seq", tx.first_prompt(F.col("content_raw")).alias("p")).where("p is not null").groupBy("id").agg(F.min_by("p", "seq").alias("first_prompt"))
    null = F.lit(None).cast("string")
    s = heads.join(prompts, "id", "left").select(
        "id", F.lit(agent).alias("agent"), F.lit(device).alias("device_id"), F.col("path").alias("project_path"), null.alias("project_remote"), null.alias("project_marker"), "started_at", "last_activity_at",
        "first_prompt", "model", F.col("file").alias("raw_uri"), "raw_hash", "raw_size", F.col("parent").alias("parent_session_id"), F.lit(profile).alias("profile"),
    )
    out = t.select(F.xxhash64("id", "seq").alias("id"), F.col("id").alias("session_id"), "role", "content", "ts", "kind", "tool_name", "seq")
    tl = tools.join(ids, "file").groupBy(F.col("id").alias("session_id"), "name").agg(F.count("*").alias("count"))
    u = usage.where("total_tokens > 0 or input_tokens > 0 or output_tokens > 0").join(ids, "file").select(F.col("id").alias("session_id"), *TOKENS)
    return Tables(s, out, tl, u, kinds(out, tl, s), s.sparkSession.createDataFrame([], "id string, friendly_name string"))


def kinds(turns: DataFrame, tools: DataFrame, sessions: DataFrame) -> DataFrame:
    """goal and ralph-loop by what users say, workflow by a tool, orchestrator by children, whatever the order of import."""
    user = turns.where("role = 'user'")
    raw = "content_raw" if "content_raw" in turns.columns else "content"
    goal = user.where(tx._ltrim(F.col(raw)).startswith(tx.GOAL_OPEN)).select("session_id", F.lit("goal").alias("kind"))
    ralph = user.where(F.col(raw).contains(tx.RALPH_MARKER)).select("session_id", F.lit("ralph-loop").alias("kind"))
    flow = tools.where("name = 'Workflow'").select("session_id", F.lit("workflow").alias("kind"))
    parents = sessions.select(F.col("parent_session_id").alias("id")).where("id is not null")
    orchestrator = sessions.select("id").join(parents, "id", "left_semi").select(F.col("id").alias("session_id"), F.lit("orchestrator").alias("kind"))
    return reduce(DataFrame.union, [goal, ralph, flow, orchestrator]).distinct()


def span(v: DataFrame, at: Column) -> DataFrame:
    return v.groupBy("file").agg(F.min(at).alias("started_at"), F.max(at).alias("last_activity_at"))


def first(v: DataFrame, value: Column, name: str) -> DataFrame:
    """The first value, by line, that is neither null nor empty."""
    return v.select("file", "line", value.alias("_x")).where("_x is not null and _x <> ''").groupBy("file").agg(F.min_by("_x", "line").alias(name))


def raw_facts(spark: SparkSession, path: str, glob: str) -> DataFrame:
    f = files(spark, path, glob)
    return f.select("file", F.sha2(F.col("body").cast("binary"), 256).alias("raw_hash"), F.octet_length("body").cast("long").alias("raw_size"))


def joined(base: DataFrame, *parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "file", "left"), parts, base)


def tool_turns(results: DataFrame, uses: DataFrame) -> DataFrame:
    """results (file, line, part, nth, call, text, ts) as turns, named by the last use of the call's id at or before them."""
    u = uses.select(F.col("file").alias("_f"), F.col("line").alias("_l"), F.col("call").alias("_c"), F.col("name").alias("_n")).where("_c <> ''")
    j = results.join(u, (F.col("file") == F.col("_f")) & (F.col("call") == F.col("_c")) & (F.col("_l") <= F.col("line")), "left")
    g = j.groupBy("file", "line", "part", "nth", "text", "ts").agg(F.max_by("_n", "_l").alias("tool_name"))
    return g.select("file", "line", "part", "nth", F.lit("tool").alias("role"), tx.preview("text").alias("content"), F.col("text").alias("content_raw"), "ts", F.lit("tool_result").alias("kind"), "tool_name")


def said(rows: DataFrame, role: str, content: Column, part: int, kind: str = "message", nth: Column | None = None, raw: Column | None = None) -> DataFrame:
    t = rows.select("file", "line", F.lit(part).alias("part"), (nth if nth is not None else F.lit(0)).alias("nth"), F.lit(role).alias("role"), content.alias("content"), (raw if raw is not None else content).alias("content_raw"), "ts", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("tool_name"))
    return t.where("content is not null and content <> ''")


# -- Claude Code -------------------------------------------------------------------------------


def claude_code(spark: SparkSession, path: str, profile: str = "default") -> Tables:
    """<uuid>.jsonl, and <parent uuid>/subagents/agent-*.jsonl, which are known by their names."""
    name = F.regexp_extract("file", "([^/]+)$", 1)
    ok = name.rlike(f"^{UUID}\\.jsonl$") | (F.col("file").contains("/subagents/") & name.rlike(r"^agent-.*\.jsonl$"))
    ok = ok & ~F.col("file").rlike("/(memory|tool-results)/")
    v, facts = parsed(spark, path)
    v = v.where(ok).withColumn("ts", stamp(get("timestamp"))).withColumn("type", get("type"))
    sub = F.col("file").contains("/subagents/") & name.rlike("^agent-")
    own_id = F.when(sub, F.regexp_replace(name, r"\.jsonl$", ""))
    parent = F.when(sub, F.nullif(F.regexp_extract("file", f"/({UUID})/subagents/", 1), F.lit("")))
    blocks = v.withColumn("b", get("message.content", BLOCKS)).withColumn("plain", F.when(is_text("message.content"), get("message.content")))
    user = blocks.where((F.col("type") == "user") & ~F.coalesce(get("isMeta", "boolean"), F.lit(False)))
    asst = blocks.where("type = 'assistant'")
    text = F.coalesce("plain", joined_text(F.col("b")))
    clean = tx._trim(tx.clean_prompt(text))
    each = asst.select("file", "line", "ts", F.posexplode("b").alias("nth", "x"))
    uses = each.where("x.type = 'tool_use' and x.name <> ''").select("file", "line", F.col("x.id").alias("call"), F.col("x.name").alias("name"))
    results = user.select("file", "line", "ts", F.posexplode("b").alias("nth", "x")).where("x.type = 'tool_result'")
    body = F.coalesce(F.when(F.schema_of_variant("x.content") == "STRING", F.try_variant_get("x.content", "$", "string")), joined_text(F.try_variant_get("x.content", "$", "array<struct<type:string,text:string>>")))
    results = results.select("file", "line", F.lit(1).alias("part"), "nth", F.col("x.tool_use_id").alias("call"), body.alias("text"), "ts").where("text <> ''")
    thinking = each.where("x.type = 'thinking'")
    turns = said(user, "user", F.when(clean == "", text).otherwise(clean), 0, raw=text).union(said(asst, "assistant", joined_text(F.col("b")), 0)).union(said(thinking, "assistant", tx.preview("x.thinking"), 1, "thinking", F.col("nth"))).union(tool_turns(results, uses))
    num = lambda p: F.coalesce(get(f"message.usage.{p}", "long"), F.lit(0))
    creation = F.when(num("cache_creation_input_tokens") > 0, num("cache_creation_input_tokens")).otherwise(num("cache_creation.ephemeral_5m_input_tokens") + num("cache_creation.ephemeral_1h_input_tokens"))
    key = F.coalesce(*[F.nullif(get(p), F.lit("")) for p in ("requestId", "message.id", "uuid")], F.concat(F.lit("line:"), F.col("line").cast("string")))
    u = v.where((F.col("type") == "assistant") & get("message.usage", "variant").isNotNull()).select("file", "line", key.alias("key"), num("input_tokens").alias("i"), num("output_tokens").alias("o"), num("cache_read_input_tokens").alias("r"), creation.alias("c"))
    best = u.groupBy("file", "key").agg(F.max(F.struct((F.col("i") + F.col("o") + F.col("r") + F.col("c")).alias("size"), "line", "i", "o", "r", "c")).alias("m"))  # of equals the later
    total = best.select("file", (F.col("m.i") + F.col("m.r") + F.col("m.c")).alias("i"), "m.o", "m.r", "m.c").groupBy("file").agg(*[F.sum(x).alias(x) for x in "iorc"])
    usage = total.select("file", (F.col("i") + F.col("o")).alias("total_tokens"), F.col("i").alias("input_tokens"), F.col("o").alias("output_tokens"), F.col("r").alias("cached_tokens"), F.col("r").alias("cache_read_tokens"), F.col("c").alias("cache_creation_tokens"), F.lit(True).alias("seen"))
    model = F.when(get("message.model") != "<synthetic>", get("message.model"))
    heads = joined(span(v, F.col("ts")), first(v, get("sessionId"), "_id"), first(v, get("cwd"), "path"), first(asst, model, "model"), facts)
    heads = heads.withColumn("id", F.coalesce(own_id, "_id")).withColumn("parent", parent)
    return assemble(heads, turns, uses, usage, "claude-code", profile)


# -- Codex -------------------------------------------------------------------------------------

_TEXT_PARTS = "array<struct<type:string,text:string>>"


def _content_text(path: str, v: str = "v") -> Column:
    parts = F.transform(F.filter(get(path, _TEXT_PARTS, v), lambda b: F.coalesce(b["text"], F.lit("")) != ""), lambda b: b["text"])
    return F.when(is_text(path, v), get(path, "string", v)).otherwise(F.array_join(parts, "\n"))


def codex(spark: SparkSession, path: str, profile: str = "default") -> Tables:
    """rollout-*.jsonl: envelopes of a type and a payload, or older flat records."""
    v, facts = parsed(spark, path, "rollout-*.jsonl")
    v = v.withColumn("ts", stamp(get("timestamp"))).withColumn("type", get("type"))
    flat = F.col("type").isin("message", "function_call", "function_call_output")
    item = v.where((F.col("type") == "response_item") | flat).withColumn("p", F.when(flat, F.col("v")).otherwise(F.try_variant_get("v", "$.payload", "variant")))
    item = item.withColumn("kind_", get("type", v="p"))
    msg = item.where("kind_ = 'message'").withColumn("said_by", get("role", v="p"))
    text = _content_text("content", "p")
    clean = tx._trim(tx.clean_prompt(text))
    user, asst = msg.where("said_by = 'user'"), msg.where("said_by = 'assistant'")
    uses = item.where(F.col("kind_").isin("function_call", "custom_tool_call", "local_shell_call") & (get("name", v="p") != "")).select("file", "line", get("call_id", v="p").alias("call"), get("name", v="p").alias("name"))
    output = F.coalesce(F.nullif(_content_text("output", "p"), F.lit("")), get("output.content", v="p"), _content_text("content", "p"))
    results = item.where(F.col("kind_").isin("function_call_output", "custom_tool_call_output")).select("file", "line", F.lit(0).alias("part"), F.lit(0).alias("nth"), get("call_id", v="p").alias("call"), output.alias("text"), "ts").where("text <> ''")
    summary = F.array_join(F.transform(get("summary", _TEXT_PARTS, "p"), lambda b: b["text"]), "\n")
    thinking = item.where("kind_ = 'reasoning'")
    turns = said(user, "user", F.when(clean == "", text).otherwise(clean), 0, raw=text).union(said(asst, "assistant", text, 0)).union(said(thinking, "assistant", tx.preview(summary), 0, "thinking")).union(tool_turns(results, uses))
    ev = v.where((F.col("type") == "event_msg") & (get("payload.type") == "token_count"))
    src = lambda k: F.coalesce(get(f"payload.info.total_token_usage.{k}", "long"), get(f"payload.info.last_token_usage.{k}", "long"), F.lit(0))
    inp, out = src("input_tokens"), src("output_tokens")
    tot = F.when(src("total_tokens") > 0, src("total_tokens")).otherwise(inp + out)
    best = ev.select("file", F.struct(tot.alias("t"), "line", inp.alias("i"), out.alias("o"), F.least(src("cached_input_tokens"), inp).alias("r")).alias("m")).groupBy("file").agg(F.max("m").alias("m"))
    usage = best.select("file", F.col("m.t").alias("total_tokens"), F.col("m.i").alias("input_tokens"), F.col("m.o").alias("output_tokens"), F.col("m.r").alias("cached_tokens"), F.col("m.r").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_creation_tokens"), F.lit(True).alias("seen"))
    meta, ctx = v.where("type = 'session_meta'"), v.where("type = 'turn_context'")
    heads = joined(
        span(v, F.col("ts")), first(meta, get("payload.id"), "_id"), first(v.where(F.col("type").isin("session_meta", "turn_context")), get("payload.cwd"), "path"), first(ctx, get("payload.model"), "model"),
        first(meta, get("payload.source.subagent.thread_spawn.parent_thread_id"), "parent"), facts,
    )
    heads = heads.withColumn("id", F.coalesce("_id", F.nullif(F.regexp_extract("file", f"({UUID})\\.jsonl$", 1), F.lit(""))))
    return assemble(heads, turns, uses, usage, "codex", profile)


# -- Gemini ------------------------------------------------------------------------------------


def gemini(spark: SparkSession, path: str, profile: str = "default") -> Tables:
    """session-*.json with messages, or an array of records, of which the session with most is taken, ties by id."""
    docs = files(spark, path, "*.json").withColumn("v", F.try_parse_json("body")).where("v is not null")
    docs = once(docs.select("file", "v", F.sha2(F.col("body").cast("binary"), 256).alias("raw_hash"), F.octet_length("body").cast("long").alias("raw_size")))
    env = docs.where(get("sessionId").isNotNull()).select("file", get("sessionId").alias("sid"), F.posexplode(get("messages", "array<variant>")).alias("line", "m"))
    live = docs.where(get("sessionId").isNull()).select("file", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("line", "m")).withColumn("sid", get("sessionId", v="m"))
    sizes = live.groupBy("file", "sid").agg(F.count("*").alias("n")).groupBy("file").agg(F.max_by("sid", F.struct("n", "sid")).alias("sid"))
    live = live.join(sizes, ["file", "sid"]).select("file", "sid", "line", "m")
    v = env.union(live).withColumnRenamed("m", "v").withColumn("ts", stamp(get("timestamp"))).withColumn("type", get("type"))
    text = F.coalesce(F.nullif(_content_text("content"), F.lit("")), get("message"))
    clean = tx._trim(tx.clean_prompt(text))
    turns = said(v.where("type = 'user'"), "user", F.when(clean == "", text).otherwise(clean), 0, raw=text).union(said(v.where(F.col("type").isin("gemini", "assistant", "model")), "assistant", text, 0))
    uses = v.select("file", "line", F.explode(get("toolCalls", "array<struct<name:string>>")).alias("x")).where("x.name <> ''").select("file", "line", F.lit("").alias("call"), F.col("x.name").alias("name"))
    num = lambda p: F.coalesce(get(f"tokens.{p}", "long"), F.lit(0))
    key = F.coalesce(get("id"), get("messageId"), F.concat(F.lit("line:"), F.col("line").cast("string")))
    u = v.where(get("tokens", "variant").isNotNull()).select("file", "line", key.alias("key"), num("input").alias("i"), (num("output") + num("thoughts")).alias("o"), num("cached").alias("r"), num("total").alias("t"))
    one = u.groupBy("file", "key").agg(F.min_by(F.struct("i", "o", "r", "t"), "line").alias("m")).groupBy("file").agg(*[F.sum(f"m.{x}").alias(x) for x in "iort"])
    usage = one.select("file", F.when(F.col("t") > 0, F.col("t")).otherwise(F.col("i") + F.col("o")).alias("total_tokens"), F.col("i").alias("input_tokens"), F.col("o").alias("output_tokens"), F.col("r").alias("cached_tokens"), F.col("r").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_creation_tokens"), F.lit(True).alias("seen"))
    heads = joined(span(v, F.col("ts")), first(v, F.col("sid"), "id"), first(v, get("model"), "model"), docs.select("file", "raw_hash", "raw_size"))
    null = F.lit(None).cast("string")
    return assemble(heads.withColumn("path", null).withColumn("parent", null), turns, uses, usage, "gemini", profile)


# -- Grok Build --------------------------------------------------------------------------------


def grok_build(spark: SparkSession, path: str, profile: str = "default") -> Tables:
    """Folders of summary.json, chat_history.jsonl and updates.jsonl. A user's turn has a prompt_index and no synthetic_reason."""
    folder = F.regexp_extract("file", "^(.*)/[^/]+$", 1)
    s = files(spark, path, "summary.json").select(folder.alias("file"), F.try_parse_json("body").alias("v"), F.sha2(F.col("body").cast("binary"), 256).alias("raw_hash"), F.octet_length("body").cast("long").alias("raw_size")).where("v is not null")
    chat = lines(spark, path, "chat_history.jsonl").withColumn("file", folder).withColumn("ts", F.lit(None).cast("timestamp")).withColumn("type", get("type"))
    human = (F.col("type") == "user") & get("prompt_index", "variant").isNotNull() & (F.coalesce(get("synthetic_reason"), F.lit("")) == "")
    text = F.nullif(F.regexp_extract(_content_text("content"), r"(?s)<user_query>\s*(.*?)\s*(?:</user_query>|$)", 1), F.lit(""))
    text = F.coalesce(text, _content_text("content"))
    uses = chat.where("type = 'assistant'").select("file", "line", F.explode(get("tool_calls", "array<struct<id:string,name:string>>")).alias("x")).where("x.name <> ''").select("file", "line", F.col("x.id").alias("call"), F.col("x.name").alias("name"))
    results = chat.where("type = 'tool_result'").select("file", "line", F.lit(0).alias("part"), F.lit(0).alias("nth"), get("tool_call_id").alias("call"), _content_text("content").alias("text"), "ts").where("text <> ''")
    summary = F.array_join(F.transform(get("summary", _TEXT_PARTS), lambda b: b["text"]), "\n")
    turns = said(chat.where(human), "user", text, 0).union(said(chat.where("type = 'assistant'"), "assistant", _content_text("content"), 0)).union(said(chat.where("type = 'reasoning'"), "assistant", tx.preview(summary), 0, "thinking")).union(tool_turns(results, uses))
    up = lines(spark, path, "updates.jsonl").withColumn("file", folder)
    num = lambda p: F.sum(F.coalesce(get(f"params.update.usage.{p}", "long"), F.lit(0)))
    done = up.where((get("params.update.sessionUpdate") == "turn_completed") & ~F.coalesce(get("params.update.prompt_id"), F.lit("")).startswith("subagent-completed-") & get("params.update.usage", "variant").isNotNull())
    usage = done.groupBy("file").agg(num("totalTokens").alias("total_tokens"), num("inputTokens").alias("input_tokens"), num("outputTokens").alias("output_tokens"), num("cachedReadTokens").alias("cached_tokens"), num("cachedReadTokens").alias("cache_read_tokens"), num("cacheCreationTokens").alias("cache_creation_tokens"), F.lit(True).alias("seen"))
    child = files(spark, path, "meta.json").where(F.col("file").rlike("/subagents/[^/]+/meta.json$")).select(F.regexp_extract("file", "/([^/]+)/subagents/([^/]+)/meta.json$", 1).alias("parent"), F.regexp_extract("file", "/subagents/([^/]+)/meta.json$", 1).alias("id"))
    heads = s.select("file", get("info.id").alias("id"), get("info.cwd").alias("path"), get("current_model_id").alias("model"), stamp(get("created_at")).alias("started_at"), F.coalesce(stamp(get("last_active_at")), stamp(get("updated_at"))).alias("last_activity_at"), "raw_hash", "raw_size")
    heads = heads.join(child.groupBy("id").agg(F.min("parent").alias("parent")), "id", "left")
    return assemble(heads, turns, uses, usage, "grok-build", profile)
