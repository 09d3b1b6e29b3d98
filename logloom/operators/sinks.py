"""What goes out: device and identity updates, raw files by day, and the emitters' formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display
from ..functions import text as tx
from ..schema import Tables


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys that new has, and all of new; columns that one side lacks are null."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(old: Tables, new: Tables) -> Tables:
    """Sessions of `new` take the place of those with their ids, with all that hangs on them: a session that is no longer measured loses its usage."""
    ids = new.sessions.select(F.col("id").alias("session_id")).distinct()

    def children(name: str) -> DataFrame:
        return getattr(old, name).join(ids, "session_id", "left_anti").unionByName(getattr(new, name), allowMissingColumns=True)

    return Tables(
        replace_rows(old.sessions, new.sessions, "id"), *[children(n) for n in ("turns", "tools", "usage", "kinds")], upsert_devices(old.devices, new.devices)
    )


def upsert_devices(old: DataFrame, new: DataFrame) -> DataFrame:
    """A friendly name that is null or empty doesn't take the place of one that is known."""
    n = new.groupBy("id").agg(F.max("friendly_name").alias("_new"))
    name = F.coalesce(F.nullif("_new", F.lit("")), F.col("friendly_name"), F.col("_new"))
    return old.join(n, "id", "full").select("id", name.alias("friendly_name"))


def touch_last_sync(devices: DataFrame, seen: DataFrame, now, least: str = "1 minute") -> DataFrame:
    """devices with last_sync = now for the ids of `seen`, but for those that were touched less than a minute ago."""
    ids = seen.select(F.col("id").alias("_id")).distinct()
    at = F.lit(now).cast(dict(devices.dtypes)["last_sync"])
    due = F.col("_id").isNotNull() & (F.col("last_sync").isNull() | (F.col("last_sync") < at - F.expr(f"INTERVAL {least}")))
    return devices.join(ids, F.col("id") == F.col("_id"), "left").withColumn("last_sync", F.when(due, at).otherwise(F.col("last_sync"))).drop("_id")


def rebind_local(sessions: DataFrame, device_id: str) -> DataFrame:
    """Sessions of the device 'local' become those of the device that has an id now."""
    return sessions.withColumn("device_id", F.when(F.col("device_id") == "local", F.lit(device_id)).otherwise(F.col("device_id")))


def fill_identity(sessions: DataFrame, known: DataFrame) -> DataFrame:
    """Remote and marker where they are null, from known (project_path, remote, marker), of which the largest of a path counts."""
    k = known.groupBy(F.col("project_path").alias("_path")).agg(F.max("remote").alias("_remote"), F.max("marker").alias("_marker"))
    s = sessions.join(k, F.col("project_path") == F.col("_path"), "left")
    return s.withColumns({"project_remote": F.coalesce("project_remote", "_remote"), "project_marker": F.coalesce("project_marker", "_marker")}).select(*sessions.columns)


def paths_without_identity(sessions: DataFrame) -> DataFrame:
    """(project_path): paths, neither null nor empty, of sessions that have neither remote nor marker: what `fill_identity` can be asked about."""
    return sessions.where("project_path <> '' and project_remote is null and project_marker is null").select("project_path").distinct()


def preserve_raw(files: DataFrame, sessions: DataFrame, path: str) -> None:
    """files (file, body) of known sessions as Parquet in folders of agent, year and month, each under the key <id><extension>; a second run replaces the folders that it writes."""
    ext = F.regexp_extract("raw_uri", r"(\.[^./]+)$", 1)
    s = sessions.select(F.col("raw_uri").alias("file"), "id", F.concat("id", ext).alias("key"), "agent", F.year("started_at").alias("year"), F.month("started_at").alias("month"))
    out = files.join(s, "file")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("agent", "year", "month").parquet(path)


def raw_orphans(raw: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of what preserve_raw wrote whose session was not taken in after all: what a push that failed has left, to be deleted."""
    return raw.join(sessions.select("id"), "id", "left_anti")


def byte_range(body: Column, offset: int = 0, size: int = 64 << 10) -> Column:
    """(bytes, eof): a window of a binary column; sizes out of range mean 64 KiB, more than 1 MiB means 1 MiB."""
    size = min(size, 1 << 20) if size > 0 else 64 << 10
    return F.struct(F.substring(body, max(offset, 0) + 1, size).alias("bytes"), (F.octet_length(body) <= max(offset, 0) + size).alias("eof"))


def ndjson(df: DataFrame) -> DataFrame:
    """(value): a JSON object for each row, names in lower case."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`").alias(c.lower()) for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def _top_tools(t: Tables, most: int = 3) -> DataFrame:
    """(session_id, tools): a session's most used tools and how often they were."""
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("count"), "name"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("_n", "name", "count"))), lambda x: F.concat(x["name"], F.lit(" ×"), x["count"].cast("string")))
    return t.tools.withColumn("_n", nth).where(F.col("_n") <= most).groupBy("session_id").agg(F.array_join(named, ", ").alias("tools"))


def timeline(t: Tables, sessions: DataFrame | None = None) -> DataFrame:
    """(started, agent, project, seconds, tools, prompt), newest first: the six columns of the plain timeline; tools: the three most used."""
    s = t.sessions if sessions is None else sessions
    top = _top_tools(t)
    seconds = F.greatest(F.unix_timestamp(F.col("last_activity_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp")), F.lit(0))
    rows = s.join(top, F.col("id") == F.col("session_id"), "left").orderBy(F.desc("started_at"), "id")
    return rows.select(
        F.date_format("started_at", "yyyy-MM-dd HH:mm").alias("started"), "agent", F.coalesce("project_remote", "project_marker", "project_path", F.lit("(unscoped)")).alias("project"),
        seconds.alias("seconds"), F.coalesce("tools", F.lit("")).alias("tools"), F.coalesce("first_prompt", F.lit("")).alias("prompt"),
    )


def timeline_rows(t: Tables, now: Column, sessions: DataFrame | None = None) -> DataFrame:
    """The timeline as it is drawn, newest first: (day, time, active, agent, device, project, prompt, meta, id, detail, ago), all but active and meta texts.

    day: the header that the row stands under; meta: whether nobody wrote the first prompt, which is then `(meta)`; detail: how long it took and the three most used tools.
    """
    s = t.sessions if sessions is None else sessions
    named = t.devices.select(F.col("id").alias("_device"), F.nullif("friendly_name", F.lit("")).alias("_name"))
    rows = s.join(named, F.col("device_id") == F.col("_device"), "left").join(_top_tools(t), F.col("id") == F.col("session_id"), "left")
    started, last = F.col("started_at").cast("timestamp"), F.col("last_activity_at").cast("timestamp")
    line = tx.display_text(tx.clean_prompt(F.col("first_prompt")))
    meta = F.coalesce(line, F.lit("")).eqNullSafe("") | tx.starts_as_boilerplate(F.col("first_prompt"))
    seconds = F.greatest(F.unix_timestamp(last) - F.unix_timestamp(started), F.lit(0))
    detail = F.concat_ws(" · ", tx.human_duration(seconds), F.nullif("tools", F.lit("")))
    return rows.orderBy(F.desc("started_at"), "id").select(
        tx.day_header(F.to_date(started), F.to_date(now)).alias("day"), F.date_format(started, "HH:mm").alias("time"), display.is_active(last, now).alias("active"), tx.agent_short(F.col("agent")).alias("agent"),
        F.coalesce("_name", "device_id").alias("device"), tx.project_label(F.col("project_marker"), F.col("project_remote"), F.col("project_path")).alias("project"),
        F.when(meta, "(meta)").otherwise(line).alias("prompt"), meta.alias("meta"), "id", detail.alias("detail"), display.ago(last, now).alias("ago"),
    )


def write_tsv(df: DataFrame, path: str) -> None:
    """Tabs and line ends inside values become spaces."""
    flat = df.select(*[F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " ").alias(c) for c in df.columns])
    flat.write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def session_documents(t: Tables) -> DataFrame:
    """(id, session, tools, turns): each session as one nested row, its turns by time and place."""
    s = t.sessions.select("id", F.struct(*t.sessions.columns).alias("session"))
    tools = t.tools.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("_k"), "name", "count"))), lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"))).alias("tools"))
    turns = t.turns.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "role", "kind", "tool_name", "content"))).alias("turns"))
    out = s.join(tools.withColumnRenamed("session_id", "id"), "id", "left").join(turns.withColumnRenamed("session_id", "id"), "id", "left")
    kind = dict(out.dtypes)
    return out.withColumns({c: F.coalesce(c, F.array().cast(kind[c])) for c in ("tools", "turns")})
