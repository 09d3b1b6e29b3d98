"""Sessions one by one: lists with filters, sorting and paging, single sessions, families, manifests, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import with_cost
from ..operators.filters import SessionFilter, apply
from ..operators.search import ranked_turns
from ..schema import Tables

#: What of each session a list shows.
LISTED = ("id", "agent", "device_id", "profile", "project_path", "project_remote", "project_marker", "started_at", "last_activity_at", "model", "parent_session_id")


def _list_limit(n: int | None) -> int:
    """Out of range means the default."""
    return n if n and 0 < n <= 1000 else 200


def with_kinds(t: Tables, s: DataFrame) -> DataFrame:
    k = t.kinds.groupBy("session_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))  # a handful a session
    return s.join(k, s["id"] == k["session_id"], "left").drop("session_id").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))


def with_tokens(t: Tables, s: DataFrame) -> DataFrame:
    u = t.usage.withColumn("measured", F.lit(True))
    return s.join(u, s["id"] == u["session_id"], "left").drop("session_id").withColumn("measured", F.coalesce("measured", F.lit(False)))


def _sort(name: str) -> tuple[Column, bool]:
    """Column, and whether the largest come first by default. The project is not the one of reports: another of its names is shown first."""
    sorts = {"total_tokens": (F.col("total_tokens"), True), "agent": (F.col("agent"), False), "project": (F.coalesce("project_marker", "project_remote", "project_path"), False), "device": (F.col("device_id"), False)}
    return sorts.get(name, (F.col("started_at"), True))


def list_sessions(t: Tables, f: SessionFilter | None = None, sort: str = "started_at", descending: bool | None = None, limit: int | None = None, offset: int = 0, query: str | None = None) -> DataFrame:
    """A page of sessions with usage, kinds and `total`, the number under the filter. A query puts the best matches first."""
    s = with_kinds(t, with_tokens(t, apply(t, f).select(*LISTED)))
    if query:
        best = ranked_turns(t.turns, query).groupBy(F.col("session_id").alias("_s")).agg(F.max("rank").alias("rank"))
        s = s.join(best, s["id"] == best["_s"]).drop("_s")
    col, desc = _sort(sort)
    desc = desc if descending is None else descending
    keys = [F.desc("rank")] if query else [col.desc_nulls_last() if desc else col.asc_nulls_last()]
    total = s.select("id").groupBy(F.lit(1).alias("_1")).agg(F.count("*").alias("total"))
    s = s.withColumn("_1", F.lit(1)).join(F.broadcast(total), "_1").drop("_1")  # one row; before the sort, which comes last
    return s.orderBy(*keys, F.desc("started_at"), "id").offset(offset).limit(_list_limit(limit))


def with_session_cost(t: Tables, s: DataFrame) -> DataFrame:
    """s, which has usage, with the cost of each session at its start; null where it isn't measured or has no rates."""
    return with_cost(s, "model", F.col("started_at"), out="cost_nano")


#: The sizes a page of a list can have, and the one that stands for others.
PAGE_SIZES, PAGE_SIZE = (25, 50, 100, 200), 50


def page_of(total: int, page: int = 1, size: int = PAGE_SIZE) -> tuple[int, int, int, int]:
    """(page, pages, limit, offset): a size that is none of PAGE_SIZES means the usual one; a page out of range the nearest; there is always one page."""
    size = size if size in PAGE_SIZES else PAGE_SIZE
    pages = max(1, -(-total // size))
    page = min(max(page, 1), pages)
    return page, pages, size, (page - 1) * size


def by_cost(t: Tables, f: SessionFilter | None = None, descending: bool = True, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of single sessions by cost, in either direction; those without a cost last, then by start in the same direction."""
    s = with_session_cost(t, with_tokens(t, apply(t, f))).select(*LISTED, "measured", "cost_nano")
    return _cost_page(s, descending, limit, offset)


def _cost_page(s: DataFrame, descending: bool, limit: int | None, offset: int) -> DataFrame:
    cost, start = F.col("cost_nano"), F.col("started_at")
    s = s.orderBy(cost.desc_nulls_last() if descending else cost.asc_nulls_last(), start.desc() if descending else start.asc(), "id")
    return s.offset(offset).limit(_list_limit(limit)) if limit is not None or offset else s


def grouped_feed(t: Tables, f: SessionFilter | None = None, descending: bool = True, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Top-level sessions with their children's number and cost, most costly first or last, those without a cost last; a page where one is asked for."""
    s = with_session_cost(t, with_tokens(t, apply(t, f)))
    kids = s.where("parent_session_id is not null").groupBy(F.col("parent_session_id").alias("_p")).agg(F.count("*").alias("children"), F.sum("cost_nano").alias("children_cost"))
    top = s.where("parent_session_id is null").join(kids, F.col("id") == F.col("_p"), "left")
    own, sub = F.col("cost_nano"), F.col("children_cost")
    cost = F.when(own.isNotNull() | sub.isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce(sub, F.lit(0)))
    out = top.select("id", "agent", "started_at", F.coalesce("children", F.lit(0)).alias("children"), own.alias("own_cost_nano"), cost.alias("cost_nano"))
    return _cost_page(out, descending, limit, offset)


def children(t: Tables, parent: str) -> DataFrame:
    """(…, n, of, previous, next): the children of a session by their start, each with its neighbours."""
    w = Window.partitionBy("parent_session_id").orderBy("started_at", "id")
    c = t.sessions.where(F.col("parent_session_id") == parent)
    return c.select(*LISTED, F.row_number().over(w).alias("n"), F.count("*").over(Window.partitionBy("parent_session_id")).alias("of"), F.lag("id").over(w).alias("previous"), F.lead("id").over(w).alias("next"))


def sibling_pager(t: Tables) -> DataFrame:
    """(id, parent, n, of, previous, next) for every child at once."""
    w = Window.partitionBy("parent_session_id").orderBy("started_at", "id")
    c = t.sessions.where("parent_session_id is not null")
    return c.select("id", F.col("parent_session_id").alias("parent"), F.row_number().over(w).alias("n"), F.count("*").over(Window.partitionBy("parent_session_id")).alias("of"), F.lag("id").over(w).alias("previous"), F.lead("id").over(w).alias("next"))


def session_detail(t: Tables, first: int | None = None, last: int | None = None) -> DataFrame:
    """(id, turns, messages, tool_calls, top_tools) of every session; first, last: a window of turns by place."""
    turns = t.turns
    if first is not None or last is not None:
        n = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "id"))
        turns = turns.withColumn("_n", n).where(F.col("_n").between(first or 1, last or 2**31 - 1)).drop("_n")
    c = turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.count_if(~F.col("kind").isin("tool_result", "thinking")).alias("messages"))
    tools = t.tools.groupBy("session_id").agg(F.sum("count").alias("tool_calls"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("m"), "name"))), 1, 3).alias("_t"))
    s = t.sessions.select("id").join(c, F.col("id") == c["session_id"], "left").drop("session_id").join(tools, F.col("id") == tools["session_id"], "left")
    top = F.array_join(F.transform("_t", lambda x: F.concat(x["name"], F.lit(" ×"), (-x["m"]).cast("string"))), ", ")
    return s.select("id", F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"), F.coalesce(top, F.lit("")).alias("top_tools"))


def manifest(t: Tables, after: str = "", limit: int = 5000) -> DataFrame:
    """A page of (id, raw_hash, projection_version) by id; more than 5000 means 5000."""
    s = t.sessions.select("id", "raw_hash")
    if t.ledger is not None:
        l = t.ledger.select(F.col("session_id").alias("id"), F.col("raw_hash").alias("_h"), "projection_version")
        s = s.join(l, "id", "left").select("id", F.coalesce("_h", "raw_hash").alias("raw_hash"), F.coalesce("projection_version", F.lit(0)).alias("projection_version"))
    else:
        s = s.withColumn("projection_version", F.lit(0))
    return s.where(F.col("id") > after).orderBy("id").limit(min(limit, 5000) if limit > 0 else 5000)


def reconcile(local: DataFrame, remote: DataFrame, version: int, overwrite: bool = False) -> DataFrame:
    """(id, reason) of local sessions that the remote lacks, has with another hash, or has from an older projection."""
    rm = remote.select(F.col("id").alias("_id"), F.col("raw_hash").alias("_h"), F.col("projection_version").alias("_v"))
    j = local.join(rm, F.col("id") == F.col("_id"), "left")
    why = F.when(F.col("_id").isNull(), "missing").when(~F.col("_h").eqNullSafe(F.col("raw_hash")), "changed").when(F.coalesce("_v", F.lit(0)) < version, "stale")
    why = why.otherwise(F.lit("overwrite") if overwrite else F.lit(None).cast("string"))
    return j.select("id", why.alias("reason")).where("reason is not null")


def orphans(t: Tables) -> DataFrame:
    """(parent, children): parents that were never taken in."""
    kids = t.sessions.where("parent_session_id is not null").groupBy(F.col("parent_session_id").alias("parent")).agg(F.count("*").alias("children"))
    return kids.join(t.sessions.select(F.col("id").alias("parent")), "parent", "left_anti")


def devices(t: DataFrame) -> DataFrame:
    """Devices by when their fingerprint was taken, the latest first, those without one last."""
    return t.orderBy(F.col("fingerprinted_at").desc_nulls_last(), "id")


def slots(t: Tables, s: DataFrame, scoped: bool = False) -> DataFrame:
    """(device, project, device_id, project_label): whether a list of sessions needs the columns device and project, and what all rows have where it doesn't.

    scoped: the list is of one project, which is named elsewhere.
    """
    label = F.coalesce("project_remote", "project_marker", "project_path", F.lit("(unscoped)"))
    a = s.agg(F.count_distinct("device_id").alias("d"), F.count_distinct(label).alias("p"), F.min("device_id").alias("device_id"), F.min(label).alias("label"))
    return a.select(
        (F.col("d") > 1).alias("device"), ((F.col("p") > 1) & F.lit(not scoped)).alias("project"), F.when(F.col("d") == 1, F.col("device_id")).alias("device_id"),
        F.when((F.col("p") == 1) & (F.col("label") != "(unscoped)"), F.col("label")).alias("project_label"),
    )


def device_counts(t: Tables) -> DataFrame:
    n = t.sessions.groupBy("device_id").agg(F.count("*").alias("n"))
    return t.devices.join(n, t.devices["id"] == n["device_id"], "left").select("id", "friendly_name", F.coalesce("n", F.lit(0)).alias("sessions"))


