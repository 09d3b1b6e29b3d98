"""The analytics reports. Each takes the canonical tables and a filter and returns a DataFrame; days and hours are UTC."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import with_cost
from ..operators.filters import SessionFilter, apply
from ..operators.search import flagged_sessions
from ..schema import TOKENS, Tables


def day() -> Column:
    return F.date_format("started_at", "yyyy-MM-dd")


def hour() -> Column:
    return F.date_format("started_at", "HH")


def model() -> Column:
    return F.coalesce("model", F.lit("(none)"))


def project(alias: str = "") -> Column:
    p = f"{alias}." if alias else ""
    return F.coalesce(f"{p}project_remote", f"{p}project_marker", f"{p}project_path", F.lit("(unscoped)"))


def _count(name: str = "sessions") -> Column:
    return F.count("*").alias(name)


def with_usage(t: Tables, s: DataFrame) -> DataFrame:
    return s.join(t.usage, s["id"] == t.usage["session_id"], "left")


def usage_sums() -> list[Column]:
    """Sessions are unique, and a session has one usage row at most: no distinct count is needed."""
    return [_count(), F.count("session_id").alias("measured"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS]]


def _public(df: DataFrame, keys: list[str], cache: bool = True) -> DataFrame:
    short = {"total_tokens": "total", "input_tokens": "input", "output_tokens": "output", "cached_tokens": "cached", "cache_read_tokens": "cache_read", "cache_creation_tokens": "cache_creation"}
    return df.select(*keys, "sessions", "measured", *[F.col(c).alias(short[c]) for c in (TOKENS if cache else TOKENS[:4])])


def sessions(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    s = apply(t, f).select("id", "agent")
    turns = t.turns.groupBy("session_id").agg(F.count("*").alias("n"))
    j = s.join(turns, s["id"] == turns["session_id"], "left")
    return j.groupBy("agent").agg(_count(), F.coalesce(F.sum("n"), F.lit(0)).alias("turns")).orderBy(F.desc("sessions"), "agent")


def tools(t: Tables, f: SessionFilter | None = None, top: int = 20) -> DataFrame:
    s = apply(t, f).select("id")
    g = t.tools.join(s, t.tools["session_id"] == s["id"], "left_semi").groupBy(F.col("name").alias("tool"))
    return g.agg(F.sum("count").alias("uses"), _count()).orderBy(F.desc("uses"), "tool").limit(top)


def models(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    return apply(t, f).groupBy(model().alias("model")).agg(_count()).orderBy(F.desc("sessions"), "model")


def projects(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    return apply(t, f).groupBy(project().alias("project"), "agent").agg(_count()).orderBy(F.desc("sessions"), "project", "agent")


def with_device(t: Tables, s: DataFrame) -> DataFrame:
    d = t.devices.select(F.col("id").alias("_d"), F.nullif(F.col("friendly_name"), F.lit("")).alias("_n"))
    return s.join(d, s["device_id"] == d["_d"], "left").withColumn("device", F.coalesce("_n", "device_id")).drop("_d", "_n")


def profiles(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    return with_device(t, apply(t, f)).groupBy("device", "agent", "profile").agg(_count()).orderBy(F.desc("sessions"), "device", "agent", "profile")


def errors(t: Tables, f: SessionFilter | None = None, top: int = 30) -> DataFrame:
    s = apply(t, f)
    s = s.join(flagged_sessions(t.turns), s["id"] == F.col("session_id"), "left_semi")
    return s.orderBy(F.desc("started_at"), "id").limit(top).select(F.date_format("started_at", "yyyy-MM-dd HH:mm").alias("started"), "agent", project().alias("project"), F.col("id").alias("session"))


def day_span(s: DataFrame, f: SessionFilter) -> DataFrame:
    """(date) of each day of the window, as text."""
    days = F.sequence(F.lit(f.since).cast("date"), F.lit(f.until).cast("date"))
    return s.sparkSession.range(1).select(F.explode(days).alias("date")).select(F.date_format("date", "yyyy-MM-dd").alias("date"))


def heatmap(t: Tables, f: SessionFilter) -> DataFrame:
    per = apply(t, f).groupBy(day().alias("date"), "agent").agg(_count())
    full = F.broadcast(day_span(t.sessions, f)).join(per, "date", "left")
    return full.select("date", F.coalesce("agent", F.lit("")).alias("agent"), F.coalesce("sessions", F.lit(0)).alias("sessions")).orderBy("date", "agent")


def _priced(t: Tables, f: SessionFilter | None, keys: dict[str, Column], at: str = "day") -> DataFrame:
    g = with_usage(t, apply(t, f)).groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*usage_sums())
    cost = with_cost(g, "model", F.to_date(at))
    return cost.withColumn("cost_nano", F.when(F.col("measured") > 0, F.col("cost_nano")))


def usage(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    """Cost is that of each day, agent and model, then summed; null where nothing is priced."""
    g = _priced(t, f, {"day": day(), "agent": F.col("agent"), "model": F.coalesce("model", F.lit(""))}).groupBy("agent")
    out = g.agg(*[F.sum(c).alias(c) for c in ("sessions", "measured", *TOKENS)], F.sum("cost_nano").alias("cost_nano"))
    return _public_cost(out, ["agent"], ("measured", "total", "input", "output", "cached"))


def usage_by_model(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    g = _priced(t, f, {"day": day(), "model": model()}).groupBy("model")
    out = g.agg(*[F.sum(c).alias(c) for c in ("sessions", "measured", *TOKENS)], F.sum("cost_nano").alias("cost_nano"))
    return _public_cost(out, ["model"], ("total", "input", "output"))


def _public_cost(df: DataFrame, keys: list[str], cols: tuple[str, ...]) -> DataFrame:
    pick = [F.col(c if c == "measured" else f"{c}_tokens").alias(c) for c in cols]
    return df.select(*keys, "sessions", *pick, F.col("cost_nano").alias("est_cost_nano_usd")).orderBy(F.desc("sessions"), *keys)


def hours(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    return apply(t, f).groupBy(hour().alias("hour")).agg(_count()).orderBy("hour")


def errors_by_model(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    s = apply(t, f)
    s = s.join(flagged_sessions(t.turns), s["id"] == F.col("session_id"), "left_semi")
    return s.groupBy(model().alias("model")).agg(_count()).orderBy(F.desc("sessions"), "model")


def _usage_by(t: Tables, f: SessionFilter | None, keys: dict[str, Column]) -> DataFrame:
    g = with_usage(t, apply(t, f)).groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*usage_sums())
    return _public(g, list(keys)).orderBy(*keys)


def usage_by_day(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    return _usage_by(t, f, {"day": day(), "model": model()})


def usage_by_hour(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    return _usage_by(t, f, {"hour": hour(), "model": model()})


def subagent_usage_by_day(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    """A child counts as delegated whether or not its parent was taken in."""
    kind = F.when(F.col("parent_session_id").isNull(), "direct").otherwise("subagent")
    return _usage_by(t, f, {"day": day(), "kind": kind, "model": model()})


def _children(t: Tables, f: SessionFilter | None) -> DataFrame:
    """Number of a parent's children that the filter leaves; children without a known parent drop out in the join."""
    return apply(t, f).where("parent_session_id is not null").groupBy(F.col("parent_session_id").alias("_p")).agg(F.count("*").alias("children"))


def subagent_parents(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    p = t.sessions.join(_children(t, f), F.col("id") == F.col("_p"))
    return p.orderBy(F.desc("children"), F.desc("started_at"), "id").select(F.date_format("started_at", "yyyy-MM-dd HH:mm").alias("started"), "agent", project().alias("project"), F.col("id").alias("session"), "children")


def subagents(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    g = t.sessions.select("id", "agent").join(_children(t, f), F.col("id") == F.col("_p")).groupBy("agent")
    return g.agg(F.count("*").alias("parents"), F.sum("children").alias("children"), F.max("children").alias("max_fanout")).orderBy(F.desc("children"), "agent")


def session_kinds(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    s = apply(t, f).select(F.col("id").alias("session_id"))
    return t.kinds.distinct().join(s, "session_id", "left_semi").groupBy("kind").agg(_count()).orderBy(F.desc("sessions"), "kind")


def profile_usage(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    s = with_usage(t, with_device(t, apply(t, f)))
    keys = {"day": day(), "device": F.col("device"), "agent": F.col("agent"), "profile": F.col("profile"), "model": model()}
    g = s.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*usage_sums(), F.date_format(F.max("last_activity_at"), "yyyy-MM-dd HH:mm").alias("last_activity"))
    short = [F.col(c).alias(c.removesuffix("_tokens")) for c in TOKENS]
    return g.select(*keys, "sessions", "measured", *short, "last_activity").orderBy(*keys)


def profiles_by_day(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    return apply(t, f).groupBy(day().alias("day"), "agent", "profile").agg(_count()).orderBy("day", "agent", "profile")


def punchcard(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    """dow: 0 is Sunday."""
    return apply(t, f).groupBy((F.dayofweek("started_at") - 1).alias("dow"), hour().alias("hour")).agg(_count()).orderBy("dow", "hour")


def seconds() -> Column:
    return F.greatest(F.expr("timestampdiff(MICROSECOND, started_at, last_activity_at)") / F.lit(1e6), F.lit(0.0))


#: The upper end in seconds, not included, and the name of each bucket of session lengths.
BUCKETS = ((300, "<5m"), (900, "5-15m"), (1800, "15-30m"), (3600, "30-60m"), (7200, "1-2h"), (None, ">2h"))


def durations(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    bucket = F.lit(BUCKETS[-1][1])
    for most, name in reversed(BUCKETS[:-1]):
        bucket = F.when(F.col("d") < most, name).otherwise(bucket)
    return apply(t, f).select(seconds().alias("d")).groupBy(bucket.alias("bucket")).agg(_count()).orderBy("bucket")


def duration_stats(t: Tables, f: SessionFilter | None = None) -> DataFrame:
    """Whole seconds; zeros for an empty window. Percentiles are exact, between the two sessions around their place.

    Lengths are counted in a shuffle, microseconds within each second and these within the window: no task holds all of them, but only the
    number of sessions of each length in whole seconds.
    """
    whole = lambda c: F.coalesce(F.round(c).cast("long"), F.lit(0))
    d = apply(t, f).select(seconds().alias("d"))
    each = d.groupBy(F.floor("d").alias("s")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select("s", F.coalesce(before, F.lit(0)).alias("before"), "n", F.sum("n").over(Window.partitionBy()).alias("all"))
    place = lambda p: p * (F.col("all") - 1)
    near = reduce(or_, [(F.col("before") <= at(place(p))) & (at(place(p)) < F.col("before") + F.col("n")) for p in (0.5, 0.9) for at in (F.floor, F.ceil)])
    few = each.where(near).select(F.col("s").alias("_s"), "before", "all")  # four rows at most
    lengths = d.join(F.broadcast(few), F.floor("d") == F.col("_s")).groupBy("_s", "before", "all", "d").agg(F.count("*").alias("n"))  # a million to a second at most
    first_ = F.col("before") + F.coalesce(F.sum("n").over(Window.partitionBy("_s").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = lengths.withColumn("first", first_)
    nth = lambda k: F.max(F.when((F.col("first") <= k) & (k < F.col("first") + F.col("n")), F.col("d")))
    picked = lengths.agg(F.first("all").alias("all"), *[nth(at(place(p))).alias(f"{at.__name__}{int(10 * p)}") for p in (0.5, 0.9) for at in (F.floor, F.ceil)])
    of = lambda p: F.col(f"floor{int(10 * p)}") + (F.col(f"ceil{int(10 * p)}") - F.col(f"floor{int(10 * p)}")) * (place(p) - F.floor(place(p)))
    percentiles = picked.select(whole(of(0.5)).alias("median_s"), whole(of(0.9)).alias("p90_s"), F.lit(1).alias("_1"))
    rest = d.agg(whole(F.avg("d")).alias("avg_s"), whole(F.max("d")).alias("max_s"), F.lit(1).alias("_1"))
    return percentiles.join(F.broadcast(rest), "_1").select("median_s", "p90_s", "avg_s", "max_s")


REPORTS = {
    f.__name__: f
    for f in (
        sessions, tools, models, projects, profiles, errors, heatmap, usage, hours, errors_by_model, usage_by_model, usage_by_day, usage_by_hour, subagent_usage_by_day,
        subagent_parents, subagents, session_kinds, profile_usage, profiles_by_day, punchcard, durations, duration_stats,
    )
}


def report(name: str, t: Tables, f: SessionFilter) -> DataFrame:
    """A report by name; the window must be given."""
    if name not in REPORTS:
        raise ValueError(f"unknown report {name!r}")
    if f.since is None or f.until is None:
        raise ValueError("since and until are required")
    return REPORTS[name](t, f)


def to_report_rows(df: DataFrame) -> DataFrame:
    """All cells as text, null as empty."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
