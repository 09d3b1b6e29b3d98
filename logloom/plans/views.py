"""Views: what is drawn from the reports. Each returns a DataFrame; percentages and levels are numbers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import with_cost
from ..operators.filters import SessionFilter
from ..schema import TOKENS, Tables
from . import reports as r

OTHER = "other"
TOP = 7

def _all():
    """Over the rows of a report: few, whatever the number of sessions."""
    return Window.partitionBy()


def bar_percent(n: Column, most: Column, floor: int = 3) -> Column:
    """Share of the largest, rounded up, `floor` at least; 0 for nothing."""
    return F.when((n > 0) & (most > 0), F.greatest(F.lit(floor).cast("long"), F.floor((n * 100 + most - 1) / most))).otherwise(F.lit(0).cast("long"))


def heat_level(n: Column, most: Column) -> Column:
    return F.when((n > 0) & (most > 0), F.least(F.floor((n * 4 + most - 1) / most), F.lit(4).cast("long"))).otherwise(F.lit(0).cast("long"))


def beside(df: DataFrame, **aggregates: Column) -> DataFrame:
    """df with aggregates of all of its rows beside each: one row, broadcast, so that no task gets all rows."""
    one = df.agg(F.lit(1).alias("_1"), *[c.alias(n) for n, c in aggregates.items()])
    return df.withColumn("_1", F.lit(1)).join(F.broadcast(one), "_1", "left").drop("_1")


def bars(df: DataFrame, label: str, count: str = "sessions") -> DataFrame:
    return beside(df, _most=F.max(count)).select(F.col(label).alias("label"), F.col(count).alias("count"), bar_percent(F.col(count), F.col("_most")).alias("percent"))


def week(day: Column) -> Column:
    """The week's Monday, a date, so that windows across a new year stay in order."""
    return F.trunc(F.to_date(day), "week")


def top_and_other(df: DataFrame, name: str, by: str, top: int = TOP) -> DataFrame:
    """df with `name` replaced by 'other' for all but the `top` names of the largest sums, ties by name."""
    keep = df.groupBy(name).agg(F.sum(by).alias("_sum")).orderBy(F.desc("_sum"), name).limit(top).select(F.col(name).alias("_name"))
    return df.join(F.broadcast(keep), F.col(name) == F.col("_name"), "left").withColumn(name, F.coalesce("_name", F.lit(OTHER))).drop("_name")


def percent_change(now: Column, before: Column) -> Column:
    """Whole percent, half away from zero; null where there was nothing before."""
    return F.when(before != 0, F.round((now - before) / before * 100).cast("long"))


# -- dashboard ---------------------------------------------------------------------------------


def previous(f: SessionFilter) -> SessionFilter:
    """The window of the same length that ends where this one starts; the boundary instant is in both."""
    return replace(f, since=f.since - (f.until - f.since), until=f.since)


def _totals(t: Tables, f: SessionFilter) -> DataFrame:
    g = r.usage(t, f)
    return g.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("sessions", "sessions"), ("total", "tokens"), ("est_cost_nano_usd", "cost_nano"))])


def kpis(t: Tables, f: SessionFilter) -> DataFrame:
    """(kpi, now, before, change_pct)."""
    both = _totals(t, f).withColumn("w", F.lit("now")).union(_totals(t, previous(f)).withColumn("w", F.lit("before")))
    long = both.select("w", F.explode(F.create_map(*[x for c in ("sessions", "tokens", "cost_nano") for x in (F.lit(c), F.col(c))])).alias("kpi", "v"))
    g = long.groupBy("kpi").agg(F.max(F.when(F.col("w") == "now", F.col("v"))).alias("now"), F.max(F.when(F.col("w") == "before", F.col("v"))).alias("before"))
    return g.withColumn("change_pct", percent_change(F.col("now"), F.col("before")))


def agent_bars(t: Tables, f: SessionFilter) -> DataFrame:
    return bars(r.sessions(t, f), "agent")


def tool_bars(t: Tables, f: SessionFilter) -> DataFrame:
    return bars(r.tools(t, f), "tool", "uses")


def heatmap_grid(t: Tables, f: SessionFilter) -> DataFrame:
    """(date, sessions, level, column, row, month_band): Sunday-first columns; a new band where a column's first day is of another month."""
    d = r.heatmap(t, f).groupBy("date").agg(F.sum("sessions").alias("sessions"))
    first = F.min(F.to_date("date")).over(_all())
    start = F.date_sub(first, F.dayofweek(first) - 1)
    g = d.withColumn("column", F.floor(F.datediff(F.to_date("date"), start) / 7).cast("int")).withColumn("row", F.dayofweek(F.to_date("date")) - 1)
    g = g.withColumn("level", heat_level(F.col("sessions"), F.max("sessions").over(_all())))
    return g.withColumn("month_band", F.min(F.date_format(F.to_date("date"), "yyyy-MM")).over(Window.partitionBy("column"))).select("date", "sessions", "level", "column", "row", "month_band")


def usage_table(t: Tables, f: SessionFilter) -> DataFrame:
    """Agents that used tokens, with their share of the largest."""
    return r.usage(t, f).where("total <> 0").withColumn("percent", bar_percent(F.col("total"), F.max("total").over(_all())))


def project_bars(t: Tables, f: SessionFilter, top: int = 10) -> DataFrame:
    return bars(r.projects(t, f).groupBy("project").agg(F.sum("sessions").alias("sessions")).orderBy(F.desc("sessions"), "project").limit(top), "project")


def model_board(t: Tables, f: SessionFilter, top: int = 8) -> DataFrame:
    """Models by tokens with the whole percent of all tokens, rounded down."""
    g = r.usage_by_model(t, f).withColumn("percent", F.floor(F.col("total") * 100 / F.sum("total").over(_all())))
    return g.orderBy(F.desc("total"), "model").limit(top)


def hour_chart(t: Tables, f: SessionFilter, offset_hours: int = 0) -> DataFrame:
    """(hour, sessions, peak): all 24 local hours; the first of the largest is the peak."""
    local = r.hours(t, f).select(F.pmod(F.col("hour").cast("int") + offset_hours, F.lit(24)).alias("hour"), "sessions")
    spine = t.sessions.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    full = spine.join(local.groupBy("hour").agg(F.sum("sessions").alias("sessions")), "hour", "left").select("hour", F.coalesce("sessions", F.lit(0)).alias("sessions"))
    first = F.row_number().over(Window.partitionBy().orderBy(F.desc("sessions"), "hour"))
    return full.withColumn("peak", (first == 1) & (F.col("sessions") > 0))


def issues(t: Tables, f: SessionFilter) -> DataFrame:
    """(flagged, sessions, rate_pct, top_model): one row."""
    by = r.errors_by_model(t, f).agg(F.coalesce(F.sum("sessions"), F.lit(0)).alias("flagged"), F.max_by("model", F.struct("sessions", "model")).alias("top_model"))
    all_ = r.sessions(t, f).agg(F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"))
    both = by.select("flagged", "top_model", F.lit(0).cast("long").alias("sessions")).union(all_.select(F.lit(0).cast("long"), F.lit(None).cast("string"), "sessions"))
    one = both.agg(F.sum("flagged").alias("flagged"), F.sum("sessions").alias("sessions"), F.max("top_model").alias("top_model"))
    return one.withColumn("rate_pct", F.round(F.col("flagged") * 100 / F.nullif("sessions", F.lit(0)), 1))


WEEKLY_OVER_DAYS = 120


def _bucket(f: SessionFilter, day: Column) -> Column:
    return week(day) if (f.until.date() - f.since.date()).days + 1 > WEEKLY_OVER_DAYS else F.to_date(day)


def activity_trend(t: Tables, f: SessionFilter, top: int = TOP) -> DataFrame:
    """(bucket, agent, sessions): days, or weeks in long windows; the busiest agents and 'other'; empty buckets have agent ''."""
    return _trend(t, f, r.heatmap(t, f).where("agent <> ''").select("date", "agent", "sessions"), top)


def _trend(t: Tables, f: SessionFilter, counts: DataFrame, top: int) -> DataFrame:
    """counts: (date, agent, sessions)."""
    named = top_and_other(counts, "agent", "sessions", top).select(_bucket(f, F.col("date")).alias("bucket"), "agent", "sessions")
    per = named.groupBy("bucket", "agent").agg(F.sum("sessions").alias("sessions"))
    spine = r.day_span(t.sessions, f).select(_bucket(f, F.col("date")).alias("bucket")).distinct()
    return spine.join(per, "bucket", "left").select("bucket", F.coalesce("agent", F.lit("")).alias("agent"), F.coalesce("sessions", F.lit(0)).alias("sessions"))


# -- insights ----------------------------------------------------------------------------------


def _priced_days(t: Tables, f: SessionFilter, extra: dict | None = None) -> DataFrame:
    keys = {"day": r.day(), "model": r.model()} | (extra or {})
    return r._priced(t, f, keys)


def spend_trend(t: Tables, f: SessionFilter) -> DataFrame:
    """(bucket, cost_nano, tokens, cost_pct, tokens_pct): each as a share of its own peak."""
    g = _priced_days(t, f).groupBy(_bucket(f, F.col("day")).alias("bucket")).agg(F.sum("cost_nano").alias("c"), F.sum("total_tokens").alias("n"))
    spine = r.day_span(t.sessions, f).select(_bucket(f, F.col("date")).alias("bucket")).distinct()
    full = spine.join(g, "bucket", "left").select("bucket", F.coalesce("c", F.lit(0)).alias("cost_nano"), F.coalesce("n", F.lit(0)).alias("tokens"))
    share = lambda c: F.coalesce(F.round(F.col(c) * 100.0 / F.nullif(F.max(c).over(_all()), F.lit(0)), 4), F.lit(0.0))
    return full.withColumns({"cost_pct": share("cost_nano"), "tokens_pct": share("tokens")})


def model_share(t: Tables, f: SessionFilter, top: int = TOP) -> DataFrame:
    """(week, model, tokens, percent of the week's)."""
    g = top_and_other(r.usage_by_day(t, f).select("day", "model", F.col("total").alias("tokens")), "model", "tokens", top)
    g = g.groupBy(week(F.col("day")).alias("week"), "model").agg(F.sum("tokens").alias("tokens"))
    return g.withColumn("percent", F.round(F.col("tokens") * 100.0 / F.nullif(F.sum("tokens").over(Window.partitionBy("week")), F.lit(0)), 4))


def punchcard_grid(t: Tables, f: SessionFilter, offset_hours: int = 0) -> DataFrame:
    """(dow, hour, sessions, level): all 168 cells in local time; an hour that leaves its day takes the weekday along."""
    p = r.punchcard(t, f).withColumn("_h", F.col("hour").cast("int") + offset_hours)
    carry = F.when(F.col("_h") >= 24, 1).when(F.col("_h") < 0, -1).otherwise(0)
    local = p.select(F.pmod(F.col("dow") + carry, F.lit(7)).alias("dow"), F.pmod("_h", F.lit(24)).alias("hour"), "sessions").groupBy("dow", "hour").agg(F.sum("sessions").alias("sessions"))
    spine = t.sessions.sparkSession.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    full = spine.join(local, ["dow", "hour"], "left").select("dow", "hour", F.coalesce("sessions", F.lit(0)).alias("sessions"))
    return full.withColumn("level", heat_level(F.col("sessions"), F.max("sessions").over(_all())))


def schedule_kpis(t: Tables, f: SessionFilter, offset_hours: int = 0) -> DataFrame:
    """(weekend_pct, off_hours_pct, busiest_dow): off hours are outside 9 to 18; the first of the busiest days."""
    g = punchcard_grid(t, f, offset_hours)
    days = g.groupBy("dow").agg(F.sum("sessions").alias("n"), F.sum(F.when((F.col("hour") < 9) | (F.col("hour") >= 18), F.col("sessions")).otherwise(0)).alias("off"))
    pct = lambda c: F.round(c * 100 / F.nullif(F.sum("n"), F.lit(0))).cast("long")
    return days.agg(pct(F.sum(F.when(F.col("dow").isin(0, 6), F.col("n")).otherwise(0))).alias("weekend_pct"), pct(F.sum("off")).alias("off_hours_pct"), F.max_by("dow", F.struct("n", -F.col("dow"))).alias("busiest_dow"))


def streaks(t: Tables, f: SessionFilter) -> DataFrame:
    """(current, longest, active_days, days, active_pct). The current run may end on the window's last day or the day before."""
    d = r.heatmap(t, f).groupBy(F.to_date("date").alias("day")).agg(F.sum("sessions").alias("n"))
    on = d.where("n > 0").withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy().orderBy("day"))))
    runs = on.groupBy("island").agg(F.count("*").alias("length"), F.max("day").alias("end"))
    last = F.lit(f.until.date())
    one = runs.agg(F.coalesce(F.max(F.when(F.col("end") >= F.date_sub(last, 1), F.col("length"))), F.lit(0)).alias("current"), F.coalesce(F.max("length"), F.lit(0)).alias("longest"), F.coalesce(F.sum("length"), F.lit(0)).alias("active_days"))
    days = (f.until.date() - f.since.date()).days + 1
    return one.withColumn("days", F.lit(days).cast("long")).withColumn("active_pct", F.round(F.col("active_days") * 100 / days).cast("long"))


def _dimension(t: Tables, names: list[str]) -> DataFrame:
    return t.sessions.sparkSession.createDataFrame(list(enumerate(names)), "position int, bucket string")


def durations_card(t: Tables, f: SessionFilter) -> DataFrame:
    """(position, bucket, sessions, percent): all buckets, in order."""
    full = _dimension(t, [b for _, b in r.BUCKETS]).join(r.durations(t, f), "bucket", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))
    return full.select("position", "bucket", "sessions", bar_percent(F.col("sessions"), F.max("sessions").over(_all())).alias("percent"))


def kind_bars(t: Tables, f: SessionFilter) -> DataFrame:
    return bars(r.session_kinds(t, f), "kind")


def subagent_totals(t: Tables, f: SessionFilter) -> DataFrame:
    return r.subagents(t, f).agg(*[F.coalesce(fn(c), F.lit(0)).alias(c) for c, fn in (("parents", F.sum), ("children", F.sum), ("max_fanout", F.max))])


def _kind() -> Column:
    return F.when(F.col("parent_session_id").isNull(), "direct").otherwise("subagent")


def delegation_kpis(t: Tables, f: SessionFilter) -> DataFrame:
    """(spawning, children, max_fanout, delegated_pct, subagent_cost_nano): one row."""
    u = _priced_days(t, f, {"kind": _kind()})
    sub = F.col("kind") == "subagent"
    a = u.agg(F.sum(F.when(sub, F.col("total_tokens"))).alias("s"), F.sum("total_tokens").alias("n"), F.sum(F.when(sub, F.col("cost_nano"))).alias("c"))
    a = a.select(F.round(F.coalesce("s", F.lit(0)) * 100 / F.nullif("n", F.lit(0))).cast("long").alias("delegated_pct"), F.col("c").alias("subagent_cost_nano"))
    b = r.subagent_parents(t, f).agg(F.count("*").alias("spawning"), F.coalesce(F.sum("children"), F.lit(0)).alias("children"), F.coalesce(F.max("children"), F.lit(0)).alias("max_fanout"))
    on = F.lit(1).alias("_1")
    return b.select("*", on).join(F.broadcast(a.select("*", on)), "_1").drop("_1")


def delegation_trend(t: Tables, f: SessionFilter) -> DataFrame:
    """(week, delegated_pct): share of the week's tokens that subagents used; 0 for a week without tokens."""
    g = r.subagent_usage_by_day(t, f).groupBy(week(F.col("day")).alias("week")).agg(F.sum(F.when(F.col("kind") == "subagent", F.col("total")).otherwise(0)).alias("s"), F.sum("total").alias("n"))
    return g.select("week", F.coalesce(F.round(F.col("s") * 100.0 / F.nullif("n", F.lit(0)), 4), F.lit(0.0)).alias("delegated_pct"))


#: Buckets of the number of children.
FANOUT = ["1", "2", "3-4", "5-8", "9+"]


def fanout_histogram(t: Tables, f: SessionFilter) -> DataFrame:
    c = F.col("children")
    bucket = F.when(c == 1, "1").when(c == 2, "2").when(c <= 4, "3-4").when(c <= 8, "5-8").otherwise("9+")
    g = r.subagent_parents(t, f).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("sessions"))
    full = _dimension(t, FANOUT).join(g, "bucket", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))
    return full.select("position", "bucket", "sessions", bar_percent(F.col("sessions"), F.max("sessions").over(_all())).alias("percent"))


def top_delegators(t: Tables, f: SessionFilter, top: int = 8) -> DataFrame:
    return r.subagent_parents(t, f).limit(top)


def across_the_day(t: Tables, f: SessionFilter, offset_hours: int = 0, top: int = TOP) -> DataFrame:
    """(hour, model, sessions, tokens) in local hours, the models of most sessions and 'other'."""
    g = top_and_other(r.usage_by_hour(t, f).select("hour", "model", "sessions", F.col("total").alias("tokens")), "model", "sessions", top)
    return g.groupBy(F.pmod(F.col("hour").cast("int") + offset_hours, F.lit(24)).alias("hour"), "model").agg(F.sum("sessions").alias("sessions"), F.sum("tokens").alias("tokens"))


def profile_board(t: Tables, f: SessionFilter) -> DataFrame:
    """(device, agent, profile, sessions, tokens, cost_nano, last_activity), priced by day and model, then summed."""
    g = r.profile_usage(t, f)
    g = g.select(*[c for c in g.columns if c not in {x.removesuffix("_tokens") for x in TOKENS}], *[F.col(c.removesuffix("_tokens")).alias(c) for c in TOKENS])
    g = with_cost(g, "model", F.to_date("day")).withColumn("cost_nano", F.when(F.col("measured") > 0, F.col("cost_nano")))
    return g.groupBy("device", "agent", "profile").agg(F.sum("sessions").alias("sessions"), F.sum("total_tokens").alias("tokens"), F.sum("cost_nano").alias("cost_nano"), F.max("last_activity").alias("last_activity"))


def profile_table(t: Tables, f: SessionFilter, default: str = "default") -> DataFrame:
    """(profiles, sessions, tokens, cost_nano, other_percent): one row above the board; other_percent is the share of sessions that are not of the default profile."""
    b = profile_board(t, f)
    other = F.coalesce(F.sum(F.when(F.col("profile") != default, F.col("sessions"))), F.lit(0))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sessions", "tokens")]
    return b.agg(F.count("*").alias("profiles"), *sums, F.sum("cost_nano").alias("cost_nano"), F.round(other * 100.0 / F.nullif(F.sum("sessions"), F.lit(0)), 4).alias("other_percent"))


def profile_bars(t: Tables, f: SessionFilter, top: int = 8) -> DataFrame:
    """(label, tokens, cost_nano, percent) of agents' profiles, whatever the device, those of most tokens."""
    label = F.concat("agent", F.lit("·"), "profile")
    g = profile_board(t, f).groupBy(label.alias("label")).agg(F.sum("tokens").alias("tokens"), F.sum("cost_nano").alias("cost_nano"))
    g = beside(g, _most=F.max("tokens")).select("label", "tokens", "cost_nano", bar_percent(F.col("tokens"), F.col("_most")).alias("percent"))
    return g.orderBy(F.desc("tokens"), "label").limit(top)


def profile_trend(t: Tables, f: SessionFilter, top: int = TOP) -> DataFrame:
    """(bucket, agent, sessions) as the activity trend, agents by their profiles ("codex·work")."""
    return _trend(t, f, r.profiles_by_day(t, f).select(F.col("day").alias("date"), F.concat("agent", F.lit("·"), "profile").alias("agent"), "sessions"), top)


def project_board(t: Tables, f: SessionFilter) -> DataFrame:
    g = r.projects(t, f).groupBy("project").agg(F.sum("sessions").alias("sessions"))
    return beside(g, _sum=F.sum("sessions")).withColumn("percent", F.round(F.col("sessions") * 100.0 / F.col("_sum"), 4)).drop("_sum")


def filter_options(t: Tables) -> DataFrame:
    """(kind, value): distinct projects, profiles and devices."""
    p = t.sessions.select(F.lit("project").alias("kind"), r.project().alias("value")).distinct()
    q = t.sessions.select(F.lit("profile").alias("kind"), F.col("profile").alias("value")).distinct()
    d = r.with_device(t, t.sessions).select(F.lit("device").alias("kind"), F.col("device").alias("value")).distinct()
    return p.union(q).union(d)


# -- transcripts -------------------------------------------------------------------------------

DIVIDER_SECONDS = 30


def transcript(turns: DataFrame) -> DataFrame:
    """(session_id, position, kind, turns, summary, gap_seconds): runs of tool and of thinking turns are one group each,
    other turns stand alone; a pause of 30 seconds or more ends a run, and the group after it carries the pause.

    A session's turns are put in order in one task: a session is the unit, and is as long as one history.
    """
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    before = F.last("ts", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    what = F.when(F.col("kind") == "thinking", "thinking-group").when(F.col("role") == "tool", "tool-group").otherwise("single")
    a = turns.withColumn("_what", what).withColumn("_b", before).withColumn("_gap", F.expr("timestampdiff(MICROSECOND, _b, ts)") / F.lit(1e6))
    pause = F.coalesce(F.col("_gap") >= DIVIDER_SECONDS, F.lit(False))
    a = a.withColumn("_pause", pause).withColumn("_new", (F.col("_what") == "single") | pause | F.coalesce(F.lag("_what").over(w) != F.col("_what"), F.lit(True)))
    a = a.withColumn("position", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    names = a.groupBy("session_id", "position", F.col("_what").alias("kind"), F.coalesce(F.nullif("tool_name", F.lit("")), F.lit("tool")).alias("name")).agg(F.count("*").alias("n"), F.max(F.when(F.col("_pause"), F.col("_gap"))).alias("gap"))
    g = names.groupBy("session_id", "position", "kind").agg(F.sum("n").alias("turns"), F.max("gap").alias("gap_seconds"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "name"))).alias("_names"))
    tools = F.array_join(F.transform("_names", lambda x: F.concat(x["name"], F.lit(" ×"), (-x["m"]).cast("string"))), " · ")
    steps = F.when(F.col("turns") > 1, F.concat(F.lit("Processed ("), F.col("turns").cast("string"), F.lit(" steps)"))).otherwise("Processed")
    return g.select("session_id", "position", "kind", "turns", F.when(F.col("kind") == "tool-group", tools).when(F.col("kind") == "thinking-group", steps).alias("summary"), "gap_seconds")


VIEWS = {
    f.__name__: f
    for f in (
        kpis, agent_bars, tool_bars, heatmap_grid, usage_table, project_bars, model_board, hour_chart, issues, activity_trend, spend_trend, model_share, punchcard_grid, schedule_kpis, streaks,
        durations_card, kind_bars, subagent_totals, delegation_kpis, delegation_trend, fanout_histogram, top_delegators, across_the_day, profile_board, profile_table, profile_bars, profile_trend, project_board,
    )
}

