"""Session filters: windows, projects, agents, devices, kinds."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_prompt, starts_as_boilerplate
from ..schema import Tables


@dataclass(frozen=True)
class SessionFilter:
    """Both ends of the window are inclusive. Lists match any; project_match looks for text in path, remote or marker, to the letter."""

    since: datetime | None = None
    until: datetime | None = None
    project_path: str | None = None
    project_remote: str | None = None
    project_marker: str | None = None
    project_match: tuple[str, ...] = ()
    agents: tuple[str, ...] = ()
    profiles: tuple[str, ...] = ()
    device: str | None = None  # id or friendly name
    kinds: tuple[str, ...] = ()
    top_level: bool = False


PROJECT_COLUMNS = ("project_path", "project_remote", "project_marker")


def apply(t: Tables, f: SessionFilter | None) -> DataFrame:
    """The sessions that a filter leaves. Column predicates come first, so that they reach the scan; then semi-joins."""
    s = t.sessions
    if f is None:
        return s
    if f.since:
        s = s.where(F.col("started_at") >= F.lit(f.since).cast(dict(s.dtypes)["started_at"]))
    if f.until:
        s = s.where(F.col("started_at") <= F.lit(f.until).cast(dict(s.dtypes)["started_at"]))
    for c in PROJECT_COLUMNS:
        if getattr(f, c) is not None:
            s = s.where(F.col(c) == getattr(f, c))
    if f.project_match:
        s = s.where(reduce(or_, [F.coalesce(F.col(c).contains(m), F.lit(False)) for c in PROJECT_COLUMNS for m in f.project_match]))
    if f.agents:
        s = s.where(F.col("agent").isin(*f.agents))
    if f.profiles:
        s = s.where(F.col("profile").isin(*f.profiles))
    if f.top_level:
        s = s.where("parent_session_id is null")
    if f.device:
        d = t.devices.where((F.col("id") == f.device) | (F.col("friendly_name") == f.device)).select(F.col("id").alias("device_id"))
        s = s.join(d, "device_id", "left_semi")
    if f.kinds:
        k = t.kinds.where(F.col("kind").isin(*f.kinds)).select(F.col("session_id").alias("id"))
        s = s.join(k, "id", "left_semi")
    return s


_LAST = re.compile(r"^(\d+)([mhd])$")


def last(text: str, now: datetime) -> tuple[datetime, datetime]:
    """'45m', '12h' or '7d' up to now."""
    m = _LAST.match(text.strip())
    if not m or int(m[1]) <= 0:
        raise ValueError(f"not a span of time: {text!r}")
    return now - timedelta(**{{"m": "minutes", "h": "hours", "d": "days"}[m[2]]: int(m[1])}), now


def between(text: str) -> tuple[datetime, datetime]:
    """'2026-01-01..2026-01-31': from the first day's start to the last day's end."""
    a, sep, b = text.partition("..")
    if not sep:
        raise ValueError(f"not two days: {text!r}")
    start, end = datetime.fromisoformat(a.strip()), datetime.fromisoformat(b.strip())
    if end < start:
        raise ValueError("the window ends before it starts")
    return start, end + timedelta(days=1) - timedelta(microseconds=1)


def since(text: str, now: datetime) -> tuple[datetime, datetime]:
    """From the start of a day up to now."""
    return datetime.fromisoformat(text.strip()), now


def window(now: datetime, last_: str | None = None, since_: str | None = None, between_: str | None = None) -> tuple[datetime, datetime]:
    """The window of one of the three; more than one is an error, none is seven days."""
    if sum(x is not None for x in (last_, since_, between_)) > 1:
        raise ValueError("a window is given by one of last, since and between")
    return between(between_) if between_ is not None else since(since_, now) if since_ is not None else last(last_ if last_ is not None else "7d", now)


def dashboard_window(now: datetime, text: str = "") -> tuple[datetime, datetime]:
    """30 days where nothing is said; 'all' is a hundred years of 365 days."""
    if text == "all":
        return now - timedelta(days=100 * 365), now
    return last(text or "30d", now)


def heatmap_window(now: datetime) -> tuple[datetime, datetime]:
    """53 weeks that start on a Sunday and hold today."""
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    return day - timedelta(days=(day.weekday() + 1) % 7 + 364), now


def project_key(lines: DataFrame) -> DataFrame:
    """(file, project) of the lines (file, line, text) of marker files: what follows the first `project:` that is not empty, without quotes and remarks."""
    text = F.trim("text")
    value = F.regexp_replace(F.regexp_extract(text, r"^project:\s*([^#]*)", 1), r"""^["' ]+|["'\s]+$""", "")
    return lines.select("file", "line", value.alias("project")).where("project <> ''").groupBy("file").agg(F.min_by("project", "line").alias("project"))


def sound_raw(sessions: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions whose raw file (raw_uri, body) is of the size and hash that they claim, others with a reason)."""
    body = F.col("body").cast("binary")
    have = files.select(F.col("raw_uri").alias("_uri"), F.octet_length(body).cast("long").alias("_size"), F.sha2(body, 256).alias("_hash"))
    j = sessions.join(have, F.col("raw_uri") == F.col("_uri"), "left")
    reason = F.when(F.col("_uri").isNull(), "no raw file").when(~F.col("_size").eqNullSafe(F.col("raw_size")), "raw size mismatch").when(~F.col("_hash").eqNullSafe(F.col("raw_hash")), "raw hash mismatch")
    marked = j.withColumn("reason", reason)
    return marked.where("reason is null").select(*sessions.columns), marked.where("reason is not null").select(*sessions.columns, "reason")


def boilerplate(sessions: DataFrame, limit: int = 0) -> DataFrame:
    """(id, raw_uri) of the sessions whose first prompt starts as an injected message does; a limit takes those of the smallest ids."""
    found = sessions.where(starts_as_boilerplate(F.col("first_prompt"))).select("id", "raw_uri")
    return found.orderBy("id").limit(limit) if limit > 0 else found


def denoised(t: Tables) -> DataFrame:
    """sessions with such first prompts replaced by the first message of the user that is none; those without one keep theirs. Run again, it changes nothing."""
    bad = boilerplate(t.sessions).select(F.col("id").alias("session_id"))
    said = t.turns.where("role = 'user'").join(bad, "session_id", "left_semi").select("session_id", "ts", "id", first_prompt(F.col("content")).alias("p")).where("p is not null")
    new = said.groupBy(F.col("session_id").alias("_s")).agg(F.min_by("p", F.struct("ts", "id")).alias("_new"))
    s = t.sessions.join(new, F.col("id") == F.col("_s"), "left")
    return s.withColumn("first_prompt", F.coalesce("_new", "first_prompt")).select(*t.sessions.columns)


def project_of(sessions: DataFrame, remote: str | None, marker: str | None, path: str | None) -> SessionFilter:
    """Scope by remote, else marker, else the longest known path that is the folder or holds it."""
    if remote and sessions.where(F.col("project_remote") == remote).limit(1).count():
        return SessionFilter(project_remote=remote)
    if marker and sessions.where(F.col("project_marker") == marker).limit(1).count():
        return SessionFilter(project_marker=marker)
    known = sessions.select("project_path").where(F.col("project_path").isNotNull() & ((F.lit(path) == F.col("project_path")) | F.lit(path).startswith(F.concat("project_path", F.lit("/")))))
    best = known.agg(F.max_by("project_path", F.length("project_path"))).first()[0] if path else None
    return SessionFilter(project_path=best or path)
