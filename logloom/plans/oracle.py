"""DuckDB SQL that states the registered queries over the benchmark tables."""

from __future__ import annotations

from ..functions.pricing import ALIASES, rate_rows
from ..sources.fixtures import AGENTS, DEVICES, MODELS


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


_E = """e AS (SELECT *, CAST(regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS INT) AS k, strftime(ts, '%Y%m%d') AS dy, 'u' || user_id || '-' || strftime(ts, '%Y%m%d') AS session_id FROM events)"""
_PER = """per AS (SELECT session_id, user_id, dy, min(ts) AS started_at, max(ts) AS last_activity_at, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS inp, CAST(sum(k * 10) AS BIGINT) AS outp,
  bool_or(event_type = 'purchase' AND k % 30 = 0) AS workflow FROM e GROUP BY ALL)"""
_S = f"""s AS (SELECT session_id AS id, list_extract([{", ".join(f"'{a}'" for a in AGENTS)}], CAST(user_id % 7 AS INT) + 1) AS agent, 'dev' || (user_id % 5) AS device_id,
  CASE WHEN user_id % 5 <> 0 THEN '/home/dev/p' || (user_id % 10) END AS project_path,
  CASE WHEN user_id % 5 <> 0 AND user_id % 3 = 0 THEN 'git@github.com:org/r' || (user_id % 10) || '.git' END AS project_remote,
  CASE WHEN user_id % 5 <> 0 AND user_id % 4 = 1 THEN 'm' || (user_id % 10) END AS project_marker, started_at, last_activity_at,
  list_extract([{", ".join("NULL" if m is None else f"'{m}'" for m in MODELS)}], CAST((user_id + CAST(dy AS INT)) % 6 AS INT) + 1) AS model,
  CASE WHEN user_id % 10 IN (1, 2, 3) THEN 'u' || (user_id - user_id % 10) || '-' || dy END AS parent_session_id, CASE WHEN user_id % 11 = 0 THEN 'work' ELSE 'default' END AS profile,
  strftime(started_at, '%Y-%m-%d') AS day, strftime(started_at, '%H') AS hour FROM per)"""
_SU = """su AS (SELECT session_id, inp + outp AS total, inp AS input, outp AS output, inp // 4 AS cached, inp // 4 AS cache_read, CASE WHEN outp % 20 = 0 THEN inp // 10 ELSE 0 END AS cache_creation FROM per WHERE user_id % 8 <> 7)"""
_T = """t AS (SELECT event_id AS id, session_id, CASE WHEN event_type IN ('click', 'signup') THEN 'user' WHEN event_type = 'purchase' THEN 'tool' ELSE 'assistant' END AS role, event_type || ' item ' || k AS content, ts,
  CASE WHEN event_type = 'purchase' THEN 'tool_result' WHEN event_type = 'view' AND k % 10 = 0 THEN 'thinking' ELSE 'message' END AS kind, CASE WHEN event_type = 'purchase' THEN 'tool' || (k % 30) END AS tool_name FROM e)"""
_TOOLS = "tools AS (SELECT session_id, tool_name AS name, count(*) AS n FROM t WHERE tool_name IS NOT NULL GROUP BY ALL)"
_KINDS = "kinds AS (SELECT session_id, 'workflow' AS kind FROM per WHERE workflow UNION ALL SELECT id, 'orchestrator' FROM s WHERE id IN (SELECT parent_session_id FROM s WHERE parent_session_id IS NOT NULL))"
_DEV = f"dev AS (SELECT * FROM (VALUES {_values([(f'dev{i}', n) for i, n in enumerate(DEVICES)])}) d(id, friendly_name))"
_RATES = f"rates AS (SELECT model, CAST(frm AS DATE) AS frm, CAST(til AS DATE) AS til, i, o, r, c FROM (VALUES {_values(rate_rows())}) x(model, frm, til, i, o, r, c))"
_ALIAS = f"alias AS (SELECT * FROM (VALUES {_values(ALIASES.items())}) x(a, m))"
BASE = "WITH " + ",\n".join((_E, _PER, _S, _SU, _T, _TOOLS, _KINDS, _DEV, _RATES, _ALIAS))

PROJECT = "coalesce(project_remote, project_marker, project_path, '(unscoped)')"
MODEL = "coalesce(model, '(none)')"
TOKENS = ("total", "input", "output", "cached", "cache_read", "cache_creation")
USAGE = "count(*) AS sessions, count(su.session_id) AS measured, " + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in TOKENS)
LU = "s LEFT JOIN su ON su.session_id = s.id"
FLAG = "(SELECT session_id FROM t WHERE role = 'assistant' AND kind <> 'thinking' AND regexp_matches(lower(content), '(^|[^a-z0-9])(error|exception|traceback|panic|fatal)([^a-z0-9]|$)'))"


def priced(grain: str) -> str:
    """`q`: usage by grain, which has day and model, with cost_nano of the longest rate key that fits on that day."""
    norm = "lower(trim(model))"
    for a in ("^openai/", "^anthropic/", "^anthropic\\.", "^google/", "@.*$", "-\\d{8}$|-\\d{4}-\\d{2}-\\d{2}$"):
        norm = f"regexp_replace({norm}, '{a}', '')"
    norm = f"regexp_replace({norm}, '^claude-(\\d+)\\.(\\d+)-(opus|sonnet|haiku)(-.*)?$', 'claude-\\3-\\1-\\2\\4')"
    return f"""{BASE}, g AS (SELECT {grain}, {USAGE} FROM {LU} GROUP BY ALL),
m AS (SELECT DISTINCT model, coalesce(alias.m, norm) AS norm FROM (SELECT DISTINCT model, {norm} AS norm FROM g) LEFT JOIN alias ON a = norm),
k AS (SELECT DISTINCT m.model, (SELECT r.model FROM rates r WHERE m.norm = r.model OR starts_with(m.norm, r.model || '-') ORDER BY length(r.model) DESC LIMIT 1) AS rkey FROM m),
q AS (SELECT g.*, CASE WHEN measured > 0 THEN CAST(greatest(input - rd - cache_creation, 0) * i + rd * r + cache_creation * c + output * o AS BIGINT) END AS cost_nano
  FROM (SELECT *, least(CASE WHEN cache_read = 0 THEN cached ELSE cache_read END, input) AS rd FROM g) g
  LEFT JOIN k ON k.model IS NOT DISTINCT FROM g.model LEFT JOIN rates ON rates.model = k.rkey AND CAST(g.day AS DATE) >= frm AND CAST(g.day AS DATE) < til)"""


COST = "CAST(sum(cost_nano) AS BIGINT) AS est_cost_nano_usd"
_BIG = lambda c: f"CAST(sum({c}) AS BIGINT) AS {c}"
DUR = "greatest(date_diff('microsecond', started_at, last_activity_at) / 1e6, 0)"
KIDS = "(SELECT parent_session_id AS p, count(*) AS children FROM s WHERE parent_session_id IS NOT NULL GROUP BY 1)"

REPORTS = {
    "sessions": "SELECT agent, count(*) AS sessions, CAST(coalesce(sum(n), 0) AS BIGINT) AS turns FROM s LEFT JOIN (SELECT session_id, count(*) AS n FROM t GROUP BY 1) ON session_id = id GROUP BY agent",
    "tools": "SELECT name AS tool, CAST(sum(n) AS BIGINT) AS uses, count(*) AS sessions FROM tools GROUP BY 1 ORDER BY uses DESC, tool LIMIT 20",
    "models": f"SELECT {MODEL} AS model, count(*) AS sessions FROM s GROUP BY 1",
    "projects": f"SELECT {PROJECT} AS project, agent, count(*) AS sessions FROM s GROUP BY 1, 2",
    "profiles": "SELECT coalesce(nullif(friendly_name, ''), device_id) AS device, agent, profile, count(*) AS sessions FROM s LEFT JOIN dev ON dev.id = device_id GROUP BY 1, 2, 3",
    "errors": f"SELECT strftime(started_at, '%Y-%m-%d %H:%M') AS started, agent, {PROJECT} AS project, id AS session FROM s WHERE id IN {FLAG} ORDER BY started_at DESC, id LIMIT 30",
    "heatmap": "SELECT d AS date, coalesce(agent, '') AS agent, coalesce(n, 0) AS sessions FROM (SELECT strftime(x, '%Y-%m-%d') AS d FROM generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY) g(x)) LEFT JOIN (SELECT day, agent, count(*) AS n FROM s GROUP BY 1, 2) ON day = d",
    "hours": "SELECT hour, count(*) AS sessions FROM s GROUP BY 1",
    "errors_by_model": f"SELECT {MODEL} AS model, count(*) AS sessions FROM s WHERE id IN {FLAG} GROUP BY 1",
    "usage_by_day": f"SELECT day, {MODEL} AS model, {USAGE} FROM {LU} GROUP BY 1, 2",
    "usage_by_hour": f"SELECT hour, {MODEL} AS model, {USAGE} FROM {LU} GROUP BY 1, 2",
    "subagent_usage_by_day": f"SELECT day, CASE WHEN parent_session_id IS NULL THEN 'direct' ELSE 'subagent' END AS kind, {MODEL} AS model, {USAGE} FROM {LU} GROUP BY 1, 2, 3",
    "subagent_parents": f"SELECT strftime(started_at, '%Y-%m-%d %H:%M') AS started, agent, {PROJECT} AS project, id AS session, children FROM s JOIN {KIDS} ON p = id",
    "subagents": f"SELECT agent, count(*) AS parents, CAST(sum(children) AS BIGINT) AS children, max(children) AS max_fanout FROM s JOIN {KIDS} ON p = id GROUP BY 1",
    "session_kinds": "SELECT kind, count(DISTINCT session_id) AS sessions FROM kinds GROUP BY 1",
    "profile_usage": f"SELECT day, coalesce(nullif(friendly_name, ''), device_id) AS device, agent, profile, {MODEL} AS model, {USAGE}, strftime(max(last_activity_at), '%Y-%m-%d %H:%M') AS last_activity FROM {LU} LEFT JOIN dev ON dev.id = device_id GROUP BY 1, 2, 3, 4, 5",
    "profiles_by_day": "SELECT day, agent, profile, count(*) AS sessions FROM s GROUP BY 1, 2, 3",
    "punchcard": "SELECT CAST(extract(dow FROM started_at) AS INT) AS dow, hour, count(*) AS sessions FROM s GROUP BY 1, 2",
    "durations": f"SELECT CASE WHEN d < 300 THEN '<5m' WHEN d < 900 THEN '5-15m' WHEN d < 1800 THEN '15-30m' WHEN d < 3600 THEN '30-60m' WHEN d < 7200 THEN '1-2h' ELSE '>2h' END AS bucket, count(*) AS sessions FROM (SELECT {DUR} AS d FROM s) GROUP BY 1",
    "duration_stats": f"SELECT CAST(round(quantile_cont(d, 0.5)) AS BIGINT) AS median_s, CAST(round(quantile_cont(d, 0.9)) AS BIGINT) AS p90_s, CAST(round(avg(d)) AS BIGINT) AS avg_s, CAST(round(max(d)) AS BIGINT) AS max_s FROM (SELECT {DUR} AS d FROM s)",
}
REPORTS = {k: f"{BASE}\n{v}" for k, v in REPORTS.items()}
REPORTS["usage"] = priced("day, agent, coalesce(model, '') AS model") + f" SELECT agent, {_BIG('sessions')}, {_BIG('measured')}, {_BIG('total')}, {_BIG('input')}, {_BIG('output')}, {_BIG('cached')}, {COST} FROM q GROUP BY 1"
REPORTS["usage_by_model"] = priced(f"day, {MODEL} AS model") + f" SELECT model, {_BIG('sessions')}, {_BIG('total')}, {_BIG('input')}, {_BIG('output')}, {COST} FROM q GROUP BY 1"
