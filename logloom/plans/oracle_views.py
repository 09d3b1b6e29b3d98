"""DuckDB SQL of the views, entity queries and searches."""

from __future__ import annotations

from .oracle import BASE, DUR, FLAG, KIDS, LU, MODEL, PROJECT, USAGE, priced

BAR = "CASE WHEN {n} > 0 THEN greatest(3, ({n} * 100 + max({n}) OVER () - 1) // max({n}) OVER ()) ELSE 0 END"
LEVEL = "CASE WHEN {n} > 0 THEN least(({n} * 4 + max({n}) OVER () - 1) // max({n}) OVER (), 4) ELSE 0 END"
DAYS = "days AS (SELECT CAST(x AS DATE) AS d FROM generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY) g(x))"
BY_AGENT = "(SELECT agent, count(*) AS sessions FROM s GROUP BY 1)"
WEEK = "CAST(date_trunc('week', CAST(day AS DATE)) AS DATE)"
DEVICE = "coalesce(nullif(friendly_name, ''), device_id)"
PARENTS = f"(SELECT strftime(started_at, '%Y-%m-%d %H:%M') AS started, agent, {PROJECT} AS project, id AS session, children, started_at FROM s JOIN {KIDS} ON p = id)"


def bars(sub: str, label: str, n: str = "sessions") -> str:
    return f"{BASE} SELECT {label} AS label, {n} AS count, CAST({BAR.format(n=n)} AS BIGINT) AS percent FROM {sub}"


def top_other(sub: str, name: str, by: str) -> str:
    return f"""x AS ({sub}), n AS (SELECT {name} AS nm, row_number() OVER (ORDER BY sum({by}) DESC, {name}) AS rn FROM x GROUP BY 1),
y AS (SELECT x.* REPLACE (CASE WHEN rn <= 7 THEN {name} ELSE 'other' END AS {name}) FROM x JOIN n ON nm = {name})"""


_PROFILES = priced(f"day, device_id, agent, profile, {MODEL} AS model") + """, b AS (SELECT device_id, agent, profile, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(total) AS BIGINT) AS tokens, CAST(sum(cost_nano) AS BIGINT) AS cost_nano FROM q GROUP BY 1, 2, 3)"""
_DAY_MODEL = priced(f"day, {MODEL} AS model")
VIEWS = {
    "kpis": priced("day, agent, coalesce(model, '') AS model")
    + """, n AS (SELECT CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(total) AS BIGINT) AS tokens, CAST(sum(cost_nano) AS BIGINT) AS cost_nano FROM q)
SELECT k AS kpi, v AS now, CAST(0 AS BIGINT) AS before, CAST(NULL AS BIGINT) AS change_pct FROM (UNPIVOT n ON sessions, tokens, cost_nano INTO NAME k VALUE v)""",
    "agent_bars": bars(BY_AGENT, "agent"),
    "tool_bars": bars("(SELECT name AS tool, CAST(sum(n) AS BIGINT) AS uses FROM tools GROUP BY 1 ORDER BY uses DESC, tool LIMIT 20)", "tool", "uses"),
    "heatmap_grid": f"""{BASE}, {DAYS}, g AS (SELECT d, count(id) AS sessions FROM days LEFT JOIN s ON day = strftime(d, '%Y-%m-%d') GROUP BY 1),
c AS (SELECT d, sessions, CAST({LEVEL.format(n='sessions')} AS BIGINT) AS level, CAST((d - (DATE '2024-01-01' - CAST(extract(dow FROM DATE '2024-01-01') AS INT))) // 7 AS INT) AS "column", CAST(extract(dow FROM d) AS INT) AS "row" FROM g)
SELECT strftime(d, '%Y-%m-%d') AS date, sessions, level, "column", "row", min(strftime(d, '%Y-%m')) OVER (PARTITION BY "column") AS month_band FROM c""",
    "usage_table": priced("day, agent, coalesce(model, '') AS model")
    + f""", a AS (SELECT agent, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(measured) AS BIGINT) AS measured, CAST(sum(total) AS BIGINT) AS total, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
CAST(sum(cached) AS BIGINT) AS cached, CAST(sum(cost_nano) AS BIGINT) AS est_cost_nano_usd FROM q GROUP BY 1 HAVING sum(total) <> 0) SELECT *, CAST({BAR.format(n='total')} AS BIGINT) AS percent FROM a""",
    "project_bars": bars(f"(SELECT {PROJECT} AS project, count(*) AS sessions FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)", "project"),
    "model_board": _DAY_MODEL
    + """, m2 AS (SELECT model, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(total) AS BIGINT) AS total, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cost_nano) AS BIGINT) AS est_cost_nano_usd FROM q GROUP BY 1)
SELECT *, CAST(floor(total * 100 / sum(total) OVER ()) AS BIGINT) AS percent FROM m2 ORDER BY total DESC, model LIMIT 8""",
    "hour_chart": f"""{BASE}, h AS (SELECT (CAST(hour AS INT) + 24 - 3) % 24 AS hour, count(*) AS n FROM s GROUP BY 1), a AS (SELECT CAST(x AS INT) AS hour, coalesce(n, 0) AS sessions FROM range(24) r(x) LEFT JOIN h ON hour = x)
SELECT hour, sessions, row_number() OVER (ORDER BY sessions DESC, hour) = 1 AND sessions > 0 AS peak FROM a""",
    "issues": f"""{BASE}, m AS (SELECT {MODEL} AS model, count(*) AS n FROM s WHERE id IN {FLAG} GROUP BY 1)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS flagged, (SELECT count(*) FROM s) AS sessions, round(coalesce(sum(n), 0) * 100 / (SELECT count(*) FROM s), 1) AS rate_pct, (SELECT model FROM m ORDER BY n DESC, model DESC LIMIT 1) AS top_model FROM m""",
    "activity_trend": f"""{BASE}, {DAYS}, {top_other("SELECT day, agent, count(*) AS sessions FROM s GROUP BY 1, 2", "agent", "sessions")}, z AS (SELECT CAST(day AS DATE) AS b, agent, CAST(sum(sessions) AS BIGINT) AS n FROM y GROUP BY 1, 2)
SELECT d AS bucket, coalesce(agent, '') AS agent, coalesce(n, 0) AS sessions FROM days LEFT JOIN z ON b = d""",
    "spend_trend": f"""{_DAY_MODEL}, {DAYS}, a AS (SELECT day, CAST(sum(cost_nano) AS BIGINT) AS c, CAST(sum(total) AS BIGINT) AS n FROM q GROUP BY 1), b AS (SELECT d AS bucket, coalesce(c, 0) AS cost_nano, coalesce(n, 0) AS tokens FROM days LEFT JOIN a ON day = strftime(d, '%Y-%m-%d'))
SELECT *, round(cost_nano * 100.0 / max(cost_nano) OVER (), 4) AS cost_pct, round(tokens * 100.0 / max(tokens) OVER (), 4) AS tokens_pct FROM b""",
    "model_share": f"""{BASE}, {top_other(f"SELECT day, {MODEL} AS model, CAST(coalesce(sum(total), 0) AS BIGINT) AS tokens FROM {LU} GROUP BY 1, 2", "model", "tokens")}, z AS (SELECT {WEEK} AS week, model, CAST(sum(tokens) AS BIGINT) AS tokens FROM y GROUP BY 1, 2)
SELECT *, round(tokens * 100.0 / nullif(sum(tokens) OVER (PARTITION BY week), 0), 4) AS percent FROM z""",
    "punchcard_grid": f"""{BASE}, p AS (SELECT CAST(extract(dow FROM started_at + INTERVAL 5 HOUR) AS INT) AS dow, CAST(extract(hour FROM started_at + INTERVAL 5 HOUR) AS INT) AS hour, count(*) AS n FROM s GROUP BY 1, 2),
g AS (SELECT CAST(x // 24 AS INT) AS dow, CAST(x % 24 AS INT) AS hour, coalesce(n, 0) AS sessions FROM range(168) r(x) LEFT JOIN p ON p.dow = x // 24 AND p.hour = x % 24)
SELECT *, CAST({LEVEL.format(n='sessions')} AS BIGINT) AS level FROM g""",
    "schedule_kpis": f"""{BASE}, p AS (SELECT CAST(extract(dow FROM started_at) AS INT) AS dow, CAST(hour AS INT) AS h FROM s), d AS (SELECT x AS dow, (SELECT count(*) FROM p WHERE p.dow = x) AS n FROM range(7) r(x))
SELECT CAST(round((SELECT count(*) FROM p WHERE dow IN (0, 6)) * 100 / (SELECT count(*) FROM p)) AS BIGINT) AS weekend_pct, CAST(round((SELECT count(*) FROM p WHERE h < 9 OR h >= 18) * 100 / (SELECT count(*) FROM p)) AS BIGINT) AS off_hours_pct,
CAST((SELECT dow FROM d ORDER BY n DESC, dow LIMIT 1) AS INT) AS busiest_dow""",
    "streaks": f"""{BASE}, o AS (SELECT DISTINCT CAST(day AS DATE) AS day FROM s), i AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INT) AS island FROM o), r AS (SELECT count(*) AS n, max(day) AS e FROM i GROUP BY island)
SELECT coalesce(max(CASE WHEN e >= DATE '2024-02-04' THEN n END), 0) AS current, max(n) AS longest, CAST(sum(n) AS BIGINT) AS active_days, CAST(36 AS BIGINT) AS days, CAST(round(sum(n) * 100 / 36) AS BIGINT) AS active_pct FROM r""",
    "durations_card": f"""{BASE}, b AS (SELECT * FROM (VALUES (0, '<5m', 0, 300), (1, '5-15m', 300, 900), (2, '15-30m', 900, 1800), (3, '30-60m', 1800, 3600), (4, '1-2h', 3600, 7200), (5, '>2h', 7200, 1000000000)) v(position, bucket, lo, hi)),
c AS (SELECT position, bucket, count(d) AS sessions FROM b LEFT JOIN (SELECT {DUR} AS d FROM s) ON d >= lo AND d < hi GROUP BY 1, 2) SELECT *, CAST({BAR.format(n='sessions')} AS BIGINT) AS percent FROM c""",
    "kind_bars": bars("(SELECT kind, count(DISTINCT session_id) AS sessions FROM kinds GROUP BY 1)", "kind"),
    "subagent_totals": f"{BASE} SELECT count(*) AS parents, CAST(sum(children) AS BIGINT) AS children, max(children) AS max_fanout FROM s JOIN {KIDS} ON p = id",
    "delegation_kpis": priced(f"day, {MODEL} AS model, CASE WHEN parent_session_id IS NULL THEN 'direct' ELSE 'subagent' END AS kind")
    + f""", a AS (SELECT CAST(round(sum(CASE WHEN kind = 'subagent' THEN total ELSE 0 END) * 100 / sum(total)) AS BIGINT) AS delegated_pct, CAST(sum(CASE WHEN kind = 'subagent' THEN cost_nano END) AS BIGINT) AS subagent_cost_nano FROM q),
b AS (SELECT count(*) AS spawning, CAST(sum(children) AS BIGINT) AS children, max(children) AS max_fanout FROM s JOIN {KIDS} ON p = id) SELECT * FROM b, a""",
    "delegation_trend": f"{BASE} SELECT {WEEK} AS week, coalesce(round(sum(CASE WHEN parent_session_id IS NOT NULL THEN total ELSE 0 END) * 100.0 / nullif(sum(total), 0), 4), 0.0) AS delegated_pct FROM {LU} GROUP BY 1",
    "fanout_histogram": f"""{BASE}, b AS (SELECT * FROM (VALUES (0, '1', 1, 1), (1, '2', 2, 2), (2, '3-4', 3, 4), (3, '5-8', 5, 8), (4, '9+', 9, 1000000)) v(position, bucket, lo, hi)),
c AS (SELECT position, bucket, count(children) AS sessions FROM b LEFT JOIN {PARENTS} ON children BETWEEN lo AND hi GROUP BY 1, 2) SELECT *, CAST({BAR.format(n='sessions')} AS BIGINT) AS percent FROM c""",
    "top_delegators": f"{BASE} SELECT started, agent, project, session, children FROM {PARENTS} ORDER BY children DESC, started_at DESC, session LIMIT 8",
    "across_the_day": f"""{BASE}, {top_other(f"SELECT hour, {MODEL} AS model, count(*) AS sessions, CAST(coalesce(sum(total), 0) AS BIGINT) AS tokens FROM {LU} GROUP BY 1, 2", "model", "sessions")}
SELECT CAST(hour AS INT) AS hour, model, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(tokens) AS BIGINT) AS tokens FROM y GROUP BY 1, 2""",
    "profile_board": priced(f"day, device_id, agent, profile, {MODEL} AS model, max(last_activity_at) AS seen")
    + f""" SELECT {DEVICE} AS device, agent, profile, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(total) AS BIGINT) AS tokens, CAST(sum(cost_nano) AS BIGINT) AS cost_nano, strftime(max(seen), '%Y-%m-%d %H:%M') AS last_activity
FROM q LEFT JOIN dev ON dev.id = device_id GROUP BY 1, 2, 3""",
    "profile_table": _PROFILES
    + """ SELECT count(*) AS profiles, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nano) AS BIGINT) AS cost_nano,
round(coalesce(sum(sessions) FILTER (profile <> 'default'), 0) * 100.0 / sum(sessions), 4) AS other_percent FROM b""",
    "profile_bars": _PROFILES
    + f""", c AS (SELECT agent || '·' || profile AS label, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nano) AS BIGINT) AS cost_nano FROM b GROUP BY 1)
SELECT label, tokens, cost_nano, CAST({BAR.format(n="tokens")} AS BIGINT) AS percent FROM c ORDER BY tokens DESC, label LIMIT 8""",
    "profile_trend": f"""{BASE}, {DAYS}, {top_other("SELECT day, agent || '·' || profile AS agent, count(*) AS sessions FROM s GROUP BY 1, 2", "agent", "sessions")}, z AS (SELECT CAST(day AS DATE) AS b, agent, CAST(sum(sessions) AS BIGINT) AS n FROM y GROUP BY 1, 2)
SELECT d AS bucket, coalesce(agent, '') AS agent, coalesce(n, 0) AS sessions FROM days LEFT JOIN z ON b = d""",
    "project_board": f"{BASE}, g AS (SELECT {PROJECT} AS project, count(*) AS sessions FROM s GROUP BY 1) SELECT *, round(sessions * 100.0 / sum(sessions) OVER (), 4) AS percent FROM g",
}

_LIST = "id, agent, device_id, profile, project_path, project_remote, project_marker, started_at, last_activity_at, model, parent_session_id"
_KINDS = "(SELECT session_id AS ks, list_sort(list_distinct(list(kind))) AS kinds FROM kinds GROUP BY 1)"
_SU = "(SELECT session_id AS us, total AS total_tokens, input AS input_tokens, output AS output_tokens, cached AS cached_tokens, cache_read AS cache_read_tokens, cache_creation AS cache_creation_tokens FROM su)"
_COST_OF = priced("id AS sid, day, model")
ENTITIES = {
    "list_page": f"""{BASE} SELECT {_LIST}, total_tokens, input_tokens, output_tokens, cached_tokens, cache_read_tokens, cache_creation_tokens, us IS NOT NULL AS measured, array_to_string(coalesce(kinds, []), ',') AS kinds, count(*) OVER () AS total
FROM s LEFT JOIN {_SU} ON us = id LEFT JOIN {_KINDS} ON ks = id WHERE agent IN ('codex', 'gemini') AND (contains(project_path, 'p3') OR contains(project_remote, 'r6')) ORDER BY total_tokens DESC NULLS LAST, started_at DESC, id LIMIT 25 OFFSET 10""",
    "grouped_feed": f"""{_COST_OF}, c AS (SELECT s.id, s.agent, s.started_at, s.parent_session_id, q.cost_nano FROM s JOIN q ON q.sid = s.id), kids AS (SELECT parent_session_id AS p, count(*) AS n, CAST(sum(cost_nano) AS BIGINT) AS kc FROM c WHERE parent_session_id IS NOT NULL GROUP BY 1)
SELECT id, agent, started_at, coalesce(n, 0) AS children, cost_nano AS own_cost_nano, CASE WHEN cost_nano IS NOT NULL OR kc IS NOT NULL THEN coalesce(cost_nano, 0) + coalesce(kc, 0) END AS cost_nano FROM c LEFT JOIN kids ON p = id WHERE parent_session_id IS NULL""",
    "sibling_pager": f"""{BASE} SELECT id, parent_session_id AS parent, CAST(row_number() OVER w AS INT) AS n, count(*) OVER (PARTITION BY parent_session_id) AS "of", lag(id) OVER w AS previous, lead(id) OVER w AS next FROM s WHERE parent_session_id IS NOT NULL WINDOW w AS (PARTITION BY parent_session_id ORDER BY started_at, id)""",
    "session_detail": f"""{BASE}, c AS (SELECT session_id, count(*) AS turns, count(*) FILTER (kind NOT IN ('tool_result', 'thinking')) AS messages FROM t GROUP BY 1),
o AS (SELECT session_id, name, n, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, name) AS rn FROM tools), d AS (SELECT session_id, CAST(sum(n) AS BIGINT) AS tool_calls, string_agg(name || ' ×' || n, ', ' ORDER BY rn) FILTER (rn <= 3) AS top_tools FROM o GROUP BY 1)
SELECT id, coalesce(turns, 0) AS turns, coalesce(messages, 0) AS messages, coalesce(tool_calls, 0) AS tool_calls, coalesce(top_tools, '') AS top_tools FROM s LEFT JOIN c ON c.session_id = id LEFT JOIN d ON d.session_id = id""",
    "manifest": f"{BASE} SELECT id, md5(id) AS raw_hash, CAST(0 AS INT) AS projection_version FROM s ORDER BY id LIMIT 5000",
    "reconcile": f"""{BASE}, r AS (SELECT id, CASE WHEN starts_with(id, 'u2') THEN 'x' ELSE md5(id) END AS h, CASE WHEN starts_with(id, 'u3') THEN 11 ELSE 12 END AS v FROM s WHERE NOT starts_with(id, 'u1'))
SELECT s.id, CASE WHEN r.id IS NULL THEN 'missing' WHEN h <> md5(s.id) THEN 'changed' WHEN v < 12 THEN 'stale' END AS reason FROM s LEFT JOIN r USING (id) WHERE reason IS NOT NULL""",
    "orphans": f"{BASE} SELECT parent_session_id AS parent, count(*) AS children FROM s WHERE parent_session_id IS NOT NULL AND parent_session_id NOT IN (SELECT id FROM s) GROUP BY 1",
    "device_counts": f"{BASE} SELECT dev.id, friendly_name, count(s.id) AS sessions FROM dev LEFT JOIN s ON device_id = dev.id GROUP BY 1, 2",
    "filter_options": f"{BASE} SELECT DISTINCT 'project' AS kind, {PROJECT} AS value FROM s UNION ALL SELECT DISTINCT 'profile', profile FROM s UNION ALL SELECT DISTINCT 'device', {DEVICE} FROM s LEFT JOIN dev ON dev.id = device_id",
    "transcript": f"""{BASE}, a AS (SELECT *, CASE WHEN kind = 'thinking' THEN 'thinking-group' WHEN role = 'tool' THEN 'tool-group' ELSE 'single' END AS what, date_diff('microsecond', lag(ts) OVER w, ts) / 1e6 AS gap FROM t WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)),
b AS (SELECT *, coalesce(gap >= 30, false) AS pause, what = 'single' OR coalesce(gap >= 30, false) OR coalesce(lag(what) OVER w <> what, true) AS new FROM a WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)),
c AS (SELECT *, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS position FROM b),
n AS (SELECT session_id, position, what, coalesce(nullif(tool_name, ''), 'tool') AS name, count(*) AS n, max(CASE WHEN pause THEN gap END) AS gap FROM c GROUP BY ALL)
SELECT session_id, position, what AS kind, CAST(sum(n) AS BIGINT) AS turns, CASE WHEN what = 'tool-group' THEN string_agg(name || ' ×' || n, ' · ' ORDER BY n DESC, name) WHEN what = 'thinking-group' THEN CASE WHEN sum(n) > 1 THEN 'Processed (' || CAST(sum(n) AS BIGINT) || ' steps)' ELSE 'Processed' END END AS summary,
max(gap) AS gap_seconds FROM n GROUP BY 1, 2, 3""",
    "work_codex_usage": f"{BASE} SELECT day, {MODEL} AS model, {USAGE} FROM {LU} WHERE id IN (SELECT session_id FROM kinds WHERE kind = 'orchestrator') AND device_id IN (SELECT id FROM dev WHERE id = 'laptop' OR friendly_name = 'laptop') GROUP BY 1, 2",
}
_CT = "c AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM conversations WHERE role <> 'system')"
SEARCHES = {
    "search_words": f"WITH {_CT} SELECT 'c' || conv_id AS session_id, count(*) AS turns FROM c WHERE list_contains(t, 'the') AND (list_contains(t, 'er') OR len(list_filter(t, lambda x: starts_with(x, 'wh'))) > 0) AND NOT list_contains(t, 'of') GROUP BY 1",
    # a word's frequency in each turn, then BM25, then the best turn of each session
    "search_best": f"""WITH {_CT}, n AS (SELECT *, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'er')) AS b FROM c),
  st AS (SELECT count(*) AS n, avg(len(t)) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM n),
  r AS (SELECT n.*, round(ln(1 + (st.n - da + 0.5) / (da + 0.5)) * a * (1.2 + 1) / (a + 1.2 * (1 - 0.75 + 0.75 * len(t) / av)) + ln(1 + (st.n - db + 0.5) / (db + 0.5)) * b * (1.2 + 1) / (b + 1.2 * (1 - 0.75 + 0.75 * len(t) / av)), 9) AS rank FROM n, st WHERE a > 0 OR b > 0),
  x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rank DESC, turn) AS nth, greatest(list_position(list_transform(t, lambda x: x IN ('the', 'er')), true) - 2, 1) AS f FROM r)
  SELECT 'c' || conv_id AS session_id, rank, role, array_to_string(list_transform(t[f:f + 15], lambda x: CASE WHEN x IN ('the', 'er') THEN '«' || x || '»' ELSE x END), ' ') AS snippet FROM x WHERE nth = 1 ORDER BY rank DESC, session_id LIMIT 50""",
    "search_phrase": f"WITH {_CT} SELECT 'c' || conv_id AS session_id, count(*) AS turns FROM c WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' of the ') GROUP BY 1",
}
