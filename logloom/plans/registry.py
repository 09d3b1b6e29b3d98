"""The registered queries: reports, views, entity queries and searches over the benchmark tables, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import search
from ..operators.filters import SessionFilter
from ..operators.postings import Postings
from ..sources import fixtures
from ..streaming.store import Store, scratch
from . import entities, oracle, oracle_views, reports, views

#: Holds all of the events and some empty days after them.
WINDOW = SessionFilter(since=datetime(2024, 1, 1), until=datetime(2024, 2, 5))


def _events(f):
    return lambda spark, sf_dir: f(fixtures.from_events(spark, sf_dir))


def _conversations(f):
    return lambda spark, sf_dir: f(fixtures.from_conversations(spark, sf_dir))


def _posted(f):
    """The conversations taken into a store of their own, and searched by its posting lists."""

    def run(spark, sf_dir):
        store = Store(spark, scratch(spark))
        store.append(fixtures.from_conversations(spark, sf_dir), tell=False)
        lists = Postings(store)
        lists.extend()
        return f(lists, store.read())

    return run


def _list_page(t):
    f = SessionFilter(agents=("codex", "gemini"), project_match=("p3", "r6"))
    page = entities.list_sessions(t, f, sort="total_tokens", limit=25, offset=10)
    return page.withColumn("kinds", F.array_join("kinds", ","))


def _reconcile(t):
    local = t.sessions.select("id", "raw_hash")
    at = F.col("id")
    remote = local.where(~at.startswith("u1")).select("id", F.when(at.startswith("u2"), "x").otherwise(F.col("raw_hash")).alias("raw_hash"), F.when(at.startswith("u3"), 11).otherwise(12).alias("projection_version"))
    return entities.reconcile(local, remote, 12)


ENTITIES = {
    "list_page": _list_page,
    "grouped_feed": entities.grouped_feed,
    "sibling_pager": entities.sibling_pager,
    "session_detail": entities.session_detail,
    "manifest": entities.manifest,
    "reconcile": _reconcile,
    "orphans": entities.orphans,
    "device_counts": entities.device_counts,
    "filter_options": views.filter_options,
    "transcript": lambda t: views.transcript(t.turns),
    "work_codex_usage": lambda t: reports.usage_by_day(t, SessionFilter(kinds=("orchestrator",), device="laptop")),
}
SEARCHES = {
    "search_words": lambda t: search.matching_sessions(t, "the (er OR wh*) NOT of"),
    "search_phrase": lambda t: search.matching_sessions(t, '"of the"'),
    "search_best": lambda t: search.search(t, "the OR er", limit=50).select("session_id", "rank", "role", "snippet"),
}
POSTED = {
    "posted_words": lambda p, t: p.matching_sessions(t, "the (er OR wh*) NOT of"),
    "posted_phrase": lambda p, t: p.matching_sessions(t, '"of the"'),
    "posted_best": lambda p, t: p.search(t, "the OR er", limit=50).select("session_id", "rank", "role", "snippet"),
}
#: Local time in the registered views.
_OFFSETS = {"hour_chart": -3, "punchcard_grid": 5}


def queries():
    found = {f"r_{n}": _events(lambda t, n=n: reports.report(n, t, WINDOW)) for n in reports.REPORTS}
    found |= {f"v_{n}": _events(lambda t, f=f, n=n: f(t, WINDOW, _OFFSETS[n]) if n in _OFFSETS else f(t, WINDOW)) for n, f in views.VIEWS.items()}
    found |= {f"q_{n}": _events(f) for n, f in ENTITIES.items()}
    found |= {f"q_{n}": _conversations(f) for n, f in SEARCHES.items()}
    return found | {f"q_{n}": _posted(f) for n, f in POSTED.items()}


def oracle_sql():
    return {f"r_{n}": q for n, q in oracle.REPORTS.items()} | {f"v_{n}": q for n, q in oracle_views.VIEWS.items()} | {f"q_{n}": q for n, q in (oracle_views.ENTITIES | oracle_views.SEARCHES).items()} | {f"q_{n}": oracle_views.SEARCHES[n.replace("posted", "search")] for n in POSTED}
