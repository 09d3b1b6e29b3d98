"""Search by posting lists: which turns have a term, and where, in a store's tables.

A list's rows (term, turn, places, size of the turn) are dealt into the store's buckets by term and sorted by it: a search reads the buckets of
its words, of these the pages of its words, and of a beginning of words the pages that such words are on. Rows of a turn are brought together and
the query is decided on their places alone: words by their lists, phrases by lists moved against each other, NEAR by distances. What frequencies
are measured against, numbers and lengths of turns, is kept by session. Turns themselves are read for the snippets of the few hits that are shown.

Lists are extended by what batches have brought since; rows of sessions that a later batch has brought anew are passed over.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import fitted
from ..schema import Tables
from ..streaming.store import Store
from .filters import SessionFilter, apply
from .search import B, K1, Query, limit_of, marked, searchable, snippet, tokens


def lists_of(turns: DataFrame, *also: str) -> DataFrame:
    """(term, session_id, turn, places, size) of turns (session_id, id, content, kind): where in the turn each of its terms stands, from 0, and the turn's tokens.

    also: columns of which turns of one id may differ, such as their batch.
    """
    docs = searchable(turns).select(*also, "session_id", F.col("id").alias("turn"), tokens(F.col("content")).alias("_t"))
    rows = docs.select(*also, "session_id", "turn", F.size("_t").alias("size"), F.posexplode("_t").alias("_at", "term"))
    return rows.groupBy(*also, "term", "session_id", "turn", "size").agg(F.array_sort(F.collect_list("_at")).alias("places"))


def sizes_of(sessions: DataFrame, turns: DataFrame, *also: str) -> DataFrame:
    """(session_id, turns, tokens) of every session: its turns that are searched."""
    n = searchable(turns).select(*also, "session_id", F.size(tokens(F.col("content"))).alias("_n")).groupBy(*also, "session_id").agg(F.count("*").alias("turns"), F.sum("_n").alias("tokens"))
    return sessions.select(*also, F.col("id").alias("session_id")).join(n, [*also, "session_id"], "left").na.fill(0, ["turns", "tokens"])


class Postings:
    """The posting lists of a store."""

    def __init__(self, store: Store):
        self.store = store

    def _made_of(self, batches: list[str]) -> dict[str, str]:
        """{batch: that with its lists}; of two that were made at once the first counts. A row a batch reaches the driver."""
        rows = self.store.table("sizes", batches).groupBy("of").agg(F.min("batch").alias("by")).collect()
        return {r["of"]: r["by"] for r in rows}

    def extend(self) -> int:
        """Lists of what was committed since the last time, as a batch of their own; the number of batches that it is of."""
        s, batches = self.store, self.store.batches()
        new = [b for b in batches if b not in self._made_of(batches) and s.has(b, "sessions")]
        if not new:
            return 0
        number = s.next_batch()
        turns, sessions = (s.table(name, new).withColumnRenamed("batch", "of") for name in ("turns", "sessions"))
        lists, sizes = lists_of(turns, "of"), sizes_of(sessions, turns, "of")
        s.write(number, "postings", lists)
        s.write(number, "sizes", sizes)
        s.commit(number)
        return len(new)

    def _current(self, name: str) -> DataFrame:
        batches = self.store.batches()
        by = self._made_of(batches)
        rows = self.store.table(name, sorted(set(by.values())))
        rows = rows.where(F.concat("of", "batch").isin([of + b for of, b in by.items()]))
        last = self.store.last_batches(batches).withColumnRenamed("id", "_id")
        return rows.join(last, (F.col("session_id") == F.col("_id")) & (F.col("of") >= F.col("last")), "left_semi")

    def hits(self, query: Query) -> DataFrame:
        """(session_id, turn, size, lists array<struct<term, places>>) of the turns that have a word of the query, whether or not they match."""
        words, starts = query.leaves()
        wanted = reduce(or_, [F.col("term").startswith(p) for p in starts], F.col("term").isin(words) if words else F.lit(False))
        rows = self._current("postings").where(wanted)
        return rows.groupBy("session_id", "turn", "size").agg(F.collect_list(F.struct("term", "places")).alias("lists"))

    def ranked(self, query: str | Query) -> DataFrame:
        """(session_id, turn, rank): the turns that match, by BM25 over all turns that are searched, as `search.ranked_turns` has it."""
        q = Query(query) if isinstance(query, str) else query
        units = [u for i, u in enumerate(q.units) if u not in q.units[:i]]
        rows = self.hits(q).select("session_id", "turn", "size", matches(q, F.col("lists")).alias("_ok"), *[times(u, F.col("lists")).alias(f"_tf{i}") for i, u in enumerate(units)])
        frequencies = rows.agg(F.lit(1).alias("_1"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(units))])
        all_turns = self._current("sizes").agg(F.lit(1).alias("_1"), F.sum("turns").alias("_n"), (F.sum("tokens") / F.nullif(F.sum("turns"), F.lit(0))).alias("_avg"))
        rows = rows.where("_ok").withColumn("_1", F.lit(1)).join(F.broadcast(frequencies), "_1").join(F.broadcast(all_turns), "_1")  # a row each
        score = F.lit(0.0)
        for i in range(len(units)):
            tf = F.col(f"_tf{i}").cast("double")
            idf = F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.nullif(F.col("_avg"), F.lit(0.0))))
        return rows.select("session_id", "turn", F.round(F.coalesce(score, F.lit(0.0)), 9).alias("rank"))

    def matching_sessions(self, t: Tables, query: str | Query, f: SessionFilter | None = None) -> DataFrame:
        """(session_id, turns) of the sessions with a turn that matches."""
        q = Query(query) if isinstance(query, str) else query
        hit = self.hits(q).where(matches(q, F.col("lists"))).groupBy("session_id").agg(F.count("*").alias("turns"))
        return hit.join(apply(t, f).select(F.col("id").alias("session_id")), "session_id", "left_semi")

    def search(self, t: Tables, query: str, f: SessionFilter | None = None, limit: int | None = None, plain: bool = False, width: int = 16, columns: int | None = None) -> DataFrame:
        """As `search.search`, the store being read as t. The hits that are shown, 200 at most, come to the driver: only their sessions' turns are read."""
        q = Query.plain(query) if plain else Query(query)
        s = apply(t, f).select(F.col("id").alias("session_id"), "agent", "started_at")
        best = Window.partitionBy("session_id").orderBy(F.desc("rank"), "turn")
        hits = self.ranked(q).join(s, "session_id").withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
        hits = hits.orderBy(F.desc("rank"), "session_id").limit(limit_of(limit))
        rows = hits.collect()
        shown = hits.sparkSession.createDataFrame(rows, hits.schema)
        turns = t.turns.where(F.col("session_id").isin([r["session_id"] for r in rows])).withColumnRenamed("id", "turn")
        out = turns.join(F.broadcast(shown), ["session_id", "turn"])
        shown_text = snippet(tokens(F.col("content")), q, width) if columns is None else fitted(marked(F.col("content"), q), columns)
        return out.select(
            "session_id", "agent", "started_at", F.col("turn").alias("turn_id"), "ts", "role", "kind", "tool_name", F.lit("content").alias("match_field"), "rank", shown_text.alias("snippet"),
        ).orderBy(F.desc("rank"), "session_id")


# -- the query, decided on the lists of a turn: array<struct<term, places>>, a term once --------------


def _places(lists: Column, word: str, begins: bool = False) -> Column:
    found = F.filter(lists, lambda x: x["term"].startswith(word) if begins else x["term"] == word)
    return F.flatten(F.transform(found, lambda x: x["places"]))


def _starts(unit: tuple, lists: Column) -> Column:
    """Where the words of a phrase, the last a beginning if the unit is a prefix, stand one after the other."""
    kind, words = unit
    moved = [F.transform(_places(lists, w, kind == "prefix" and k + 1 == len(words)), _earlier(k)) for k, w in enumerate(words)]
    return reduce(F.array_intersect, moved)


def _earlier(k: int):
    return lambda i: i - k


def times(unit: tuple, lists: Column) -> Column:
    """How often a turn has a word, a phrase or a beginning of a word."""
    return F.size(_starts(unit, lists)) if unit[1] else F.lit(0)


def matches(query: Query, lists: Column) -> Column:
    def holds(node: tuple) -> Column:
        op = node[0]
        if op in ("and", "or"):
            parts = [holds(n) for n in node[1]]
            return reduce(and_ if op == "and" else or_, parts) if parts else F.lit(False)
        if op == "not":
            return ~holds(node[1][0])
        if op in ("phrase", "prefix"):
            return times(node, lists) > 0
        _, words, distance = node
        if not words:
            return F.lit(False)
        first, others = _places(lists, words[0]), [_places(lists, w) for w in words[1:]]
        return F.exists(first, lambda i: reduce(and_, [F.exists(p, lambda j: F.abs(i - j) - 1 <= distance) for p in others], F.lit(True)))

    return holds(query.root) if query.root is not None else F.lit(False)
