"""Full-text search over turns: tokens, a small query language, BM25, the best turn of each session."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import fitted
from ..schema import Tables
from .filters import SessionFilter, apply

#: Words that flag an assistant's turn as about an error.
ERROR_TRIGGERS = ("error", "exception", "traceback", "panic", "fatal")
K1, B = 1.2, 0.75
_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), _SPLIT), lambda x: x != "")


def searchable(turns: DataFrame) -> DataFrame:
    """Thinking is never searched."""
    return turns.where("kind <> 'thinking'")


def flagged_sessions(turns: DataFrame) -> DataFrame:
    """(session_id) with an assistant's turn that has an error word."""
    hit = F.arrays_overlap(tokens(F.col("content")), F.array(*map(F.lit, ERROR_TRIGGERS)))
    return searchable(turns).where((F.col("role") == "assistant") & hit).select("session_id")


# -- query language: words, "phrases", prefix*, AND (implied), OR, NOT, NEAR(a b, n), brackets -------

_LEX = re.compile(r'"([^"]*)"|NEAR\(([^)]*)\)|([()])|([^\s()"]+)')
_WORD = re.compile(r"[^\W_]+")


class Query:
    """A parsed query: `units` to rank by (words, phrases and beginnings of words that aren't negated), and `match(tokens)`, a condition on an array of tokens."""

    def __init__(self, text: str):
        self.units: list[tuple] = []
        self._negated = 0
        self._items = [m for m in _LEX.finditer(text)]
        self._at = 0
        self.root = self._or() if self._items else None
        while self.root is not None and self._at < len(self._items):  # stray closing brackets
            self._at += 1
            if self._at < len(self._items):
                self.root = ("and", [self.root, self._or()])

    @classmethod
    def plain(cls, text: str) -> Query:
        """Text without a query language: all of its words."""
        q = cls("")
        words = [x.lower() for x in _WORD.findall(text)]
        q.root = ("and", [q._unit_of(("phrase", [w])) for w in words]) if words else None
        return q

    def _unit_of(self, node: tuple) -> tuple:
        if not self._negated:
            self.units += [("phrase", [w]) for w in node[1]] if node[0] == "near" else [node] if node[1] else []
        return node

    def _peek(self) -> str | None:
        return self._items[self._at][0] if self._at < len(self._items) else None

    def _or(self):
        parts = [self._and()]
        while self._peek() == "OR" and self._at + 1 < len(self._items):
            self._at += 1
            parts.append(self._and())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def _and(self):
        parts = []
        while (p := self._peek()) is not None and p != ")" and not (p == "OR" and parts and self._at + 1 < len(self._items)):
            if p == "AND" and parts and self._at + 1 < len(self._items):
                self._at += 1
                continue
            if p == "NOT" and parts and self._at + 1 < len(self._items):
                self._at += 1
                self._negated += 1
                parts.append(("not", [self._unit()]))
                self._negated -= 1
                continue
            parts.append(self._unit())
        return ("and", parts) if len(parts) != 1 else parts[0]

    def _unit(self):
        m = self._items[self._at]
        self._at += 1
        if m[0] == "(":
            inner = self._or()
            self._at += self._peek() == ")"
            return inner
        if m[2] is not None:
            words, _, n = m[2].partition(",")
            return self._unit_of(("near", [x.lower() for x in _WORD.findall(words)], int(n) if n.strip().isdigit() else 10))
        raw = m[1] if m[1] is not None else m[0]
        w = [x.lower() for x in _WORD.findall(raw)]
        if m[1] is None and raw.endswith("*") and w:
            return self._unit_of(("prefix", w))  # foo-ba*: the last word is a beginning
        return self._unit_of(("phrase", w))  # foo-bar is the phrase of its words; punctuation alone is nothing

    def leaves(self) -> tuple[list[str], list[str]]:
        """(words, beginnings of words) that it speaks of, negated ones too. A text that matches has one of them."""
        words, starts, todo = set(), set(), [self.root] if self.root is not None else []
        while todo:
            kind, inner = todo.pop()[:2]
            if kind in ("and", "or", "not"):
                todo += inner
            elif inner:
                words.update(inner if kind != "prefix" else inner[:-1])
                starts.update(inner[-1:] if kind == "prefix" else ())
        return sorted(words), sorted(starts)

    def ranked_words(self) -> tuple[list[str], list[str]]:
        """(words, beginnings of words) that the ranking counts."""
        words = sorted({w for kind, x in self.units for w in (x if kind == "phrase" else x[:-1])})
        return words, sorted({x[-1] for kind, x in self.units if kind == "prefix"})

    def hit(self, token: Column) -> Column:
        """Whether a token is one that the ranking counts, or a part of one."""
        words, starts = self.ranked_words()
        return reduce(or_, [token.startswith(p) for p in starts], token.isin(*words) if words else F.lit(False))

    def match(self, toks: Column) -> Column:
        return self._cond(self.root, toks) if self.root is not None else F.lit(False)

    def _cond(self, node, t: Column) -> Column:
        op = node[0]
        if op in ("and", "or"):
            parts = [self._cond(n, t) for n in node[1]]
            return reduce(and_ if op == "and" else or_, parts) if parts else F.lit(False)
        if op == "not":
            return ~self._cond(node[1][0], t)
        words = node[1]
        if op == "prefix":
            return F.exists(t, lambda x: x.startswith(words[0])) if len(words) == 1 else _times(node, t) > 0
        if not words:
            return F.lit(False)
        here = F.array_contains(t, words[0])
        if op == "phrase":
            for w in words[1:]:
                here = here & F.array_contains(t, w)
            if len(words) > 1:
                joined = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
                here = here & joined.contains(f" {' '.join(words)} ")
            return here
        # near: some place of the first word has each other word within the distance
        places = lambda w: F.filter(F.transform(t, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
        for w in words[1:]:
            here = here & F.array_contains(t, w)
        return here & F.exists(places(words[0]), lambda i: reduce(and_, [F.exists(places(w), lambda j: F.abs(i - j) - 1 <= node[2]) for w in words[1:]], F.lit(True)))


def _times(unit: tuple, t: Column) -> Column:
    """How often an array of tokens has a unit."""
    kind, x = unit
    fits = lambda w, k: w.startswith(x[k]) if kind == "prefix" and k + 1 == len(x) else w == x[k]
    if len(x) == 1:
        return F.size(F.filter(t, lambda w: fits(w, 0)))
    here = lambda w, i: reduce(and_, [fits(F.get(t, i + k), k) for k in range(1, len(x))], fits(w, 0))
    return F.size(F.filter(F.transform(t, here), lambda ok: F.coalesce(ok, F.lit(False))))


def indexed(turns: DataFrame) -> DataFrame:
    """turns with `tokens`, to be stored: what searches them then splits no text."""
    return turns.withColumn("tokens", tokens(F.col("content")))


def _tokens_of(turns: DataFrame) -> Column:
    return F.col("tokens") if "tokens" in turns.columns else tokens(F.col("content"))


def ranked_turns(turns: DataFrame, query: str | Query) -> DataFrame:
    """Turns that match, with `rank`, BM25 over all searchable turns (higher is better): of words, phrases and beginnings of words, each by its own frequency.

    The frequencies are one row, broadcast; nothing runs before the result is asked for.
    """
    q = Query(query) if isinstance(query, str) else query
    docs = searchable(turns).withColumn("_t", _tokens_of(turns))
    units = [u for i, u in enumerate(q.units) if u not in q.units[:i]]
    counted = docs.select(F.size("_t").alias("_size"), *[_times(u, F.col("_t")).alias(f"_tf{i}") for i, u in enumerate(units)])
    stats = counted.agg(F.lit(1).alias("_1"), F.count("*").alias("_n"), F.avg("_size").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(units))])
    hits = docs.where(q.match(F.col("_t"))).withColumn("_1", F.lit(1)).join(F.broadcast(stats), "_1")
    score = F.lit(0.0)
    for i, u in enumerate(units):
        tf = _times(u, F.col("_t")).cast("double")
        idf = F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("_t") / F.nullif(F.col("_avg"), F.lit(0.0))))
    return hits.withColumn("rank", F.round(F.coalesce(score, F.lit(0.0)), 9)).drop("_1", "_n", "_avg", *[f"_df{i}" for i in range(len(units))])


def snippet(toks: Column, q: Query, width: int = 16) -> Column:
    """`width` tokens, the first hit among them however narrow they are, hits in guillemets."""
    flags = F.transform(toks, lambda x: q.hit(x))
    first = F.greatest(F.array_position(flags, True) - F.lit(min(2, max(width - 1, 0))), F.lit(1))
    part = F.slice(toks, first.cast("int"), width)
    return F.array_join(F.transform(part, lambda x: F.when(q.hit(x), F.concat(F.lit("«"), x, F.lit("»"))).otherwise(x)), " ")


def marked(text: Column, q: Query) -> Column:
    """The text itself, its words that the ranking counts in guillemets; guillemets of its own become single ones."""
    words, starts = q.ranked_words()
    letters = r"[\p{L}\p{N}]"
    units = "|".join([*sorted(words, key=lambda w: (-len(w), w)), *[f"{p}{letters}*" for p in starts]])
    own = F.translate(text, "«»", "‹›")
    return F.regexp_replace(own, f"(?iu)(?<!{letters})(?:{units})(?!{letters})", "«$0»") if units else own


def limit_of(n: int | None, most: int = 200, default: int = 20) -> int:
    """Out of range means the default, not the nearest end."""
    return n if n and 0 < n <= most else default


def search(t: Tables, query: str, f: SessionFilter | None = None, limit: int | None = None, plain: bool = False, width: int = 16, columns: int | None = None) -> DataFrame:
    """The best turn of each session, best first; ties by session and turn. plain: the query is words, all of which must stand.

    The snippet is of `width` tokens; with columns, as much of the text itself around its first hit as fits a line of so many.
    """
    q = Query.plain(query) if plain else Query(query)
    s = apply(t, f).select("id", "agent", "started_at")
    hits = ranked_turns(t.turns, q).join(s.withColumnRenamed("id", "session_id"), "session_id")
    best = Window.partitionBy("session_id").orderBy(F.desc("rank"), "id")
    hits = hits.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    out = hits.select("session_id", "agent", "started_at", F.col("id").alias("turn_id"), "ts", "role", "kind", "tool_name", F.lit("content").alias("match_field"), "rank", (snippet(F.col("_t"), q, width) if columns is None else marked(F.col("content"), q)).alias("snippet"))
    out = out.orderBy(F.desc("rank"), "session_id").limit(limit_of(limit))
    return out if columns is None else out.withColumn("snippet", fitted(F.col("snippet"), columns))


def matching_sessions(t: Tables, query: str, f: SessionFilter | None = None) -> DataFrame:
    """(session_id, turns) of the sessions with a turn that matches; no ranking, so one pass."""
    q = Query(query)
    hit = searchable(t.turns).where(q.match(_tokens_of(t.turns))).groupBy("session_id").agg(F.count("*").alias("turns"))
    return hit.join(apply(t, f).select(F.col("id").alias("session_id")), "session_id", "left_semi")
