"""Windows over marked texts, times told from now, and the rows of the timeline."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions import display
from logloom.operators import search, sinks
from logloom.schema import DEVICES, KINDS, SESSIONS, TOOLS, TURNS, USAGE, Tables

NOW = datetime(2026, 5, 10, 12)


def columns(text):
    return sum(display.width(c) for c in text if c not in "«»")


@pytest.mark.parametrize(
    "text, n, want",
    [
        ("a «hit» here", 20, "a «hit» here"), ("  a \n\t«hit»\x07 here ", 20, "a «hit» here"), ("a «hit» here", 10, "a «hit» here"), ("a «hit» here", 9, "a «hit» he…"), ("", 5, ""), ("abc", 0, ""), ("abcdef", 3, "ab…"),
        # the mark beyond two thirds: a third of the line stands before it
        ("one two three four «five» six seven", 12, "…our «five» s…"), ("one two three four «five»", 12, "…our «five»"),
        # wide characters take two columns, marks on others none
        ("日本語の«検索»です", 9, "…の«検索»…"), ("日本語«検索»です", 9, "日本語«検»…"), ("ééé «x»", 5, "ééé «x»"),
        # a mark that is cut stays a pair; later marks too
        ("«abcdefgh» x", 5, "«abcd»…"), ("«ab» «cd» «ef»", 6, "«ab» «cd»…"), ("no mark at all in this", 10, "no mark a…"), ("x" * 30 + "«y»", 1, "…"), ("x" * 30 + "«y»", 2, "…«y»"), ("x" * 30 + "«yz»", 2, "…"),
    ],
)
def test_window(text, n, want):
    assert display.window(text, n) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab 語é́x", max_size=9), st.booleans()), max_size=9), st.integers(1, 40))
def test_window_holds_the_first_mark(parts, n):
    """Never wider than the line, marks in pairs, and the first marked character within it wherever it stands."""
    text = "".join(f"«{t}»" if m else t for t, m in parts)
    got = display.window(text, n)
    assert columns(got) <= n
    inside = False
    for c in got:
        assert (c != "«" or not inside) and (c != "»" or inside)
        inside = c == "«" or inside and c != "»"
    assert not inside
    flat = display.plain(text)
    if n >= 6 and any(flat[i + 1] not in "» " and display.width(flat[i + 1]) for i, c in enumerate(flat[:-1]) if c == "«"):
        assert "«" in got


def test_ago(spark):
    at = [0, 59, 60, 3599, 3600, 7200, 86400, 6 * 86400, 7 * 86400, 29 * 86400, 30 * 86400, 364 * 86400, 365 * 86400, 800 * 86400, -90]
    df = spark.createDataFrame([(k, NOW - timedelta(seconds=s)) for k, s in enumerate(at)] + [(99, None)], "k int, at timestamp")
    got = [r[0] for r in df.orderBy("k").select(display.ago(F.col("at"), F.lit(NOW))).collect()]
    assert got == ["just now", "just now", "1min ago", "59min ago", "1h ago", "2h ago", "1d ago", "6d ago", "1w ago", "4w ago", "1mo ago", "12mo ago", "1y ago", "2y ago", "1min ago", ""]


def star(spark, sessions, turns=(), tools=()):
    rest = [spark.createDataFrame([], x) for x in (USAGE, KINDS)]
    return Tables(spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame(turns, TURNS), spark.createDataFrame(tools, TOOLS), *rest, spark.createDataFrame([("d1", "laptop"), ("d2", "")], DEVICES))


def session(i, started, minutes, prompt, device="d1", path=None):
    return (i, "claude-code", device, path, None, None, started, started + timedelta(minutes=minutes), prompt, None, None, None, 0, None, "default")


def test_timeline_rows(spark):
    t = star(spark, [
        session("s1", NOW - timedelta(minutes=30), 21, "fix  the\nbug", path="/home/u/proj"), session("s2", NOW - timedelta(minutes=30, seconds=1), 20, "<command-name>/clear</command-name>", "d2"),
        session("s3", NOW - timedelta(days=1), 0, None, None), session("s4", NOW - timedelta(days=9), 1, "old"),
    ], tools=[("s1", n, c) for n, c in (("a", 5), ("b", 7), ("c", 5), ("d", 1))])
    rows = [tuple(r) for r in sinks.timeline_rows(t, F.lit(NOW)).collect()]
    assert rows[0] == ("Today", "11:30", True, "claude", "laptop", "proj", "fix the bug", False, "s1", "21m · b ×7, a ×5, c ×5", "9min ago")
    assert rows[1][2:] == (False, "claude", "d2", "(unscoped)", "(meta)", True, "s2", "20m", "10min ago")
    assert rows[2][0] == "Yesterday" and rows[2][6:8] == ("(meta)", True) and rows[2][4] is None
    assert rows[3][0] == "2026-05-01" and rows[3][-1] == "1w ago"


def test_paths_without_identity(spark):
    t = star(spark, [session("a", NOW, 1, None, path="/x"), session("b", NOW, 1, None, path="/x"), session("c", NOW, 1, None, path=""), session("d", NOW, 1, None), session("e", NOW, 1, None, path="/y")])
    s = t.sessions.withColumn("project_marker", F.when(F.col("id") == "e", "m"))
    assert [r[0] for r in sinks.paths_without_identity(s).collect()] == ["/x"]


def test_snippets_of_so_many_columns(spark):
    """The text itself around its first hit, its own guillemets single."""
    said = "A long «introduction» that nobody looks for, with Foo-Bar and foobar, then Straße and the QUANTUM whale swims"
    t = star(spark, [session("a", NOW, 1, None)], [(1, "a", "user", said, NOW, "message", None)])
    show = lambda q, n: search.search(t, q, columns=n).first()["snippet"]
    assert show("quantum", 200) == said.replace("«", "‹").replace("»", "›").replace("QUANTUM", "«QUANTUM»")
    assert show("quantum OR wha*", 24) == "…and the «QUANTUM» «whale» …"
    assert show('"foo bar"', 30).count("«") == 2 and "«Foo»-«Bar»" in show('"foo bar"', 30) and "«Straße»" in show("straße", 40)
