from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom import schema
from logloom.functions import text
from logloom.operators import filters, sinks
from logloom.operators.filters import SessionFilter
from logloom.plans import entities
from logloom.schema import DEVICES, KINDS, SESSIONS, TOOLS, TURNS, USAGE, Tables
from logloom.sources import bundle
from logloom.streaming import ingest

NOW = datetime(2026, 5, 20, 12, 30)


def test_windows():
    assert filters.last("45m", NOW) == (NOW - timedelta(minutes=45), NOW) and filters.last("7d", NOW)[0] == NOW - timedelta(days=7)
    assert filters.between("2026-01-01..2026-01-31") == (datetime(2026, 1, 1), datetime(2026, 1, 31, 23, 59, 59, 999999))
    for bad in ("7w", "0d", "-1h", ""):
        with pytest.raises(ValueError):
            filters.last(bad, NOW)
    for bad in ("2026-01-01", "2026-02-01..2026-01-01", "x..y"):
        with pytest.raises(ValueError):
            filters.between(bad)
    assert filters.window(NOW) == filters.last("7d", NOW) and filters.window(NOW, since_="2026-05-01") == (datetime(2026, 5, 1), NOW)
    with pytest.raises(ValueError):
        filters.window(NOW, last_="1d", since_="2026-05-01")
    assert filters.dashboard_window(NOW) == filters.last("30d", NOW) and filters.dashboard_window(NOW, "all")[0] == NOW - timedelta(days=36500)
    start, end = filters.heatmap_window(NOW)
    assert start.weekday() == 6 and end == NOW and (NOW.date() - start.date()).days // 7 == 52


def test_pages():
    assert entities.page_of(0) == (1, 1, 50, 0) and entities.page_of(101, 3, 50) == (3, 3, 50, 100)
    assert entities.page_of(101, 99, 25) == (5, 5, 25, 100) and entities.page_of(10, -3, 30) == (1, 1, 50, 0)


@pytest.fixture(scope="module")
def tables(spark):
    null = None
    rows = [
        ("a", "codex", "d1", "/w/proj", "git@x:o/r.git", null, datetime(2026, 5, 1, 10), "<command-name>/init</command-name>", "gpt-5", null, "default"),
        ("b", "codex", "d1", "/w/proj/sub", null, "mark", datetime(2026, 5, 2, 10), "real prompt", "gpt-5-pro", "a", "default"),
        ("c", "cursor", "d2", "/w/other", null, null, datetime(2026, 5, 3, 10), "# AGENTS.md instructions for x", null, null, "work"),
    ]
    s = spark.createDataFrame(rows, "id string, agent string, device_id string, project_path string, project_remote string, project_marker string, started_at timestamp, first_prompt string, model string, parent_session_id string, profile string")
    s = s.withColumns({"last_activity_at": F.col("started_at"), "raw_uri": F.concat(F.lit("/raw/"), "id", F.lit(".jsonl")), "raw_hash": F.sha2("id", 256), "raw_size": F.lit(1).cast("long")}).select(*[c.split()[0] for c in SESSIONS.split(", ")])
    turns = spark.createDataFrame(
        [(1, "a", "user", "<command-name>/init</command-name>", datetime(2026, 5, 1, 10), "message", null), (2, "a", "user", "do the  real work", datetime(2026, 5, 1, 10, 1), "message", null), (3, "c", "assistant", "hi", datetime(2026, 5, 3, 10), "message", null)], TURNS
    )
    usage = spark.createDataFrame([("a", 1000, 900, 100, 0, 0, 0), ("b", 1000, 900, 100, 0, 0, 0)], USAGE)
    return Tables(s, turns, spark.createDataFrame([], TOOLS), usage, spark.createDataFrame([("a", "goal")], KINDS), spark.createDataFrame([("d1", "laptop"), ("d2", "")], DEVICES))


def ids(df):
    return {r["id"] for r in df.collect()}


@pytest.mark.parametrize(
    "f, want",
    [
        (SessionFilter(project_path="/w/proj"), "a"), (SessionFilter(project_remote="git@x:o/r.git"), "a"), (SessionFilter(project_marker="mark"), "b"), (SessionFilter(top_level=True), "ac"), (SessionFilter(device="laptop"), "ab"),
        (SessionFilter(kinds=("goal",)), "a"), (SessionFilter(profiles=("work",)), "c"), (SessionFilter(since=datetime(2026, 5, 2, 10), until=datetime(2026, 5, 2, 10)), "b"),
    ],
)
def test_session_filters(tables, f, want):
    assert ids(filters.apply(tables, f)) == set(want)


def test_project_of_a_folder(tables):
    s = tables.sessions
    assert filters.project_of(s, "git@x:o/r.git", None, "/w").project_remote == "git@x:o/r.git"
    assert filters.project_of(s, "git@x:none", "mark", "/w").project_marker == "mark"
    assert filters.project_of(s, None, None, "/w/proj/sub/deep").project_path == "/w/proj/sub" and filters.project_of(s, None, None, "/w/project").project_path == "/w/project"


def test_project_key(spark):
    lines = ["# project: no", "", "name: x", "  project:  ", 'project: "foo bar"  # why', "project: later"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)] + [("g", 0, "project: 'one'"), ("h", 0, "projects: no")], "file string, line int, text string")
    assert {r["file"]: r["project"] for r in filters.project_key(df).collect()} == {"f": "foo bar", "g": "one"}


def test_boilerplate_prompts_are_replaced(tables):
    assert ids(filters.boilerplate(tables.sessions)) == {"a", "c"} and filters.boilerplate(tables.sessions, limit=1).count() == 1
    clean = filters.denoised(tables)
    assert {r["id"]: r["first_prompt"] for r in clean.collect()} == {"a": "do the real work", "b": "real prompt", "c": "# AGENTS.md instructions for x"}
    again = filters.denoised(Tables(clean, tables.turns, tables.tools, tables.usage, tables.kinds, tables.devices))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, clean.collect()))


def test_raw_integrity(spark, tables):
    files = spark.createDataFrame([("/raw/a.jsonl", "a"), ("/raw/b.jsonl", "x")], "raw_uri string, body string")
    good, bad = filters.sound_raw(tables.sessions, files)
    assert ids(good) == {"a"} and {r["id"]: r["reason"] for r in bad.collect()} == {"b": "raw hash mismatch", "c": "no raw file"}
    longer = filters.sound_raw(tables.sessions, files.withColumn("body", F.concat("body", F.lit("yz"))))[1]
    assert {r["reason"] for r in longer.where("id <> 'c'").collect()} == {"raw size mismatch"}


def test_cost_pages(tables):
    up, down = ([r["id"] for r in entities.by_cost(tables, descending=d).collect()] for d in (False, True))
    assert up == ["a", "b", "c"] and down == ["b", "a", "c"]
    assert [r["id"] for r in entities.by_cost(tables, limit=1, offset=1).collect()] == ["a"]
    feed = entities.grouped_feed(tables, descending=False).collect()
    assert [(r["id"], r["children"]) for r in feed] == [("a", 1), ("c", 0)] and feed[0]["cost_nano"] > feed[0]["own_cost_nano"]


def test_slots_and_devices(spark, tables):
    assert tuple(entities.slots(tables, tables.sessions).first()) == (True, True, None, None)
    one = tables.sessions.where("id = 'a'")
    assert tuple(entities.slots(tables, one).first()) == (False, False, "d1", "git@x:o/r.git")
    assert entities.slots(tables, tables.sessions, scoped=True).first()["project"] is False
    d = spark.createDataFrame([("x", None), ("y", datetime(2026, 1, 1)), ("z", datetime(2026, 2, 1))], "id string, fingerprinted_at timestamp")
    assert [r["id"] for r in entities.devices(d).collect()] == ["z", "y", "x"]


def test_last_sync(spark):
    d = spark.createDataFrame([("x", None), ("y", NOW - timedelta(seconds=30)), ("z", NOW - timedelta(hours=1)), ("w", NOW - timedelta(hours=1))], "id string, last_sync timestamp")
    got = {r["id"]: r["last_sync"] for r in sinks.touch_last_sync(d, d.where("id <> 'w'"), NOW).collect()}
    assert got == {"x": NOW, "y": NOW - timedelta(seconds=30), "z": NOW, "w": NOW - timedelta(hours=1)}


def test_raw_files_are_kept_by_key(spark, tables, tmp_path):
    sinks.preserve_raw(spark.createDataFrame([("/raw/a.jsonl", "body"), ("/raw/none", "x")], "file string, body string"), tables.sessions, str(tmp_path / "raw"))
    (r,) = spark.read.parquet(str(tmp_path / "raw")).collect()
    assert (r["key"], r["agent"], r["year"], r["month"], r["body"]) == ("a.jsonl", "codex", 2026, 5, "body")
    kept = spark.read.parquet(str(tmp_path / "raw"))
    assert sinks.raw_orphans(kept, tables.sessions).count() == 0 and sinks.raw_orphans(kept, tables.sessions.where("id <> 'a'")).count() == 1


def test_tables_are_written_and_read(spark, tables, tmp_path):
    tables.write(str(tmp_path / "t"))
    t = Tables.read(spark, str(tmp_path / "t"))
    assert ids(t.sessions) == {"a", "b", "c"} and t.turns.count() == 3 and t.ledger is None


def test_validation(spark, tables):
    bad = tables.sessions.limit(1)
    rows = tables.sessions.union(bad.withColumn("id", F.lit("a/b"))).union(bad.withColumn("id", F.lit("x..y"))).union(bad.withColumn("agent", F.lit("nobody"))).union(bad.withColumn("parent_session_id", F.lit("p q")))
    good, rejected = schema.validated(rows)
    assert good.count() == 3 and sorted(r["reason"] for r in rejected.collect()) == ["bad id", "bad id", "bad parent id", "unknown agent"]
    assert schema.without_nul(spark.createDataFrame([("a\0b", 1)], "x string, y int")).first()["x"] == "a b"


def test_binary_sniff(spark):
    cases = {b"": False, b"text \xc3\xa9": False, b"SQLite format 3\0rest": True, b"a\0b": True, b"\xff\xfe": True, b"x" * 4095 + "é".encode(): False, b"x" * 4093 + "😀".encode() + b"y": False, b"x" * 4000 + b"\xff" + b"y" * 200: True, b"x" * 5000 + b"\0": False, b"caf\xc3(": True}
    df = spark.createDataFrame([(bytearray(b),) for b in cases], "b binary")
    got = [r[0] for r in df.select(text.is_binary(F.col("b"))).collect()]
    assert got == [*cases.values()]


def test_agent_names(spark):
    df = spark.createDataFrame([("claude-code",), ("grok-build",), ("codex",), ("my-own_agent",)], "a string")
    assert [tuple(r) for r in df.select(text.display_agent(F.col("a")), text.agent_short(F.col("a"))).collect()] == [("Claude Code", "claude"), ("Grok Build", "grok"), ("Codex", "codex"), ("My Own Agent", "my-own_agent")]


def test_bundle(spark, tmp_path):
    import sqlite3

    zstandard = pytest.importorskip("zstandard")
    (tmp_path / "raw" / "sources").mkdir(parents=True)
    con = sqlite3.connect(tmp_path / "catalogue.sqlite")
    con.execute("CREATE TABLE source_files (source_tool TEXT, path TEXT, object_id TEXT, size_bytes INT)")
    con.executemany("INSERT INTO source_files VALUES (?, ?, ?, ?)", [("claude", "/u/x/one.jsonl", "blake3:aa", 3), ("codex", "/u/two.jsonl", "blake3:bb", 3), ("hermes", "/u/h", "blake3:cc", 1), ("gemini", "/u/g", "sha1:dd", 1), ("cursor", "/u/store.db", "blake3:ee", 1), ("gemini", "/u/e", "blake3:", 1)])
    con.commit()
    con.close()
    (tmp_path / "raw" / "sources" / "aa.zst").write_bytes(zstandard.ZstdCompressor().compress(b"one"))
    (tmp_path / "raw" / "sources" / "aa.bin").write_bytes(b"not this")
    (tmp_path / "raw" / "sources" / "bb.bin").write_bytes(b"two")
    assert {r["object"] for r in bundle.source_files(spark, str(tmp_path)).collect()} == {"aa", "bb", "ee"}
    got = bundle.restored(spark, str(tmp_path))
    assert {(r["tool"], r["path"]): bytes(r["body"]) for r in got.collect()} == {("claude", "/u/x/one.jsonl"): b"one", ("codex", "/u/two.jsonl"): b"two"}
    files = {r["tool"]: r["file"] for r in bundle.restore(got, str(tmp_path / "out")).collect()}
    assert open(files["claude"], "rb").read() == b"one" and files["codex"].endswith("/codex/bb/two.jsonl")


def test_tallies(spark, tables, tmp_path):
    files = spark.createDataFrame([("/raw/a.jsonl", "h1"), ("/raw/b.jsonl", "h2"), ("/raw/z.jsonl", "h3")], "file string, raw_hash string")
    ingest.append_ledger(files.limit(1), str(tmp_path / "s"))
    got = {r["outcome"]: r["files"] for r in ingest.tallies(files, str(tmp_path / "s"), tables).collect()}
    assert got == {"unchanged": 1, "imported": 1, "skipped": 1}


def test_profiles(spark, tmp_path):
    import json

    from logloom.sources import jsonl, profiles

    folders = profiles.roots(str(tmp_path / "own"), {"work": str(tmp_path / "w"), "lab": str(tmp_path / "l")})
    assert [n for n, _ in folders] == ["default", "lab", "work"]
    for i, (_, p) in enumerate(folders):
        f = tmp_path / p / f"1111111{i}-1111-1111-1111-111111111111.jsonl"
        f.parent.mkdir()
        f.write_text(json.dumps({"type": "user", "sessionId": f.stem, "timestamp": "2026-05-01T10:00:00Z", "message": {"content": "hello"}}) + "\n")
    t = profiles.read_all(spark, jsonl.claude_code, folders)
    assert {r["profile"] for r in t.sessions.collect()} == {"default", "lab", "work"} and t.turns.count() == 3
    assert profiles.roots("x", {"default": "y"}) == [("default", "y")]
    with pytest.raises(ValueError):
        profiles.roots("x", {" ": "y"})
