import json
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.operators import search, sinks
from logloom.schema import Tables
from logloom.sources import jsonl
from logloom.sources.hermes import hermes
from logloom.streaming import ingest

U1, U2 = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222"


def put(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(json.dumps, records)) + "\n")


def line(sid, text, at):
    return {"type": "user", "sessionId": sid, "timestamp": f"2026-05-01T10:0{at}:00Z", "message": {"content": text}}


def hashed(spark, d):
    return jsonl.raw_facts(spark, str(d), "*.jsonl").select("file", "raw_hash")


def test_stream_sweep_and_changes(spark, tmp_path):
    raw, store = tmp_path / "raw", str(tmp_path / "store")
    put(raw / f"{U1}.jsonl", line(U1, "first", 0))
    run = lambda: ingest.start(ingest.watch(spark, str(raw), str(tmp_path / "seen")), store, jsonl.claude_code, str(tmp_path / "ck")).awaitTermination()
    run()
    assert [r["first_prompt"] for r in ingest.read(spark, store).sessions.collect()] == ["first"]
    put(raw / f"{U2}.jsonl", line(U2, "second", 1))
    put(raw / U2 / "subagents" / "agent-a.jsonl", line(U2, "child", 2))
    run()
    t = ingest.read(spark, store)
    assert {r["id"] for r in t.sessions.collect()} == {U1, U2, "agent-a"}
    assert [(r["session_id"], r["kind"]) for r in t.kinds.collect()] == [(U2, "orchestrator")]
    put(raw / f"{U1}.jsonl", line(U1, "first", 0), line(U1, "more", 3))
    assert ingest.sweep(spark, hashed(spark, raw), store, jsonl.claude_code, files_at_once=1) == 1
    assert ingest.sweep(spark, hashed(spark, raw), store, jsonl.claude_code) == 0
    t = ingest.read(spark, store)
    assert t.sessions.count() == 3 and t.turns.where(f"session_id = '{U1}'").count() == 2
    ingest.compact(spark, store, str(tmp_path / "small"))
    small = ingest.read(spark, str(tmp_path / "small"))
    assert (small.sessions.count(), small.turns.count(), small.kinds.count()) == (3, t.turns.count(), 1)
    q = ingest.changes(spark, store).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 4


def test_empty_store(spark, tmp_path):
    t = ingest.read(spark, str(tmp_path / "none"))
    assert t.sessions.count() == t.turns.count() == 0


@pytest.fixture
def star(spark, tmp_path):
    put(tmp_path / f"{U1}.jsonl", line(U1, "tab\there", 0), line(U1, "the end", 2))
    return jsonl.claude_code(spark, str(tmp_path))


def test_sinks(spark, star, tmp_path):
    assert [tuple(r) for r in sinks.timeline(star).collect()] == [("2026-05-01 10:00", "claude-code", "(unscoped)", 120, "", star.sessions.first()["first_prompt"])]
    sinks.write_tsv(sinks.timeline(star), str(tmp_path / "tsv"))
    assert len(spark.read.text(str(tmp_path / "tsv")).first()[0].split("\t")) == 6
    doc = sinks.session_documents(star).first()
    assert [x["role"] for x in doc["turns"]] == ["user", "user"] and doc["tools"] == []
    assert json.loads(sinks.ndjson(star.sessions.select(F.col("id").alias("ID"), "model")).first()[0]) == {"id": U1, "model": None}
    d = spark.createDataFrame([("a", "old"), ("b", "")], "id string, friendly_name string")
    n = spark.createDataFrame([("a", ""), ("b", "new"), ("c", None)], "id string, friendly_name string")
    assert {tuple(r) for r in sinks.upsert_devices(d, n).collect()} == {("a", "old"), ("b", "new"), ("c", None)}
    assert sinks.rebind_local(star.sessions, "dev9").first()["device_id"] == "dev9"
    known = spark.createDataFrame([("/x", "r", "m")], "project_path string, remote string, marker string")
    s = star.sessions.withColumn("project_path", F.lit("/x"))
    assert sinks.fill_identity(s, known).first()["project_remote"] == "r"
    body = spark.createDataFrame([(bytearray(b"0123456789"),)], "b binary").select(sinks.byte_range(F.col("b"), 8, 5).alias("x")).first()["x"]
    assert (bytes(body["bytes"]), body["eof"]) == (b"89", True)


def test_upsert_drops_what_hung_on_the_old(spark, star):
    new = Tables(star.sessions.withColumn("model", F.lit("m")), star.turns.limit(1), star.tools, star.usage, star.kinds, star.devices)
    t = sinks.upsert(star, new)
    assert t.sessions.first()["model"] == "m" and t.turns.count() == 1


def test_rank_counts_the_term(spark, star):
    hits = {r["content"]: r["rank"] for r in search.ranked_turns(star.turns, "end OR here").collect()}
    assert len(hits) == 2 and min(hits.values()) > 0


def test_hermes(spark, tmp_path):
    put(tmp_path / "sessions" / "h1.jsonl", {"role": "user", "content": "hello", "timestamp": 1777629600.5}, {"role": "assistant", "model": "m1", "content": [{"type": "text", "text": "hi"}], "timestamp": "2026-05-01T10:05:00Z", "token_count": 7, "tool_calls": [{"name": "grep"}]})
    put(tmp_path / "sessions" / "session_h2.json", {"session_id": "h2", "session_start": "2026-05-02T00:00:00Z", "last_updated": "2026-05-02T01:00:00Z", "model": "m2", "parent_session_id": " h1 ", "messages": [{"role": "user", "content": "again", "timestamp": "2026-05-02T00:10:00Z"}]})
    con = sqlite3.connect(tmp_path / "state.db")
    con.execute("CREATE TABLE sessions (id TEXT, model TEXT, started_at REAL, message_count INT)")
    con.execute("CREATE TABLE messages (id INTEGER, session_id TEXT, role TEXT, content TEXT, timestamp REAL)")
    con.executemany("INSERT INTO sessions VALUES (?, 'm3', 1777629600, ?)", [("h1", 1), ("h3", 2)])
    con.executemany("INSERT INTO messages VALUES (?, ?, 'user', ?, 1777629700)", [(1, "h1", "old"), (2, "h3", "from the database"), (3, "h3", "twice")])
    con.commit()
    con.close()
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "state.db").write_bytes(b"no database at all")
    t = hermes(spark, str(tmp_path))
    s = {r["id"]: r for r in t.sessions.collect()}
    assert {k: (r["model"], r["parent_session_id"], r["first_prompt"]) for k, r in s.items()} == {"h1": ("m1", None, "hello"), "h2": ("m2", "h1", "again"), "h3": ("m3", None, "from the database")}
    assert s["h1"]["started_at"] == datetime(2026, 5, 1, 10, 0, 0, 500000) and s["h2"]["last_activity_at"] == datetime(2026, 5, 2, 1)
    assert [tuple(r) for r in t.usage.select("session_id", "total_tokens").collect()] == [("h1", 7)]
    assert {(r["session_id"], r["content"]) for r in t.turns.collect()} == {("h1", "hello"), ("h1", "hi"), ("h2", "again"), ("h3", "from the database"), ("h3", "twice")}
    assert [tuple(r) for r in t.tools.collect()] == [("h1", "grep", 1)]


def _counted(spark, df, column):
    """df, and a count of the times that its rows are made."""
    made = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda x: made.add(1) or x, "string").asNondeterministic()
    return df.withColumn(column, mark(column)), made


def test_files_are_parsed_once(spark, tmp_path, monkeypatch):
    """All tables that are made of a folder cost one reading of it; before, each branch of each table read it anew."""
    for u, text in ((U1, "first"), (U2, "second")):
        put(tmp_path / f"{u}.jsonl", line(u, text, 0), {"type": "assistant", "sessionId": u, "timestamp": "2026-05-01T10:05:00Z", "message": {"content": [{"type": "tool_use", "name": "Read", "id": "1"}]}})
    read, counts = jsonl.files, []

    def files(*how):
        df, made = _counted(spark, read(*how), "body")
        counts.append(made)
        return df

    monkeypatch.setattr(jsonl, "files", files)
    t = jsonl.claude_code(spark, str(tmp_path))
    assert [t.sessions.count(), t.turns.count(), t.tools.count(), t.kinds.count()] == [2, 2, 2, 0]
    assert sum(c.value for c in counts) == 2


def test_sweep_hashes_each_file_once(spark, tmp_path):
    """A sweep in many batches reads the folder once for their sake; before, once a batch."""
    for i in range(7):
        put(tmp_path / "raw" / f"1111111{i}-1111-1111-1111-111111111111.jsonl", line(f"1111111{i}-1111-1111-1111-111111111111", f"text {i}", 0))
    files, made = _counted(spark, hashed(spark, tmp_path / "raw"), "raw_hash")
    assert ingest.sweep(spark, files, str(tmp_path / "store"), jsonl.claude_code, files_at_once=2) == 7
    assert made.value == 7 and ingest.read(spark, str(tmp_path / "store")).sessions.count() == 7
    assert ingest.sweep(spark, hashed(spark, tmp_path / "raw"), str(tmp_path / "store"), jsonl.claude_code, files_at_once=2) == 0
