"""Batches count wholly or not at all; what grows is read again; passes read what came since the last."""

import hashlib
import json
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.schema import DEVICES, KINDS, SESSIONS, TOOLS, TURNS, USAGE, Tables
from logloom.sources import histories, jsonl
from logloom.streaming import ingest, store
from logloom.streaming.store import Store

AT = datetime(2026, 5, 1, 10)


def tables(spark, sessions):
    """sessions {id: (prompt, [what the user said])} as canonical tables, each with a tool, usage, a kind and a device."""
    s = [(i, "codex", f"d-{i}", None, None, None, AT, AT, prompt, "m", f"file:///{i}", f"hash {len(said)}", 1, None, "default") for i, (prompt, said) in sessions.items()]
    turns = [(n, i, "user", text, AT, "message", None) for i, (_, said) in sessions.items() for n, text in enumerate(said)]
    each = lambda *x: [tuple(i if v is ... else v for v in x) for i in sessions]
    rows = (s, turns, each(..., "grep", 2), each(..., 7, 1, 1, 1, 1, 1), each(..., "goal"), each(..., "name"))
    return Tables(*[spark.createDataFrame(r, x) for r, x in zip(rows, (SESSIONS, TURNS, TOOLS, USAGE, KINDS, DEVICES), strict=True)])


def state(spark, path):
    t = ingest.read(spark, path)
    count = lambda df: {r["session_id"]: r["count"] for r in df.groupBy("session_id").count().collect()}
    return {r["id"]: r["first_prompt"] for r in t.sessions.collect()}, count(t.turns), count(t.tools), count(t.usage), count(t.kinds), t.devices.count()


FIRST = {"a": ("one", ["x"]), "b": ("two", ["y", "z"])}
THEN = {"b": ("two more", ["y", "z", "w"]), "c": ("three", ["v"])}
OLD = ({"a": "one", "b": "two"}, {"a": 1, "b": 2}, {"a": 1, "b": 1}, {"a": 1, "b": 1}, {"a": 1, "b": 1}, 2)
NEW = ({"a": "one", "b": "two more", "c": "three"}, {"a": 1, "b": 3, "c": 1}, *[dict.fromkeys("abc", 1)] * 3, 3)


class Died(Exception):
    pass


def test_half_a_batch_is_none(spark, tmp_path, monkeypatch):
    """A writer dies after each of the seven folders, and while it commits: the old state is read each time, and what is left of it can be removed."""
    path = str(tmp_path / "store")
    Store(spark, path, buckets=2).append(tables(spark, FIRST))
    new, write, left = tables(spark, THEN), Store.write, []
    for dies in ("sessions", "turns", "tools", "usage", "kinds", "devices", "ledger"):

        def dying(self, batch, name, rows, dies=dies):
            write(self, batch, name, rows)
            if name == dies:
                left.append(batch)
                raise Died

        monkeypatch.setattr(Store, "write", dying)
        with pytest.raises(Died):
            ingest.append(new, path)
        monkeypatch.setattr(Store, "write", write)
        if dies in ("sessions", "ledger"):
            assert state(spark, path) == OLD
    monkeypatch.setattr(store.Files, "rename", lambda *a: (_ for _ in ()).throw(Died()))
    with pytest.raises(Died):
        ingest.append(new, path)
    monkeypatch.undo()
    assert state(spark, path) == OLD and len(Store(spark, path).batches()) == 1
    changed = ingest.changes(spark, path).writeStream.format("memory").queryName("told").trigger(availableNow=True).start()
    changed.awaitTermination()
    assert {r["id"] for r in spark.table("told").collect()} == {"a", "b"}
    ingest.append(new, path)
    assert state(spark, path) == NEW
    s = Store(spark, path)
    assert s.vacuum() == [] and set(left) < set(s.vacuum(hours=-1)) and state(spark, path) == NEW
    assert sorted(p.name for p in (tmp_path / "store" / "turns").glob("batch=*")) == [f"batch={b}" for b in s.batches()]


def test_writers_at_once(spark, tmp_path):
    """Both batches count; of a session that both bring, the one of the later number."""
    path, failed = str(tmp_path / "store"), []
    s = Store(spark, path, buckets=2)
    ids = [s.next_batch(), s.next_batch()]
    parts = [tables(spark, {"a": ("one", ["x"]), f"own{k}": ("p", ["q"])}) for k in range(2)]

    def write(k):
        try:
            Store(spark, path, buckets=2).append(parts[k], ids[k])
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and s.batches() == sorted(ids)
    assert state(spark, path)[:2] == ({"a": "one", "own0": "p", "own1": "p"}, {"a": 1, "own0": 1, "own1": 1})


def test_reading_shuffles_nothing(spark, tmp_path):
    """Buckets bring a session's rows of all batches together: no exchange of turns, sessions or their children."""
    path = str(tmp_path / "the user's store")
    for part in (FIRST, THEN):
        Store(spark, path, buckets=3).append(tables(spark, part))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = ingest.read(spark, path)
        for df in (t.sessions, t.turns, t.tools, t.usage):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert state(spark, path) == NEW
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def put(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as f:
        f.writelines(json.dumps(r) + "\n" for r in records)


def said(sid, text, minute):
    return {"type": "user", "sessionId": sid, "timestamp": f"2026-05-01T10:{minute:02d}:00Z", "message": {"content": text}}


U = [f"{k}{k}{k}{k}{k}{k}{k}{k}-1111-1111-1111-111111111111" for k in "123"]


def test_growing_files(spark, tmp_path):
    """A file that grows between triggers is read again by the same stream, from its checkpoint; one that did not change is not."""
    raw, path = tmp_path / "raw folder", str(tmp_path / "store")
    run = lambda importer=jsonl.claude_code: ingest.start(ingest.watch(spark, str(raw), str(tmp_path / "seen")), path, importer, str(tmp_path / "ck"), files_at_once=5).awaitTermination()
    put(raw / "my project" / f"{U[0]}.jsonl", said(U[0], "first", 0))
    put(raw / f"{U[1]}.jsonl", said(U[1], "second", 1))
    run()
    put(raw / "my project" / f"{U[0]}.jsonl", said(U[0], "more", 2))

    def dies(spark, names):
        raise Died(names)

    with pytest.raises(Exception, match="Died"):
        run(dies)
    put(raw / "my project" / f"{U[0]}.jsonl", said(U[0], "and more", 3))
    run()
    run()
    t = ingest.read(spark, path)
    assert sorted(r["content"] for r in t.turns.collect()) == ["and more", "first", "more", "second"]
    told = Store(spark, path).table("sessions").groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in told}[U[1]] == 1
    assert len(list((tmp_path / "seen").iterdir())) <= 2  # listings before the last batch's are gone


def test_a_replayed_listing_gives_the_same_rows(tmp_path):
    """Hashes are of the bytes that the listing saw; hidden files, other names and the folder of listings are passed over."""
    for name, text in (("a.jsonl", "one"), ("deep/b c%20.jsonl", "two"), (".hidden/x.jsonl", "no"), ("_temp/x.jsonl", "no"), ("c.txt", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    source = histories.HistorySource({"path": str(tmp_path), "state": str(tmp_path / ".seen"), "files": "1"}).streamReader(None)
    start, end = source.initialOffset(), source.latestOffset()
    assert source.latestOffset() == end == {"listing": 1}
    rows = lambda a, b: [r for p in source.partitions(a, b) for r in source.read(p)]
    h = lambda x: hashlib.sha256(x).hexdigest()
    want = [(f"file://{tmp_path}/a.jsonl", 3, h(b"one")), (f"file://{tmp_path}/deep/b c%20.jsonl", 3, h(b"two"))]
    assert rows(start, end) == want
    (tmp_path / "a.jsonl").write_text("one and more")
    assert rows(start, end) == want
    later = source.latestOffset()
    assert rows(end, later) == [(f"file://{tmp_path}/a.jsonl", 12, h(b"one and more"))] and rows(later, later) == []
    (tmp_path / "deep/b c%20.jsonl").unlink()
    assert rows(start, end) == want[:1][:0] + [(f"file://{tmp_path}/a.jsonl", 3, h(b"one"))]
    source.commit(later)
    assert source._numbers() == [2]


def test_the_source_reads_batches_too(spark, tmp_path):
    put(tmp_path / "x y" / "a+b.jsonl", {"k": 1})
    spark.dataSource.register(histories.HistorySource)
    got = spark.read.format("logloom_histories").option("path", str(tmp_path)).load().collect()
    want = jsonl.raw_facts(spark, str(tmp_path), "*.jsonl").collect()
    assert [(r["file"], r["size"], r["raw_hash"]) for r in got] == [(r["file"], r["raw_size"], r["raw_hash"]) for r in want]
    none = spark.read.format("logloom_histories").option("path", str(tmp_path / "none")).load()
    assert none.collect() == []


def test_passes_take_what_came_since(spark, tmp_path, monkeypatch):
    """A first prompt that is an injected message is put right in a batch of its own; a second run looks at nothing; what is brought anew is looked at anew."""
    path = str(tmp_path / "store")
    noise = "<command-name>/clear</command-name>"
    assert spark.range(1).select(ingest.filters.starts_as_boilerplate(F.lit(noise))).first()[0]
    s = Store(spark, path, buckets=2)
    s.append(tables(spark, {"a": (noise, [noise, "what I want"]), "b": ("fine", ["fine"]), "c": (noise, [noise])}))
    assert ingest.run_passes(spark, path) == 1
    assert state(spark, path)[0] == {"a": "what I want", "b": "fine", "c": noise}
    assert len(s.batches()) == 2
    monkeypatch.setattr(Store, "current", lambda *a: pytest.fail("it reads"))
    assert ingest.run_passes(spark, path) == 0
    monkeypatch.undo()
    s.append(tables(spark, {"a": (noise, [noise, "something else"]), "d": (noise, ["hello"])}))
    assert state(spark, path)[0]["a"] == noise  # until the next pass
    assert ingest.run_passes(spark, path) == 2
    assert state(spark, path)[0] == {"a": "something else", "b": "fine", "c": noise, "d": "hello"}
    ingest.compact(spark, path, str(tmp_path / "small"), buckets=3)
    assert state(spark, str(tmp_path / "small"))[0] == state(spark, path)[0] and Store(spark, str(tmp_path / "small")).buckets() == 3
