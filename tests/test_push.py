"""Sessions and their raw files come in together or not at all."""

import hashlib
from datetime import datetime, timedelta

import pytest

from logloom.schema import DEVICES, KINDS, SESSIONS, TOOLS, TURNS, USAGE, Tables
from logloom.streaming import push as p
from logloom.streaming.store import SCHEMAS, Store

AT = datetime(2026, 5, 1, 10)
NOW = datetime(2026, 5, 2)


def made(spark, bodies, **claims):
    """Tables and raw files of {id: body}; claims: another size or hash than the body's."""
    h = lambda b: hashlib.sha256(b).hexdigest()
    s = [(i, "codex", f"dev-{i[0]}", None, None, None, AT, AT, "p", "m", f"file:///x/{i}.jsonl", claims.get("raw_hash", h(b)), claims.get("raw_size", len(b)), None, "default") for i, b in bodies.items()]
    turns = [(0, i, "user", b.decode(), AT, "message", None) for i, b in bodies.items()]
    rest = [spark.createDataFrame([], x) for x in (TOOLS, USAGE, KINDS)]
    devices = spark.createDataFrame([(d, "n") for d in {f"dev-{i[0]}" for i in bodies}], DEVICES)
    files = spark.createDataFrame([(f"file:///x/{i}.jsonl", bytearray(b)) for i, b in bodies.items()], "raw_uri string, body binary")
    return Tables(spark.createDataFrame(s, SESSIONS), spark.createDataFrame(turns, TURNS), *rest, devices), files


def state(store):
    t = store.read()
    said = {r["session_id"]: r["content"] for r in t.turns.collect()}
    raw = {r["session_id"]: (r["key"], bytes(r["body"]).decode()) for r in p.raw_files(store).collect()}
    return {r["id"] for r in t.sessions.collect()}, said, raw


def orphans(path, store):
    done = {f"batch={b}" for b in store.batches()}
    return [x for name in SCHEMAS for x in (path / name).glob("batch=*") if x.name not in done] + [x for x in (path / "log").glob(".0*") if x.suffix != ".crc"]


class Refused(Exception):
    pass


def test_failures_leave_no_orphan(spark, tmp_path, monkeypatch):
    """A push fails after each of its steps, a first one and one that brings a session anew: nothing of it is left, and what was there stays."""
    store = Store(spark, str(tmp_path), buckets=2)
    assert p.push(store, *made(spark, {"a1": b"one", "b1": b"two"}), NOW).taken == 2
    before = state(store)
    assert before[2]["a1"] == ("codex/2026/05/a1.jsonl", "one")
    write, steps = Store.write, ("raw", "synced", "sessions", "turns", "ledger")
    for step in steps:

        def refuse(self, batch, name, rows, step=step):
            write(self, batch, name, rows)
            if name == step:
                raise Refused

        monkeypatch.setattr(Store, "write", refuse)
        with pytest.raises(Refused):
            p.push(store, *made(spark, {"a1": b"one and more", "c1": b"three"}), NOW)
        monkeypatch.undo()
        assert orphans(tmp_path, store) == []
    monkeypatch.setattr(Store, "commit", lambda *a: (_ for _ in ()).throw(Refused()))
    with pytest.raises(Refused):
        p.push(store, *made(spark, {"a1": b"one and more", "c1": b"three"}), NOW)
    monkeypatch.undo()
    assert orphans(tmp_path, store) == [] and state(store) == before
    done = p.push(store, *made(spark, {"a1": b"one and more", "b1": b"two", "c1": b"three"}), NOW)
    assert (done.taken, done.skipped) == (2, 1)
    ids, said, raw = state(store)
    assert ids == {"a1", "b1", "c1"} and said["a1"] == "one and more" == raw["a1"][1] and raw["b1"][1] == "two"
    with pytest.raises(ValueError, match="committed"):
        store.discard(done.batch)


def test_rejected_skipped_and_stale(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=2)
    bad = p.push(store, *made(spark, {"a1": b"one"}, raw_size=9), NOW)
    assert (bad.batch, bad.taken) == (None, 0) and [r["reason"] for r in bad.rejected.collect()] == ["raw size mismatch"]
    t, files = made(spark, {"a1": b"one", "no..good": b"x"})
    got = p.push(store, t, files, NOW)
    assert got.taken == 1 and [(r["id"], r["reason"]) for r in got.rejected.collect()] == [("no..good", "bad id")]
    assert p.push(store, *made(spark, {"a1": b"one"}), NOW).skipped == 1 and len(store.batches()) == 1
    assert p.push(store, *made(spark, {"a1": b"one"}), NOW, overwrite=True).taken == 1
    # the first batch's raw file is of no session's last state any more
    assert p.collect_stale(store) == [store.batches()[0]] and p.collect_stale(store) == []
    assert state(store)[2] == {"a1": ("codex/2026/05/a1.jsonl", "one")}


def test_last_syncs_are_touched_once_a_minute(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=2)
    seen = lambda: {r["id"]: r["last_sync"] for r in p.last_syncs(store).collect()}
    p.push(store, *made(spark, {"a1": b"1"}), NOW)
    p.push(store, *made(spark, {"a1": b"2", "b1": b"2"}), NOW + timedelta(seconds=30))
    assert seen() == {"dev-a": NOW, "dev-b": NOW + timedelta(seconds=30)}
    p.push(store, *made(spark, {"a1": b"3"}), NOW + timedelta(seconds=90))
    assert seen()["dev-a"] == NOW + timedelta(seconds=90)
