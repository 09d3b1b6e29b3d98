"""Cursor and Antigravity: databases as they write them, made here."""

import hashlib
import json
import sqlite3
from datetime import datetime

import pytest

from logloom.sources import sqlite as sq
from logloom.sources import wire

AGENT = "5b0c7a4e-93d1-4c28-8f60-1d2e3f4a5b6c"


def number(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)


def field(n, value):
    if isinstance(value, int):
        return number(n << 3) + number(value)
    value = value.encode() if isinstance(value, str) else value
    return number(n << 3 | 2) + number(len(value)) + value


# -- wire --------------------------------------------------------------------------------------


def test_fields():
    assert wire.fields(b"") == ([], True)
    assert wire.fields(field(4, 70_000) + field(9, "teapot")) == ([(4, 0, 70_000), (9, 2, b"teapot")], True)
    assert wire.fields(bytes([2 << 3 | 5]) + b"wxyz" + bytes([8 << 3 | 1]) + b"eightish")[0] == [(2, 5, b"wxyz"), (8, 1, b"eightish")]
    assert wire.fields(field(6, 31) + b"\x1a\x55") == ([(6, 0, 31)], False)
    assert wire.fields(b"\x80") == ([], False) and wire.fields(b"\x00\x01") == ([], False)


def test_strings_go_into_messages():
    inner = field(5, "kettle")
    assert [*wire.strings(field(2, inner + field(4, 3)) + field(7, "teapot"))] == ["kettle", "teapot"]
    deep = field(1, "far down")
    for _ in range(10):
        deep = field(2, 1) + field(1, deep)  # the integer keeps it from being read as text
    assert [*wire.strings(deep)] == []


@pytest.mark.parametrize("b, want", [(b"some plain words", True), ("naïve\n\tindented line".encode(), True), (b"", False), (b"\x03bell\x07", False), (b"cut \xc3", False)])
def test_readable(b, want):
    assert (wire.readable(b) is not None) == want


def test_tool_calls():
    pair = field(1, "grep_search") + field(2, '{"Query":"todo","toolAction":"Searching"}')
    assert sq.tool_call(field(7, pair + field(3, 1))) == ("grep_search", '{"Query":"todo","toolAction":"Searching"}')
    assert sq.tool_call(field(1, "find_files") + field(2, '{"toolAction":"Opening"}'))[0] == "find_files"
    assert sq.tool_call(field(1, "only some prose")) == (None, None)
    assert sq.first_text(field(1, '{"toolAction":"Searching all of it"}') + field(2, "The build broke on the second try")) == "The build broke on the second try"
    assert sq.first_text(field(1, "brief")) is None


@pytest.mark.parametrize("s, want", [(x, True) for x in ("grep_search", "find_files", "multi-edit", "planner")] + [(x, False) for x in ("", "2027", "src/main", "two words", "naïve", "y" * 65)])
def test_names(s, want):
    assert bool(sq._NAME.match(s)) == want


# -- Cursor ------------------------------------------------------------------------------------


def store(root, folder, agent, meta=None, blobs=(), tables=True, plain=False):
    path = root / folder / agent
    path.mkdir(parents=True)
    con = sqlite3.connect(path / "store.db")
    con.execute("CREATE TABLE x (i INT)" if not tables else "CREATE TABLE blobs (id TEXT PRIMARY KEY, data BLOB)")
    if tables:
        con.execute("CREATE TABLE meta (key TEXT PRIMARY KEY, value TEXT)")
        if meta is not None:
            text = json.dumps(meta)
            con.execute("INSERT INTO meta VALUES ('0', ?)", (text if plain else text.encode().hex(),))
        con.executemany("INSERT INTO blobs VALUES (?, ?)", [(str(i), b if isinstance(b, bytes) else json.dumps(b).encode()) for i, b in enumerate(blobs)])
    else:
        con.execute("DROP TABLE x")
    con.commit()
    con.close()


def say(role, *content):
    return {"role": role, "content": content[0] if isinstance(content[0], str) else list(content)}


def text(t):
    return {"type": "text", "text": t}


def call(name):
    return {"type": "tool-call", "toolName": name}


CREATED = 1_798_964_100_000  # 2027-01-03 08:15


@pytest.fixture(scope="module")
def cursor(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cursor")
    meta = {"agentId": AGENT, "createdAt": CREATED, "lastUsedModel": "gpt-5.1-codex"}
    store(root, "ws", "first", meta, [say("user", text("why is the night sky dark")), say("assistant", text("most stars are too far away"), call("Grep")), say("assistant", call("Grep"), call("Edit")), b"\x05\x00noise", {"kind": "index"}])
    store(root, "ws", "shell", tables=False)
    store(root, "ws", "norow")
    dirty = "<local-command-stdout>Theme is \x1b[4mdark\x1b[24m now</local-command-stdout>\nrename the config loader"
    store(root, "ws", "dirty", {"agentId": "dirty-1", "createdAt": CREATED}, [say("user", text(dirty))], plain=True)
    wrapped = [say("user", "<user_info>\nWorkspace Path: /home/me/told\nOS: x</user_info>"), say("user", "<timestamp>1</timestamp><user_query>\n fix it \n</user_query>"), say("assistant", "done")]
    store(root, "ws", "told", {"agentId": "told-1"}, wrapped)
    md5 = hashlib.md5(b"/home/me/proj").hexdigest()
    state = field(1, field(2, "/home/me/proj/src/a.go") + field(3, CREATED + 60_000)) + field(4, 99)
    store(root, md5, "digest", {"agentId": "digest-1", "createdAt": CREATED}, [*wrapped, state])
    store(root, md5, "plan", {"agentId": "plan-1", "currentPlanUri": "file:///home/me/planned/.cursor/plan-1.md"}, [state])
    (root / "ws" / "first" / "store.db-wal").write_bytes(b"a log")
    (root / "ws" / "none").mkdir()
    (root / "ws" / "none" / "store.db").write_bytes(b"no database")
    return sq.cursor(spark, str(root))


def test_cursor_sessions(cursor):
    s = {r["id"]: r for r in cursor.sessions.collect()}
    assert s.keys() == {AGENT, "shell", "norow", "dirty-1", "told-1", "digest-1", "plan-1"}
    r = s[AGENT]
    assert (r["agent"], r["model"], r["first_prompt"], r["started_at"]) == ("cursor", "gpt-5.1-codex", "why is the night sky dark", datetime(2027, 1, 3, 8, 15))
    assert s["shell"]["started_at"] is None and s["shell"]["model"] is None and s["norow"]["first_prompt"] is None
    assert s["dirty-1"]["first_prompt"] == "rename the config loader"
    assert s["told-1"]["first_prompt"] == "fix it"
    assert {k: r["project_path"] for k, r in s.items() if r["project_path"]} == {"told-1": "/home/me/told", "digest-1": "/home/me/proj", "plan-1": "/home/me/planned"}
    assert s["digest-1"]["last_activity_at"] == datetime(2027, 1, 3, 8, 16)


def test_cursor_turns_and_tools(cursor):
    turns = [(r["role"], r["content"]) for r in cursor.turns.where(f"session_id = '{AGENT}'").orderBy("seq").collect()]
    assert turns == [("user", "why is the night sky dark"), ("assistant", "most stars are too far away")]
    told = [r["content"] for r in cursor.turns.where("session_id = 'told-1'").orderBy("seq").collect()]
    assert told[1:] == ["fix it", "done"] and told[0].startswith("<user_info>")
    assert {(r["name"], r["count"]) for r in cursor.tools.where(f"session_id = '{AGENT}'").collect()} == {("Grep", 2), ("Edit", 1)}
    assert cursor.usage.count() == 0


# -- Antigravity -------------------------------------------------------------------------------

CASCADE, BASE = "e7d6c5b4-0a1b-4c2d-9e3f-708192a3b4c5", 1_801_234_567


def at(s, usage=None):
    time = field(1, field(1, BASE + s) + field(2, 640_250_000))
    return time + (field(9, b"".join(field(k, v) for k, v in usage.items())) if usage else b"")


def tool(name, args):
    return field(7, field(1, name) + field(2, args) + field(3, 1))


STEPS = [
    (0, 14, at(0), field(19, field(2, "schau dir das an"))), (1, 15, at(1, {2: 310, 3: 64, 4: 9, 5: 71}), field(20, field(1, "Reading it now"))),
    (2, 8, b"", tool("grep_search", '{"Query":"deadline","toolAction":"Searching"}')), (3, 15, at(3), None), (4, 21, at(4, {2: 17, 3: 3}), tool("find_files", '{"Pattern":"*.toml","toolAction":"Listing files"}')),
    (5, 132, None, tool("multi-edit", '{"toolAction":"Editing"}')), (6, 17, at(5), field(3, field(1, 1) + field(2, "the last command gave no output at all"))), (7, 14, at(5), field(19, field(2, "and another thing"))), (8, 23, at(6), None),
]


def trajectory(path, cascade=CASCADE, steps=STEPS, model=True):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE trajectory_meta (trajectory_id TEXT, cascade_id TEXT)")
    con.execute("CREATE TABLE trajectory_metadata_blob (id TEXT, data BLOB)")
    con.execute("CREATE TABLE steps (idx INT, step_type INT, status INT, metadata BLOB, step_payload BLOB)")
    con.execute("CREATE TABLE gen_metadata (idx INT, data BLOB, size INT)")
    if cascade:
        con.execute("INSERT INTO trajectory_meta VALUES ('t', ?)", (cascade,))
    con.execute("INSERT INTO trajectory_metadata_blob VALUES ('main', ?)", (field(1, "file:///home/me/work"),))
    con.executemany("INSERT INTO steps VALUES (?, ?, 3, ?, ?)", steps)
    con.execute("INSERT INTO gen_metadata VALUES (0, ?, 1)", (field(1, field(19, "gemini-4-mini-b") + field(2, 1)) if model else field(2, b"\x08\x01"),))
    if model == "executor":
        con.execute("CREATE TABLE executor_metadata (idx INT, data BLOB)")
        con.execute("INSERT INTO executor_metadata VALUES (0, ?)", (field(10, field(1, field(28, "gemini-4.2-pro-fast") + field(3, 1))),))
    con.commit()
    con.close()


@pytest.fixture(scope="module")
def antigravity(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("agy")
    trajectory(root / f"{CASCADE}.db")
    trajectory(root / "named.db", cascade="", steps=[], model="executor")
    trajectory(root / "late.db", cascade="late", steps=[(1, 14, None, field(19, field(2, "no time yet"))), (2, 15, at(9), field(20, field(1, "now")))], model=False)
    (root / "notes.md").write_text("# nothing here")
    (root / "empty.db").write_bytes(b"")
    return sq.antigravity(spark, str(root))


def test_antigravity_sessions(antigravity):
    s = {r["id"]: r for r in antigravity.sessions.collect()}
    assert s.keys() == {CASCADE, "named", "late"}
    r = s[CASCADE]
    assert (r["agent"], r["project_path"], r["model"], r["first_prompt"]) == ("antigravity", "/home/me/work", "gemini-4-mini-b", "schau dir das an")
    assert (r["started_at"], r["last_activity_at"]) == (datetime(2027, 1, 29, 14, 56, 7, 640250), datetime(2027, 1, 29, 14, 56, 13, 640250))
    assert s["named"]["model"] == "gemini-4.2-pro-fast" and s["named"]["started_at"] is not None and s["late"]["model"] is None


def test_antigravity_turns(antigravity):
    turns = [(r["role"], r["tool_name"], r["content"], r["ts"].second) for r in antigravity.turns.where(f"session_id = '{CASCADE}'").orderBy("seq").collect()]
    assert [t[:2] for t in turns] == [("user", None), ("assistant", None), ("tool", "grep_search"), ("tool", "find_files"), ("tool", "multi-edit"), ("assistant", None)]
    assert turns[5][2] == "the last command gave no output at all" and turns[2][2].startswith('{"Query"')
    # a step without a time has that of the step before it
    assert [t[3] - turns[0][3] for t in turns] == [0, 1, 1, 4, 4, 5]
    late = {r["content"]: r["ts"] for r in antigravity.turns.where("session_id = 'late'").collect()}
    assert late["no time yet"] is None and late["now"] is not None


def test_antigravity_usage_and_tools(antigravity):
    (u,) = antigravity.usage.collect()
    assert (u["session_id"], u["input_tokens"], u["output_tokens"], u["total_tokens"], u["cache_read_tokens"], u["cache_creation_tokens"]) == (CASCADE, 407, 67, 474, 71, 9)
    assert {(r["name"], r["count"]) for r in antigravity.tools.collect()} == {("grep_search", 1), ("find_files", 1), ("multi-edit", 1)}
