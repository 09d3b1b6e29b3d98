import json
from datetime import datetime

import pytest

from logloom.sources import jsonl

U1, U2 = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222"


def put(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def usage(i, o, r=0, c=0):
    return {"input_tokens": i, "output_tokens": o, "cache_read_input_tokens": r, "cache_creation_input_tokens": c}


@pytest.fixture(scope="module")
def claude(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("claude")
    put(
        d / "p" / f"{U1}.jsonl",
        {"type": "summary", "sessionId": U1},
        "{not json",
        {"type": "user", "sessionId": U1, "cwd": "/w/a", "timestamp": "2026-05-01T10:00:00Z", "message": {"role": "user", "content": "<command-name>/x</command-name> please fix"}},
        {"type": "user", "isMeta": True, "timestamp": "2026-05-01T09:00:00Z", "message": {"content": "meta"}},
        {"type": "assistant", "requestId": "r1", "timestamp": "2026-05-01T10:00:05.5Z", "message": {"model": "<synthetic>", "usage": usage(10, 1), "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "Read"}]}},
        {"type": "assistant", "requestId": "r1", "timestamp": "2026-05-01T10:00:06Z", "message": {"model": "claude-opus-4-7", "usage": usage(10, 5, 3, 2), "content": [{"type": "tool_use", "id": "t2", "name": "Workflow"}, {"type": "text", "text": "more"}]}},
        {"type": "user", "timestamp": "2026-05-01T10:01:00Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "file body"}]}, {"type": "tool_result", "tool_use_id": "zz", "content": "plain"}]}},
        {"type": "assistant", "uuid": "u9", "timestamp": "2026-05-01T10:02:00Z", "message": {"model": "other", "usage": usage(1, 1), "content": "no blocks"}},
    )
    put(d / "p" / U1 / "subagents" / "agent-ab.jsonl", {"type": "user", "sessionId": U1, "timestamp": "2026-05-01T10:00:01Z", "message": {"content": "[\"looks like an array\"]"}})
    put(d / "p" / f"{U2}.jsonl", {"type": "assistant", "sessionId": U2, "timestamp": "2026-05-01T10:00:00Z", "message": {"usage": usage(0, 0), "content": []}})
    put(d / "p" / "notes.jsonl", {"type": "user", "sessionId": "n"})
    return jsonl.claude_code(spark, str(d))


def test_claude_sessions(claude):
    s = {r["id"]: r for r in claude.sessions.collect()}
    assert s.keys() == {U1, "agent-ab"}  # explicit zero usage is not taken in
    a = s[U1]
    assert (a["project_path"], a["model"], a["first_prompt"], a["parent_session_id"]) == ("/w/a", "claude-opus-4-7", "please fix", None)
    assert (a["started_at"], a["last_activity_at"]) == (datetime(2026, 5, 1, 9), datetime(2026, 5, 1, 10, 2))
    assert s["agent-ab"]["parent_session_id"] == U1 and s["agent-ab"]["first_prompt"] == '["looks like an array"]'


def test_claude_turns(claude):
    t = [(r["role"], r["kind"], r["content"], r["tool_name"]) for r in claude.turns.where(f"session_id = '{U1}'").orderBy("seq").collect()]
    assert t == [
        ("user", "message", "please fix", None), ("assistant", "message", "ok", None), ("assistant", "thinking", "hm", None), ("assistant", "message", "more", None),
        ("tool", "tool_result", "file body", "Read"), ("tool", "tool_result", "plain", None),
    ]
    assert {(r["name"], r["count"]) for r in claude.tools.collect()} == {("Read", 1), ("Workflow", 1)}


def test_claude_usage_and_kinds(claude):
    u = claude.usage.collect()
    assert [tuple(r) for r in u] == [(U1, 22, 16, 6, 3, 3, 2)]
    assert {(r["session_id"], r["kind"]) for r in claude.kinds.collect()} == {(U1, "workflow"), (U1, "orchestrator")}


def test_codex(spark, tmp_path):
    ts = lambda n: f"2026-05-01T10:00:{n:02d}Z"
    ev = lambda n, t, i, o, c: {"type": "event_msg", "timestamp": ts(n), "payload": {"type": "token_count", "info": {"total_token_usage": {"total_tokens": t, "input_tokens": i, "output_tokens": o, "cached_input_tokens": c}}}}
    put(
        tmp_path / "2026" / f"rollout-2026-{U1}.jsonl",
        {"type": "session_meta", "timestamp": ts(0), "payload": {"id": U1, "cwd": "/w", "source": {"subagent": {"thread_spawn": {"parent_thread_id": U2}}}}},
        {"type": "turn_context", "timestamp": ts(1), "payload": {"model": "gpt-5.4"}},
        {"type": "response_item", "timestamp": ts(2), "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "do it"}]}},
        {"type": "response_item", "timestamp": ts(3), "payload": {"type": "message", "role": "developer", "content": "scaffold"}},
        {"type": "response_item", "timestamp": ts(3), "payload": {"type": "function_call", "name": "shell", "call_id": "c1"}},
        {"type": "response_item", "timestamp": ts(4), "payload": {"type": "function_call_output", "call_id": "c1", "output": "done"}},
        {"type": "response_item", "timestamp": ts(5), "payload": {"type": "reasoning", "summary": [{"type": "summary_text", "text": "thought"}]}},
        ev(6, 50, 40, 10, 60), ev(7, 50, 41, 9, 5), ev(8, 20, 10, 10, 0),
    )
    put(tmp_path / "2025" / f"rollout-2025-{U2}.jsonl", {"type": "message", "timestamp": ts(1), "role": "user", "content": [{"type": "input_text", "text": "old style"}]}, {"type": "function_call", "timestamp": ts(2), "name": "shell", "call_id": "x"})
    t = jsonl.codex(spark, str(tmp_path))
    s = {r["id"]: r for r in t.sessions.collect()}
    assert s.keys() == {U1, U2} and (s[U1]["model"], s[U1]["project_path"], s[U1]["parent_session_id"]) == ("gpt-5.4", "/w", U2)
    assert [(r["role"], r["kind"], r["content"], r["tool_name"]) for r in t.turns.where(f"session_id = '{U1}'").orderBy("seq").collect()] == [
        ("user", "message", "do it", None), ("tool", "tool_result", "done", "shell"), ("assistant", "thinking", "thought", None)]
    assert [tuple(r)[1:5] for r in t.usage.collect()] == [(50, 41, 9, 5)]
    assert {(r["session_id"], r["kind"]) for r in t.kinds.collect()} == {(U2, "orchestrator")}


def test_gemini(spark, tmp_path):
    (tmp_path / "session-1.json").write_text(json.dumps({"sessionId": "g1", "messages": [
        {"id": "m1", "timestamp": "2026-05-01T10:00:00Z", "type": "user", "content": "hi"},
        {"id": "m2", "timestamp": "2026-05-01T10:00:09Z", "type": "gemini", "content": [{"text": "yo"}], "model": "gemini-2.5-pro", "tokens": {"input": 5, "output": 2, "thoughts": 1, "cached": 3, "total": 8}, "toolCalls": [{"name": "ls"}]},
        {"id": "m2", "type": "gemini", "content": "", "tokens": {"input": 500, "output": 2, "total": 502}}]}))
    (tmp_path / "logs.json").write_text(json.dumps([{"sessionId": i, "messageId": k, "type": "user", "message": f"m{k}", "timestamp": "2026-05-02T10:00:00Z"} for k, i in enumerate(["b", "a", "b"])]))
    t = jsonl.gemini(spark, str(tmp_path))
    assert {(r["id"], r["model"], r["first_prompt"]) for r in t.sessions.collect()} == {("g1", "gemini-2.5-pro", "hi"), ("b", None, "m0")}
    assert [tuple(r) for r in t.usage.collect()] == [("g1", 8, 5, 3, 3, 3, 0)]
    assert [(r["session_id"], r["name"]) for r in t.tools.collect()] == [("g1", "ls")]


def test_grok_build(spark, tmp_path):
    d = tmp_path / "enc" / "s1"
    d.mkdir(parents=True)
    (d / "summary.json").write_text(json.dumps({"info": {"id": "s1", "cwd": "/w"}, "created_at": "2026-05-01T10:00:00Z", "updated_at": "2026-05-01T11:00:00Z", "current_model_id": "grok-4.5-build"}))
    put(d / "chat_history.jsonl", {"type": "user", "content": "<user_query>\nask me\n</user_query>", "prompt_index": 0}, {"type": "user", "content": "synthetic", "prompt_index": 1, "synthetic_reason": "x"}, {"type": "assistant", "content": "sure", "tool_calls": [{"id": "t", "name": "grep"}]}, {"type": "tool_result", "tool_call_id": "t", "content": "hit"})
    up = lambda p, n: {"params": {"update": {"sessionUpdate": "turn_completed", "prompt_id": p, "usage": {"inputTokens": n, "outputTokens": 1, "totalTokens": n + 1}}}}
    put(d / "updates.jsonl", up("a", 10), up("subagent-completed-1", 99), up("b", 5))
    (tmp_path / "enc" / "s0" / "subagents" / "s1").mkdir(parents=True)
    (tmp_path / "enc" / "s0" / "subagents" / "s1" / "meta.json").write_text("{}")
    t = jsonl.grok_build(spark, str(tmp_path))
    assert [(r["id"], r["parent_session_id"], r["first_prompt"], r["model"]) for r in t.sessions.collect()] == [("s1", "s0", "ask me", "grok-4.5-build")]
    assert [(r["role"], r["content"], r["tool_name"]) for r in t.turns.orderBy("seq").collect()] == [("user", "ask me", None), ("assistant", "sure", None), ("tool", "hit", "grep")]
    assert [tuple(r)[1:4] for r in t.usage.collect()] == [(17, 15, 2)]
