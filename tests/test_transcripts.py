"""Readers over own fixtures: string and list content, tool calls, malformed and blank lines, cursors."""

import json

from tidewell.sources import transcripts as t


def lines(spark, *rows, path="p"):
    texts = [r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows]
    return spark.createDataFrame([(path, i + 1, x) for i, x in enumerate(texts)], "path string, line_no int, line string")


def said(df):
    return [(r.role, r.content) for r in df.orderBy("line_no").collect()]


CLAUDE = [
    {"type": "user", "uuid": "u1", "timestamp": "T1", "message": {"role": "user", "content": "  héllo "}},
    "",
    "{broken",
    "[1]",
    {"type": "system", "uuid": "s"},
    {"type": "assistant", "uuid": "u2", "_audit_timestamp": "A2", "message": {"role": "assistant", "content": [
        {"type": "text", "text": "see"}, {"type": "tool_use", "name": "Bash", "input": {"command": "ls", "description": ""}},
        {"type": "tool_use", "name": "Odd"}, {"type": "image"}, {"type": "tool_result", "content": [{"type": "image"}]}]}},
    {"type": "user", "uuid": "u3", "isMeta": True, "message": {"role": "user", "content": "meta"}},
    {"type": "user", "uuid": "u4", "message": {"role": "user", "content": [{"type": "tool_result", "content": "x"}]}},
]


def test_claude(spark):
    df = t.claude(lines(spark, *CLAUDE))
    assert said(df) == [("user", "héllo"), ("assistant", "see\n[Bash: ls]\n[Odd]\n[2 image(s) shared]")]
    assert [r.timestamp for r in df.orderBy("line_no").collect()] == ["T1", "A2"]


def test_claude_cursor(spark):
    def after(uuid):
        return said(t.claude(lines(spark, *CLAUDE), spark.createDataFrame([("p", uuid)], "path string, uuid string")))

    assert len(after(None)) == 2
    assert [r for r, _ in after("u1")] == ["assistant"]
    assert after("never") == []


def test_codex(spark):
    rows = [
        {"role": "user", "content": "a", "timestamp": "1"},
        {"type": "response", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "b"}]}},
        {"items": [{"role": "user", "content": "c"}, {"role": "tool", "content": "no"}]},
        {"message": {"role": "assistant", "content": [{"type": "function_call", "name": "f"}, {"type": "tool_result", "output": "ok"}]}},
        {"role": "user", "content": ""},
    ]
    assert said(t.codex(lines(spark, *rows))) == [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "[Tool: f]\n[result: ok]")]


def test_hermes(spark):
    call = {"function": {"name": "terminal", "arguments": '{"command": "ls"}'}}
    rows = [
        {"role": "session_meta"},
        {"role": "user", "content": "q", "timestamp": "1"},
        {"role": "assistant", "content": "", "finish_reason": "tool_calls", "tool_calls": [call]},
        {"role": "assistant", "content": "prose", "finish_reason": "tool_calls", "tool_calls": [call]},
        {"role": "tool", "content": "out"},
    ]
    assert said(t.hermes(lines(spark, *rows))) == [("user", "q"), ("assistant", "prose\n[terminal: ls]")]


def grok_line(kind, **update):
    return {"method": "session/update", "timestamp": 5, "params": {"update": {"sessionUpdate": kind, **update}}}


def test_grok(spark):
    rows = [
        grok_line("user_message_chunk", content={"type": "text", "text": "hi"}),
        grok_line("agent_message_chunk", content={"type": "text", "text": "do <tool_call>x</tool_call> it"}),
        grok_line("tool_call", name="grep"),
        grok_line("agent_thought_chunk", delta="hm"),
        {"method": "other"},
    ]
    assert said(t.grok(lines(spark, *rows))) == [
        ("user", "hi"),
        ("assistant", "do it [tool call details omitted for observation]"),
        ("assistant", "[Grok tool call: grep]"),
        ("assistant", "[thought] hm"),
    ]


def test_opencode(spark):
    rows = [
        {"type": "message.updated", "event": {"type": "message.updated", "message": {"role": "model", "text": "x", "time": 3}}},
        {"type": "session.idle", "role": "user", "text": "no"},
        {"event": {"type": "message.part", "part": {"role": "user", "text": "p"}}, "received_at": "R"},
    ]
    df = t.opencode(lines(spark, *rows))
    assert said(df) == [("assistant", "x"), ("user", "p")]
    assert [r.timestamp for r in df.orderBy("line_no").collect()] == ["3", "R"]


def test_kimi(spark):
    rows = [
        {"hook_event_name": "UserPromptSubmit", "prompt": " a ", "om_captured_at": "1"},
        {"hook_event_name": "SubagentStop", "response": "r", "agent_name": "bot"},
        {"hook_event_name": "StopFailure", "error_type": "boom"},
        {"hook_event_name": "UserPromptSubmit", "prompt": " "},
    ]
    assert said(t.kimi(lines(spark, *rows))) == [("user", "a"), ("assistant", "[bot subagent response] r"), ("assistant", "Kimi turn failed: boom")]


def test_read_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(x) if not isinstance(x, str) else x for x in CLAUDE))
    df = t.read_all(spark, {"claude": str(tmp_path)})
    assert df.count() == 2
    assert df.agg({"line_no": "max"}).collect()[0][0] == 6
