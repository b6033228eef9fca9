"""Parsers on exports of our own."""

import json

import pytest

from turnwise.sources import chatgpt, claude, gemini
from turnwise.sources.registry import read_all
from turnwise.streaming.sessions import live_sessions


def test_claude(spark, tmp_path):
    convs = [
        {"uuid": "a", "name": "", "created_at": "2025-11-10T09:15:00Z", "chat_messages": [
            {"sender": "human", "text": "fallback", "content": []},
            {"sender": "assistant", "text": "no", "content": [{"type": "text", "text": "one"}, {"type": "tool_use"}, {"type": "text", "text": "two"}]},
            {"sender": "system", "text": "gone"}, {"sender": "human", "text": "  "}]},
        {"uuid": "b", "name": "no user", "chat_messages": [{"sender": "assistant", "text": "x"}]},
        {"uuid": "c", "name": "empty", "chat_messages": []},
    ]
    (tmp_path / "conversations.json").write_text(json.dumps(convs))
    got = claude.read(spark, f"{tmp_path}/conversations.json").orderBy("turn_idx").collect()
    assert [(r.conversation_id, r.title, r.turn_idx, r.role, r.content) for r in got] == [("a", None, 0, "user", "fallback"), ("a", None, 1, "assistant", "one\n\ntwo")]
    assert got[0].created_at.isoformat() == "2025-11-10T09:15:00"


def node(parent, role, parts, kind="text", at=1.7e9):
    return {"parent": parent, "message": {"author": {"role": role}, "create_time": at, "content": {"content_type": kind, "parts": parts}}}


def test_chatgpt(spark, tmp_path):
    tree = {"r": {"parent": None, "message": None}, "s": node("r", "system", ["sys"]), "u": node("s", "user", ["hi", {"asset": 1}, " ", '{"a']), "x": node("u", "assistant", ["left"]), "a": node("u", "assistant", ["yes"]), "c": node("a", "assistant", ["code"], "code")}
    cyc = {"p": node("q", "user", ["p"]), "q": node("p", "assistant", ["q"])}
    convs = [
        {"conversation_id": "1", "title": "t", "create_time": 1.7e12, "current_node": "c", "mapping": tree},
        {"id": "2", "title": "cycle", "create_time": 1.7e9, "current_node": "q", "mapping": cyc},
        {"id": "3", "title": "no current node", "mapping": tree},
        {"id": "4", "title": "unknown", "current_node": "zz", "mapping": tree},
    ]
    (tmp_path / "conversations.json").write_text(json.dumps(convs))
    got = chatgpt.read(spark, f"{tmp_path}/conversations.json").orderBy("conversation_id", "turn_idx").collect()
    assert [(r.conversation_id, r.role, r.content) for r in got] == [("1", "user", 'hi\n\n{"a'), ("1", "assistant", "yes"), ("2", "user", "p"), ("2", "assistant", "q")]
    assert got[0].created_at == got[2].created_at


def cell(prompt, stamp, answer):
    return f'<div class="outer-cell mdl-cell"><div class="mdl-grid"><div class="content-cell mdl-cell body-1">Prompted&nbsp;{prompt}<br>{stamp}<br>{answer}</div></div></div>'


def test_gemini(spark, tmp_path):
    html = "<html><body>" + cell("third", "Feb 1, 2026, 4:22:06&#8239;PM CST", "<p>c</p>") + cell("second", "Feb 1, 2026, 3:22:05&#8239;PM CST", "<b>b</b>") + cell("first &amp; one", "Feb 1, 2026, 2:22:05&#8239;PM CST", "<h2>a</h2><ul><li>x</li></ul>") + cell("no answer", "Feb 1, 2026, 2:22:05&#8239;PM CST", "") + '<div class="outer-cell"><div class="content-cell body-1">Used an app</div></div></body></html>'
    (tmp_path / "MyActivity.html").write_text(html)
    got = gemini.read(spark, f"{tmp_path}/MyActivity.html").orderBy("created_at", "turn_idx").collect()
    assert [(r.turn_idx, r.role, r.content) for r in got] == [(0, "user", "first & one"), (1, "assistant", "## a\n\n- x"), (2, "user", "second"), (3, "assistant", "**b**"), (0, "user", "third"), (1, "assistant", "c")]
    assert got[0].ts.isoformat() == "2026-02-01T20:22:05" and got[0].title == "first & one"


def test_registry_skips_what_is_absent(spark, tmp_path):
    (tmp_path / "claude").mkdir()
    (tmp_path / "claude/conversations.json").write_text(json.dumps([{"uuid": "a", "chat_messages": [{"sender": "human", "text": "hello"}]}]))
    assert [r.source for r in read_all(spark, str(tmp_path)).collect()] == ["claude"]


@pytest.mark.parametrize("gap, sessions", [(3600, 1), (3601, 2)])
def test_live_sessions(spark, tmp_path, gap, sessions):
    rows = spark.sql(f"SELECT 'a' AS source, timestamp_seconds(1700000000 + id * {gap}) AS ts, 'x' AS content FROM range(2)")
    rows.write.parquet(f"{tmp_path}/in")
    live = live_sessions(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = live.writeStream.format("memory").queryName(f"s{gap}").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table(f"s{gap}").count() == sessions
