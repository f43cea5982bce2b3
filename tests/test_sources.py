"""Readers over generated files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from colloquy import schema
from colloquy.sources import documents, jsonl, registry, summaries
from colloquy.sources.lines import read_documents, read_lines


def put(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return path


def ordered(df):
    return df.orderBy("conversation_id", "msg_index").collect()


def text(t):
    return [{"type": "text", "text": t}]


def test_generic(spark, tmp_path):
    put(tmp_path / "chat.jsonl", [
        {"role": "user", "content": "How are you?", "timestamp": "2025-03-01T10:00:00Z", "conversation_id": "c1", "title": "T"},
        "not json", "", {"role": "system", "content": "hidden"}, {"role": "user", "content": ""},
        {"role": "Critic", "content": "unknown role", "created_at": 1740823260, "conversation_id": "c1"},
        {"role": "assistant", "content": "fine", "date": "2025-03-02", "message_id": "own"},
    ])
    rows = ordered(registry.ingest(spark, "generic", str(tmp_path)))
    assert [f.name for f in schema.MESSAGES.fields] == list(rows[0].asDict())
    c1 = [r for r in rows if r.conversation_id == "c1"]
    assert [(r.role, r.msg_index, r.conversation_msg_count, r.message_id) for r in c1] == [("user", 0, 2, "c1_0"), ("user", 1, 2, "c1_1")]
    assert [r.conversation_title for r in c1] == ["T", "chat"]
    other = [r for r in rows if r.conversation_id != "c1"][0]
    assert len(other.conversation_id) == 16 and other.message_id == "own" and other.created == datetime(2025, 3, 2)


def test_sessions(spark, tmp_path):
    put(tmp_path / "-Users-me-Documents-site" / "abc.jsonl", [
        {"type": "summary", "text": "skip"},
        {"type": "user", "timestamp": "2025-02-01T14:00:00Z", "sessionId": "s1", "uuid": "u1", "message": {"role": "user", "content": text("Explain generators in detail please")}},
        {"type": "user", "sessionId": "s1", "uuid": "u2", "message": {"role": "user", "content": "too short"}},
        {"type": "assistant", "timestamp": "2025-02-01T14:00:30Z", "sessionId": "s1", "uuid": "u3",
         "message": {"role": "assistant", "model": "m", "content": [{"type": "tool_use", "name": "x"}, {"type": "text", "text": "first part"}, "second part"]}},
        {"type": "user", "sessionId": "s1", "message": {"role": "user", "content": "Prompt is too long"}},
        {"type": "user", "sessionId": "s1", "message": {"role": "user", "content": "and what about coroutines?"}},
    ])
    rows = ordered(jsonl.parse_sessions(read_lines(spark, str(tmp_path))))
    assert [r.message_id for r in rows][:2] == ["u1", "u3"] and len(rows) == 3
    assert rows[1].content == "first part\nsecond part" and rows[1].model == "m"
    assert {r.conversation_id for r in rows} == {"cc_local_s1"} and {r.project for r in rows} == {"me-site"}
    assert {(r.temporal_precision, r.timestamp_is_fallback) for r in rows} == {("day", 1)}


def test_agent_sessions_carry_forward(spark, tmp_path):
    def message(i, role="user", **more):
        return {"type": "message", "id": f"m{i}", "timestamp": 1736937000000 + i, "message": {"role": role, "content": text(f"message {i}"), **more}}

    lines = [message(0), {"type": "session", "id": "s1"}, {"type": "model_change", "modelId": "a"}, message(1), message(2, "assistant", model="own"),
             {"type": "model_change", "modelId": "b"}, message(3), message(4, "tool"), {"type": "session", "id": "s2"}, message(5)]
    put(tmp_path / "x" / "sessions" / "run.jsonl", lines)
    put(tmp_path / "x" / "sessions" / "run.deleted.1.jsonl", lines)
    rows = {r.message_id: r for r in jsonl.parse_agent_sessions(read_lines(spark, str(tmp_path))).collect()}
    assert {k: (r.conversation_id, r.model) for k, r in rows.items()} == {
        "m0": ("run", "unknown"), "m1": ("s1", "a"), "m2": ("s1", "own"), "m3": ("s1", "b"), "m5": ("s2", "b")}
    assert rows["m1"].conversation_msg_count == 3


def test_transcripts(spark, tmp_path):
    put(tmp_path / "proj" / "agent-transcripts" / "t1.jsonl", [
        {"type": "human", "message": {"role": "human", "content": text("nested question")}, "uuid": "a", "timestamp": "2025-06-15T10:00:00Z"},
        {"role": "ai", "content": "flat answer", "id": "b", "timestamp": 1749981605},
        {"role": "tool", "content": "dropped text"}, {"role": "model", "content": "hm"},
    ])
    rows = ordered(jsonl.parse_transcripts(read_lines(spark, str(tmp_path))))
    assert [(r.role, r.message_id, r.project) for r in rows] == [("user", "a", "proj"), ("assistant", "b", "proj")]


def node(role, body, parent, at, children=()):
    message = None if role is None else {"author": {"role": role}, "content": {"parts": body}, "create_time": at, "metadata": {"model_slug": "g"}}
    return {"message": message, "parent": parent, "children": list(children)}


EXPORT = [{
    "title": "Trip", "id": "e1", "create_time": 1700000000.0, "mapping": {
        "root": node(None, [], None, None, ["a"]), "c": node("user", ["third message"], "b", 1700000100.0),
        "a": node("user", ["first message"], "root", 1700000100.0, ["b"]), "b": node("assistant", ["second", {"text": "part"}], "a", 1700000100.0, ["c"]),
        "s": node("system", ["hidden text"], "root", 1.0), "x": node("user", ["in a cycle"], "y", 1700000000.0), "y": node("user", ["also in it"], "x", 1700000000.0),
    }}]


def test_export(spark, tmp_path):
    put(tmp_path / "conversations.json", [json.dumps(EXPORT)])
    flat = ordered(documents.parse_export(read_documents(spark, str(tmp_path))))
    assert len(flat) == 5 and {r.conversation_id for r in flat} == {"chatgpt_e1"}
    tree = ordered(registry.ingest(spark, "chatgpt-export", str(tmp_path)))
    assert [r.message_id for r in tree] == ["a", "b", "c"] and tree[1].content == "second\npart"
    assert [r.is_last for r in tree] == [0, 0, 1]


def test_gemini(spark, tmp_path):
    long = "a question " * 12
    put(tmp_path / "tmp" / "hash1234567890" / "chats" / "s.json", [json.dumps({"sessionId": "s1", "messages": [
        {"id": "1", "type": "user", "content": long, "timestamp": "2025-01-01T00:00:00Z"}, {"type": "gemini", "content": "an answer", "model": "g"},
        {"type": "info", "content": "dropped"}, {"type": "user", "content": "ok"}]})])
    rows = ordered(registry.ingest(spark, "gemini-cli", str(tmp_path)))
    assert [(r.role, r.message_id, r.model) for r in rows] == [("user", "1", None), ("assistant", "s1_1", "g")]
    assert rows[0].conversation_title == long[:80].strip() + "..." and rows[0].project == "gemini-hash12345678"


def test_kv_chats(spark):
    chat = json.dumps({"tabs": [{"id": "t", "title": "Chat", "bubbles": [{"type": "human", "text": "hi there"}, {"type": "ai", "text": "hello"}, {"type": "log", "text": "no"}]}]})
    other = json.dumps([{"bubbles": [{"type": "user", "content": "second store"}]}])
    composer = json.dumps({"name": "Comp", "conversation": {"messages": [{"role": "user", "content": text("long enough")}, {"role": "bot", "message": "tiny"}, {"role": "bot", "text": "an answer", "id": "own"}]}})
    items = spark.createDataFrame([(documents.CHAT_KEY, chat), (documents.CHAT_KEY, other), ("composerData:k1", composer), ("other", chat), (documents.CHAT_KEY, "broken")], "key string, value string")
    rows = ordered(documents.parse_kv_chats(items))
    assert [(r.conversation_id, r.role, r.msg_index, r.message_id) for r in rows] == [
        ("cursor_composer_k1", "user", 0, "cursor_composer_k1_0"), ("cursor_composer_k1", "assistant", 1, "own"),
        ("cursor_cursor_chat_0", "user", 0, "cursor_cursor_chat_0_0"), ("cursor_t", "user", 0, "cursor_t_0"), ("cursor_t", "assistant", 1, "cursor_t_1")]


def test_split_files_keep_line_order(spark, tmp_path):
    lines = [{"role": "user", "content": f"line {i} " + "x" * 200, "conversation_id": "c"} for i in range(2000)]
    put(tmp_path / "big.jsonl", lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        rows = registry.ingest(spark, "generic", str(tmp_path)).select("msg_index", "content").orderBy("msg_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [int(r.content.split()[1]) for r in rows] == list(range(2000)) and rows[-1].msg_index == 1999


def test_registry_and_tables(spark, tmp_path):
    put(tmp_path / "in" / "a.jsonl", [{"role": "user", "content": "stored text", "timestamp": "2025-03-01T10:00:00Z"}])
    registry.register_source("mine", lambda s, p: registry.ingest(s, "generic", p).withColumn("source", F.lit("mine")))
    both = registry.ingest_all(spark, [("generic", str(tmp_path / "in")), ("mine", str(tmp_path / "in"))])
    registry.write_messages(both, str(tmp_path / "out"))
    back = registry.read_messages(spark, str(tmp_path / "out"))
    assert sorted(r.source for r in back.collect()) == ["custom", "mine"] and back.schema == schema.MESSAGES
    assert registry.read_optional(spark, str(tmp_path / "absent")) is None
    assert registry.read_optional(spark, str(tmp_path / "out"), schema.MESSAGES).count() == 2
    with pytest.raises(KeyError):
        registry.ingest(spark, "nothing", "/x")
    assert registry.ingest_changed(spark, "generic", str(tmp_path / "in"), "2000-01-01T00:00:00").count() == 1
    assert registry.ingest_changed(spark, "generic", str(tmp_path / "in"), "2999-01-01T00:00:00").count() == 0
    found = registry.source_inventory(spark, [("generic", str(tmp_path / "in"), "*.jsonl")]).first()
    assert found.files == 1 and found.bytes > 0


def test_summary_records(spark, tmp_path):
    current = {"conversation_id": "c1", "source": "s", "title": "T", "msg_count": 3, "data": {
        "summary": {"text": "Did a thing", "domain_primary": " Data_Engineering", "importance": "breakthrough", "quotable": "say it"},
        "concepts": [{"name": "Lake"}], "decisions": ["go", {"text": "stop"}], "open_questions": []}}
    older = {"conversation_id": "c2", "data": {"summary": "Old text", "domain_primary": "ops", "concepts": ["A"], "quotable": ["q1"]}}
    put(tmp_path / "s.jsonl", [current, "broken", older])
    rows = {r.conversation_id: r for r in summaries.summaries_from_records(read_lines(spark, str(tmp_path))).collect()}
    a, b = rows["c1"], rows["c2"]
    assert a.domain_primary == "data-engineering" and a.concepts == ["Lake"] and a.decisions == ["go", "stop"] and a.quotable == ["say it"]
    assert a.embedding_text == "Did a thing. Concepts: Lake. Decisions: go; stop" and len(a.summary_hash) == 16
    assert (b.summary, b.importance, b.msg_count, b.quotable) == ("Old text", "routine", 0, ["q1"])
    made = summaries.summarize(
        spark.createDataFrame([("c9", "s", "T", 4, "text")], "conversation_id string, source string, title string, msg_count long, text string"),
        lambda texts: [json.dumps({"summary": f"about {t}"}) for t in texts])
    assert summaries.summaries_from_records(made).first().summary == "about text"
    summaries.append_records(made, str(tmp_path / "store"))
    summaries.append_records(made, str(tmp_path / "store"))
    assert spark.read.text(str(tmp_path / "store")).count() == 2
