"""Column expressions against stated values."""

from datetime import datetime

from pyspark.sql import functions as F

from colloquy.functions import domains, noise
from colloquy.functions import text as tx
from colloquy.functions.jsonlist import item_name, json_list, real_items
from colloquy.operators.messages import canonicalize, finalize, kept, noise_manifest, split_noise

RAW = "source string, conversation_id string, role string, content string, ts timestamp, message_id string"


def values(spark, rows, expr, schema="v string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def one(spark, content, ts=datetime(2025, 1, 15, 10, 30), **options):
    rows = spark.createDataFrame([("s", "c", "user", content, ts, "m")], RAW)
    return canonicalize(rows, **options).collect()


def test_canonical_values(spark):
    row = one(spark, "  Hello, how are you? \n")[0]
    assert (row.word_count, row.has_question, row.has_code, row.has_url) == (4, 1, 0, 0)
    assert (row.year, row.month, row.day_of_week, row.hour) == (2025, 1, "Wednesday", 10)
    assert row.content == "Hello, how are you?" and row.conversation_title == "Untitled"


def test_empty_content_is_dropped(spark):
    assert one(spark, "") == [] and one(spark, " \n\t 　 ") == [] and one(spark, None) == []


def test_flags_and_cap(spark):
    assert one(spark, "```python\nx\n```")[0].has_code == 1
    assert one(spark, "the class of 1999")[0].has_code == 1
    assert one(spark, "see https://example.com")[0].has_url == 1
    row = one(spark, "x" * 60_000, max_chars=50_000)[0]
    assert len(row.content) == 50_000 and row.char_count == 60_000
    assert len(one(spark, "x" * 60_000)[0].content) == 60_000  # nothing is cut unless asked for


def test_finalize_flags(spark):
    rows = [("s", "c", "user", f"text {i}", datetime(2025, 1, 1, i // 3, i), f"m{i}") for i in range(5)]
    out = finalize(canonicalize(spark.createDataFrame(rows, RAW).repartition(4))).orderBy("msg_index").collect()
    assert [r.message_id for r in out] == [f"m{i}" for i in range(5)]
    assert [r.is_first for r in out] == [1, 0, 0, 0, 0] and [r.is_last for r in out] == [0, 0, 0, 0, 1]
    assert {r.conversation_msg_count for r in out} == {5}


def test_noise(spark):
    noisy = ["yes", "No", "OK", "continue", " Continue\n", "thanks", "go for it", "a", "7", "12x", "kill 99", "[Tool Result]",
             "warmup", "[Request interrupted by user]", "<local-command-stdout>", "now?", "YEP", "do better", "9" * 200]
    real = ["How do I deploy this?", "yes, but only on Linux", "ok computer is an album", "kill the old server", "helpful text"]
    assert all(values(spark, [(x,) for x in noisy], noise.is_noise(F.col("v"))))
    assert not any(values(spark, [(x,) for x in real], noise.is_noise(F.col("v"))))


def test_kept_and_dropped_make_the_input(spark):
    rows = [("s", "c", "user", x, datetime(2025, 1, 1), str(i)) for i, x in enumerate(["ok", "real text here", "42", "more words"])]
    df = canonicalize(spark.createDataFrame(rows, RAW))
    assert kept(df).count() + split_noise(df).where("drop_reason IS NOT NULL").count() == df.count()
    manifest = noise_manifest(df).first()
    assert (manifest.l0_in, manifest.l1_kept, manifest.l1_dropped, manifest.user_yield_pct) == (4, 2, 2, 50.0)


def test_json_list(spark):
    rows = [(None,), ("",), ('["a", "b"]',), ("plain",), ('{"key": "value"}',), ("[broken",), ("5",), ('"quoted"',)]
    assert values(spark, rows, json_list(F.col("v"))) == [
        [], [], ["a", "b"], ["plain"], ['{"key":"value"}'], ["[broken"], ["5"], ["quoted"],
    ]


def test_item_names_and_none_filters(spark):
    assert values(spark, [('{"name": "n", "kind": "tool"}',), ("plain",)], item_name(F.col("v"), "name")) == ["n", "plain"]
    items = F.array(F.lit("None identified"), F.lit("None identified yet"), F.lit(""), F.lit("q"))
    assert values(spark, [("x",)], real_items(items)) == [["None identified yet", "q"]]
    assert values(spark, [("x",)], real_items(items, "contains")) == [["q"]]


def test_timestamps(spark):
    raw = ["2025-01-15T10:30:00Z", "2025-01-15T10:30:00.500Z", "2025-01-15 10:30:00", "2025-01-15", "1736937000", "1736937000000",
           "1736937000.0", "nonsense", None]
    got = values(spark, [(r,) for r in raw], tx.parse_ts(F.col("v"), F.lit("2000-01-01").cast("timestamp")).cast("string"))
    assert got == ["2025-01-15 10:30:00", "2025-01-15 10:30:00.5", "2025-01-15 10:30:00", "2025-01-15 00:00:00",
                   "2025-01-15 10:30:00", "2025-01-15 10:30:00", "2025-01-15 10:30:00", "2000-01-01 00:00:00", "2000-01-01 00:00:00"]


def test_labels_and_sources(spark):
    scores = [(0.95,), (0.9,), (0.8,), (0.7,), (0.6,), (0.5,), (0.3,)]
    assert values(spark, scores, tx.match_label(F.col("v")), "v double") == [
        "Best match", "Good match", "Good match", "Good match", "Related", "Related", "Weak match"]
    ids = [("cc_1",), ("chatgpt_9",), ("cb_x",), ("clawdbot-1",), ("cd_2",), ("zz",), ("",), (None,)]
    assert values(spark, ids, tx.guess_source(F.col("v"))) == [
        "claude-code", "chatgpt", "clawdbot", "clawdbot", "claude-desktop", "unknown", "unknown", "unknown"]


def test_truncate_and_cite(spark):
    long = values(spark, [("word " * 100,)], tx.truncate_words(F.col("v"), 50))[0]
    assert len(long) <= 55 and long.endswith("...") and values(spark, [("short",)], tx.truncate_words(F.col("v"), 50)) == ["short"]
    when = F.lit("2026-04-24 10:00:00").cast("timestamp")
    assert values(spark, [("abc123def4567",), ("",), (None,)], tx.cite(F.col("v"), when)) == ["[abc123def456 · 2026-04-24]", "", ""]
    assert values(spark, [("abc",)], tx.cite(F.col("v"), F.lit(None).cast("timestamp"))) == ["[abc]"]


def test_project_name_and_roles(spark):
    assert values(spark, [("-Users-me-Documents-my-app",), ("Users",), ("a-b-c-d",)], tx.project_name(F.col("v"))) == ["me-my-app", "Users", "b-c-d"]
    assert values(spark, [("AI",), ("human",), ("tool",)], tx.normalize_role(F.col("v"))) == ["assistant", "user", None]


def test_domain_keywords():
    assert domains.keywords_for("python")[:3] == ["python", "Python", "pip"]
    assert domains.keywords_for("my_new-topic") == ["my_new-topic", "new", "topic"]
