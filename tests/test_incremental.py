"""The incremental store: only changed files are read, only their conversations are written anew."""

import json
import os

import pytest

from colloquy.sources import incremental, registry

KEY = ["conversation_id", "message_id", "msg_index", "conversation_msg_count", "is_last", "content"]
AS_OF = {"as_of": "2024-06-01"}


def put(folder, name, count, conversation="one", first=0):
    folder.mkdir(exist_ok=True)
    lines = [
        {"role": "user", "content": f"{name} message number {i}", "timestamp": "2025-03-01T10:00:00Z", "conversation_id": conversation(i) if callable(conversation) else conversation}
        for i in range(first, count)
    ]
    (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)))


def rows(df):
    return sorted(map(tuple, df.select(KEY).collect()))


def full(spark, source, fmt="generic", **options):
    return rows(registry.LINE_FORMATS[fmt](registry.read_lines(spark, str(source)), **options))


def rows_scanned(spark, action):
    """Files and rows that scans read while `action` runs, from Spark's own SQL metrics."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = []
    executions = store.executionsList()
    for i in range(before, executions.size()):
        number = executions.apply(i).executionId()
        metrics, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            if node.name().startswith("Scan text"):
                for j in range(node.metrics().size()):
                    m = node.metrics().apply(j)
                    value = metrics.get(m.accumulatorId())
                    if value.isDefined() and m.name() in ("number of files read", "number of output rows"):
                        found.append((m.name(), int(value.get().replace(",", ""))))
    return found


def test_a_second_call_reads_changed_files_only(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    put(source, "large one", 5000, lambda i: f"c{i % 40}")
    for i in range(20):
        put(source, f"f{i}", 3, f"d{i}")

    def call():
        return registry.ingest_incremental(spark, "generic", str(source), store, **AS_OF)

    assert rows(call()) == full(spark, source, **AS_OF)
    put(source, "f3", 5, "d3")
    put(source, "new [1] {a},b", 2, "c7")
    scanned = rows_scanned(spark, call)
    assert {n for what, n in scanned if what == "number of files read"} == {2}
    assert {n for what, n in scanned if what == "number of output rows"} == {7}
    assert rows(incremental.read_store(spark, store)) == full(spark, source, **AS_OF)
    assert rows_scanned(spark, call) == []
    runs = {p for p in os.listdir(f"{store}/messages")}
    assert runs == {"run=0", "run=1"} and len(os.listdir(f"{store}/messages/run=1")) <= 2 + 2  # two buckets, a flag and its checksum
    assert rows(incremental.read_store(spark, store)) == full(spark, source, **AS_OF)


def test_many_changed_files_are_found_by_their_times(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "NAMED_FILES", 1)
    source, store = tmp_path / "in", str(tmp_path / "store")
    put(source, "old", 100, "x")
    os.utime(source / "old.jsonl", (1_600_000_000, 1_600_000_000))
    for turn in range(2):
        for i in range(4):
            put(source, f"f{i}", 2 + turn, "d")
        scanned = rows_scanned(spark, lambda: registry.ingest_incremental(spark, "generic", str(source), store, **AS_OF))
        assert rows(incremental.read_store(spark, store)) == full(spark, source, **AS_OF)
    assert {n for what, n in scanned if what == "number of files read"} == {4}


def test_buckets_follow_the_data(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "ROWS_PER_BUCKET", 5)
    monkeypatch.setattr(incremental, "LEAST_BUCKETS", 2)
    source, store = tmp_path / "in", str(tmp_path / "store")
    numbers = []
    for turn, count in enumerate((4, 30, 60, 400, 405)):
        put(source, f"t{turn}", count, lambda i: f"c{i % 23}")
        put(source, "grows", count, lambda i: f"g{i % 7}")
        registry.ingest_incremental(spark, "generic", str(source), store, **AS_OF)
        assert rows(incremental.read_store(spark, store)) == full(spark, source, **AS_OF)
        numbers.append(incremental._State(spark, store).of)
    assert numbers[0] == 2 and numbers == sorted(numbers) and numbers[3] > 100 and numbers[4] == numbers[3]


def test_replaced_emptied_and_vanished_files(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    put(source, "a", 3, "one")
    put(source, "b", 2, "one")
    registry.ingest_incremental(spark, "generic", str(source), store, **AS_OF)
    put(source, "a", 3, "two")  # its messages move to another conversation
    assert rows(registry.ingest_incremental(spark, "generic", str(source), store, **AS_OF)) == full(spark, source, **AS_OF)
    (source / "a.jsonl").write_text("no json\n")
    assert rows(registry.ingest_incremental(spark, "generic", str(source), store, **AS_OF)) == full(spark, source, **AS_OF)
    os.remove(source / "b.jsonl")
    assert registry.ingest_incremental(spark, "generic", str(source), store, **AS_OF).count() == 2  # a vanished file stays stored


def test_no_file_and_a_failed_call(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    assert registry.ingest_incremental(spark, "generic", str(source), store, **AS_OF).count() == 0
    put(source, "a", 3, "one")
    with pytest.raises(ZeroDivisionError):
        incremental.refresh(spark, lambda lines, finish: 1 / 0, str(source), store)
    os.makedirs(f"{store}/files/run=1")  # left by a call that broke off before its end
    assert rows(registry.ingest_incremental(spark, "generic", str(source), store, **AS_OF)) == full(spark, source, **AS_OF)


def test_sessions_keep_what_a_file_carries(spark, tmp_path):
    """Formats that carry a session or a model along a file give the same rows as one full ingest."""
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()

    def session(name, count):
        lines = [{"type": "session", "id": f"s-{name}"}, {"type": "model_change", "modelId": "m1"}]
        lines += [{"type": "message", "timestamp": "2025-03-01T10:00:00Z", "message": {"role": "user", "content": f"{name} says {i}"}} for i in range(count)]
        (source / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)))

    for count in (2, 4):
        session("a", count)
        session(f"b{count}", 3)
        got = registry.ingest_incremental(spark, "clawdbot", str(source), store, **AS_OF)
        assert rows(got) == full(spark, source, "clawdbot", **AS_OF)
    assert {r.model for r in got.collect()} == {"m1"}
