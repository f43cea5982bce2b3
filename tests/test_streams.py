"""Streams give what the batch gives; duplicates and late rows are handled."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from colloquy import schema
from colloquy.operators import vector
from colloquy.sources import registry
from colloquy.sources.lines import number_lines, read_lines
from colloquy.streaming import streams

START = datetime(2025, 1, 1)


def batches(spark, folder, groups, columns):
    for i, rows in enumerate(groups):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{folder}/b{i}")


def stream_of(spark, folder, columns):
    return spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


COLUMNS = "message_id string, msg_timestamp timestamp, source string"


def test_duplicates_are_stored_once(spark, tmp_path):
    rows = [(f"m{i}", START + timedelta(minutes=i), "s") for i in range(30)]
    batches(spark, tmp_path / "in", [rows[:20], rows[10:], rows[5:25]], COLUMNS)
    out = streams.run_to_files(streams.unique_messages(stream_of(spark, str(tmp_path / "in"), COLUMNS)), str(tmp_path / "out"))
    assert sorted(r.message_id for r in out.collect()) == sorted(r[0] for r in rows)


def test_windows_close_and_late_rows_are_left_out(spark, tmp_path):
    days = [[(f"m{d}_{i}", START + timedelta(days=d, hours=i), "s") for i in range(24)] for d in range(4)]
    late = [("late", START + timedelta(hours=1), "s")]
    batches(spark, tmp_path / "in", [days[0], days[1] + days[2], days[3], late], COLUMNS)
    counts = streams.window_counts(stream_of(spark, str(tmp_path / "in"), COLUMNS), "msg_timestamp", "source")
    out = {r.window_start: r.n for r in streams.run_to_files(counts, str(tmp_path / "out")).collect()}
    assert out == {START + timedelta(days=d): 24 for d in range(3)}


def test_ingest_and_vectors_follow_arriving_files(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()

    def arrive(name, count):
        lines = [{"role": "user", "content": f"{name} message number {i}", "timestamp": "2025-03-01T10:00:00Z", "conversation_id": name} for i in range(count)]
        (source / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)))

    def run():
        streams.ingest_stream(streams.stream_lines(spark, str(source)), "generic", target, state).awaitTermination()
        return registry.read_messages(spark, target)

    arrive("a", 3)
    assert run().count() == 3
    arrive("b", 4)
    stored = run()
    batch = registry.LINE_FORMATS["generic"](number_lines(read_lines(spark, str(source))), place_ids=True)
    key = ["conversation_id", "message_id", "msg_index", "content"]
    assert sorted(stored.select(key).collect()) == sorted(batch.select(key).collect())
    registry.write_messages(stored, str(tmp_path / "table"))

    def embed():
        arriving = spark.readStream.schema(schema.MESSAGES).parquet(str(tmp_path / "table"))
        streams.embed_stream(arriving, lambda rows: vector.hash_embed(rows, "content", dim=8), str(tmp_path / "vec"), str(tmp_path / "vstate")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "vec"))

    assert embed().count() == 7
    registry.write_messages(batch.withColumn("message_id", F.concat("message_id", F.lit("x"))), str(tmp_path / "table"), mode="append")
    registry.write_messages(batch, str(tmp_path / "table"), mode="append")
    assert embed().count() == 14


def test_ids_do_not_depend_on_batches(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    for name in ("a", "b"):
        lines = [{"role": "user", "content": f"{name} message number {i}", "timestamp": "2025-03-01T10:00:00Z", "conversation_id": "one"} for i in range(2)]
        (source / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)))
        streams.ingest_stream(streams.stream_lines(spark, str(source)), "generic", target, state).awaitTermination()
    rows = registry.read_messages(spark, target)
    assert rows.count() == rows.select("message_id").distinct().count() == 4


def test_incremental_ingest_reads_grown_files_again(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()

    def put(name, count):
        lines = [{"role": "user", "content": f"{name} message number {i}", "timestamp": "2025-03-01T10:00:00Z", "conversation_id": "one" if name != "c" else "two"} for i in range(count)]
        (source / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)))

    def same():
        got = registry.ingest_incremental(spark, "generic", str(source), store, as_of="2024-06-01")
        full = registry.LINE_FORMATS["generic"](registry.read_lines(spark, str(source)), as_of="2024-06-01")
        key = ["conversation_id", "message_id", "msg_index", "conversation_msg_count", "content"]
        assert sorted(got.select(key).collect()) == sorted(full.select(key).collect())
        return got.count()

    put("a", 2)
    put("b", 3)
    assert same() == 5
    assert same() == 5
    put("a", 6)
    put("c", 1)
    assert same() == 10
