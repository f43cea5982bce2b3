"""Streams: continuous ingestion, exactly-once messages, windowed counts, incremental vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.sources.lines import number_lines
from colloquy.sources.registry import LINE_FORMATS, write_messages


def stream_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl", max_files: int = 1000) -> DataFrame:
    """New lines below `path`, with their place, as files arrive."""
    return (
        spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files).load(path)
        .select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
            "value", F.col("_metadata.file_modification_time").alias("modified_at"),
        )
    )


def ingest_stream(lines: DataFrame, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the messages of arriving files to `target`.

    A batch is whole files. Lines are numbered inside their file block, and messages without an id are named by that
    place, so ids do not depend on the batches; a conversation spread over files of several batches is renumbered by
    `finalize` on the stored table. Each batch owns a folder it overwrites, so a batch repeated after a failure is stored
    once. A file that grows later is not read again: `registry.ingest_incremental` is for such folders.
    """
    parse = LINE_FORMATS[source]
    named = {"place_ids": True} if source == "generic" else {}

    def append(batch: DataFrame, batch_id: int) -> None:
        write_messages(parse(number_lines(batch.withColumn("pos", F.monotonically_increasing_id())), **named), f"{target}/batch={batch_id}")

    return (
        lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def unique_messages(messages: DataFrame, delay: str = "1 day", ts: str = "msg_timestamp") -> DataFrame:
    """Each message_id once within the allowed delay."""
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["message_id"])


def window_counts(messages: DataFrame, ts: str, key: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Messages per window and key; a window is final once the watermark has passed it."""
    return (
        messages.withWatermark(ts, delay).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), key, "n")
    )


def tool_popularity_stream(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Calls and latency per tool and window; the percentile is approximate so that state stays small."""
    calls = events.where("event = 'tool_called'").select(
        "ts", "machine_id", F.from_json("props", "tool string, latency_ms double").alias("p")
    ).where("p.tool IS NOT NULL")
    return (
        calls.withWatermark("ts", delay).groupBy(F.window("ts", window), F.col("p.tool").alias("tool")).agg(
            F.count(F.lit(1)).alias("calls"),
            F.approx_count_distinct("machine_id").alias("users"),
            F.percentile_approx("p.latency_ms", 0.95, 1000).alias("p95_latency_ms"),
        ).select(F.col("window.start").alias("window_start"), "tool", "calls", "users", "p95_latency_ms")
    )


def embed_stream(
    messages: DataFrame, encoder: Callable[[DataFrame], DataFrame], target: str, checkpoint: str
) -> StreamingQuery:
    """Append vectors of new user messages; ids already stored are skipped."""
    from colloquy import schema
    from colloquy.operators.vector import embed_pending, write_vectors
    from colloquy.sources.registry import read_optional

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        stored = read_optional(spark, target, schema.MESSAGE_VECTORS)
        existing = stored if stored is not None else spark.createDataFrame([], schema.MESSAGE_VECTORS)
        made = encoder(embed_pending(batch, existing)).withColumn("created_at", F.current_timestamp())
        write_vectors(schema.conform(made, schema.MESSAGE_VECTORS), target)

    return (
        messages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def run_updates(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Run an aggregating stream over what is available now and return its result, open groups included.

    Every micro-batch writes the groups it changed to a folder it owns, so a repeated batch is stored once; a group's newest
    row counts. The state is that of update mode: closed groups leave it once the watermark has passed.
    """
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch={batch_id}")

    (
        stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start().awaitTermination()
    )
    rest = [c for c in stream.columns if c not in keys]
    kinds = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes)
    stored = stream.sparkSession.read.schema(f"{kinds}, batch bigint").parquet(f"{folder}/data")
    return stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*").select(*stream.columns)


def run_to_files(stream: DataFrame, folder: str, output: str = "append") -> DataFrame:
    """Run a stream over what is available now into parquet files and return them as a table."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(output).format("parquet").option("path", f"{folder}/data")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")
