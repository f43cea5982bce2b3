"""Named sources, ingestion of several at once, discovery, and optional tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import schema
from colloquy.sources import documents, incremental, jsonl
from colloquy.sources.arrays import read_array_elements
from colloquy.sources.lines import read_documents, read_lines
from colloquy.sources.tables import read_optional

Reader = Callable[[SparkSession, str], DataFrame]

_SOURCES: dict[str, Reader] = {}


def register_source(name: str, reader: Reader) -> None:
    """Add a source: reader(spark, path) returns canonical messages."""
    _SOURCES[name] = reader


def sources() -> list[str]:
    return sorted(_SOURCES)


def ingest(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in _SOURCES:
        raise KeyError(f"unknown source {name}; known: {', '.join(sources())}")
    return _SOURCES[name](spark, path)


def union_messages(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ingest_all(spark: SparkSession, configured: list[tuple[str, str]]) -> DataFrame:
    """Messages of all (source, path) pairs in one table."""
    return union_messages([ingest(spark, name, path) for name, path in configured])


def write_messages(messages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by year and month, a conversation's rows in order inside each file; files' number follows the month's size."""
    schema.conform(messages, schema.MESSAGES).hint("rebalance", "year", "month").sortWithinPartitions(
        "year", "month", "conversation_id", "msg_index"
    ).write.mode(mode).partitionBy("year", "month").parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return schema.conform(spark.read.schema(schema.MESSAGES).parquet(path), schema.MESSAGES)


def source_inventory(spark: SparkSession, configured: list[tuple[str, str, str]]) -> DataFrame:
    """Files and bytes per (source, path, file pattern), from the listing alone."""
    parts = []
    for name, path, pattern in configured:
        files = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
            .load(path).select("path", "length", "modificationTime")
        )
        parts.append(
            files.agg(
                F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
                F.max("modificationTime").alias("newest"),
            ).select(F.lit(name).alias("source"), F.lit(path).alias("path"), "files", "bytes", "newest")
        )
    return reduce(DataFrame.unionByName, parts)


def ingest_changed(spark: SparkSession, name: str, path: str, since: str) -> DataFrame:
    """Messages of the line files changed after `since` (yyyy-MM-ddTHH:mm:ss)."""
    if name not in LINE_FORMATS:
        raise KeyError(f"{name} is not a line format")
    return LINE_FORMATS[name](read_lines(spark, path, modifiedAfter=since))


def ingest_incremental(spark: SparkSession, name: str, path: str, store: str, pattern: str = "*.jsonl", **options) -> DataFrame:
    """Messages of all line files below `path`; only files that are new or changed since the last call are read.

    See `incremental.refresh`.
    """
    if name not in LINE_FORMATS:
        raise KeyError(f"{name} is not a line format")
    return incremental.refresh(spark, LINE_FORMATS[name], path, store, pattern, **options)


LINE_FORMATS = {
    "generic": jsonl.parse_generic,
    "claude-code": jsonl.parse_sessions,
    "clawdbot": jsonl.parse_agent_sessions,
    "cursor": jsonl.parse_transcripts,
}

for _name, _parse in LINE_FORMATS.items():
    register_source(_name, lambda spark, path, _parse=_parse: _parse(read_lines(spark, path)))

register_source("chatgpt", lambda spark, path: documents.parse_export(read_array_elements(spark, path)))
register_source(
    "chatgpt-export",
    lambda spark, path: documents.parse_export(read_array_elements(spark, path), source="chatgpt-export", tree_order=True),
)
register_source("cursor-kv", lambda spark, path: documents.parse_kv_chats(spark.read.schema("key string, value string").json(path)))
register_source("gemini-cli", lambda spark, path: documents.parse_gemini(read_documents(spark, path)))
