"""Ingestion that reads only new and changed files and renews only the conversations they touch.

A store holds messages with their places in the files, numbered, in buckets by conversation:

- `messages/run=R/bucket=B`: a bucket as run R wrote it; a bucket is only ever written whole, into a new run's folder;
- `files/run=R`: what run R saw of the files it read: length, modification time, the buckets their messages are in;
- `buckets/run=R`: which run's folder holds each bucket after run R. Written last, so a run without it never was, and the
  next one overwrites what it left.

A call lists the files, gives the readers the paths of those that differ from their record, and writes anew the buckets that
hold messages of these files, before or now. All others stay untouched and unread. The number of buckets follows the number
of messages: when there are several times too many for them, one call deals all messages to more buckets.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import schema
from colloquy.session import shared_folder
from colloquy.sources.lines import PLACES, number_lines, number_messages, placed_messages, read_lines
from colloquy.sources.tables import read_optional, remove

ROWS_PER_BUCKET, LEAST_BUCKETS = 500_000, 16
#: Buckets are dealt anew when they hold this many times their rows.
GROWTH = 4
#: So many changed files are given to the reader by name; more are found by their time and their record.
NAMED_FILES = 10_000

FILES = "path string, length bigint, seen_at timestamp, buckets array<int>, run int"
BUCKETS = "bucket int, written int, rows bigint, of int, run int"


def _messages_schema() -> str:
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.MESSAGES.fields]
    return ", ".join([*columns, PLACES])


def _bucket(of: int) -> Column:
    return F.pmod(F.xxhash64("conversation_id"), F.lit(of)).cast("int")


class _State:
    """The store as its last finished run left it: the run's number, and where each bucket is (one small row for each)."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store
        self.run, self.of, self.written, self.rows = -1, LEAST_BUCKETS, {}, {}
        table = read_optional(spark, f"{store}/buckets", BUCKETS)
        if table is not None:
            last = table.agg(F.max("run")).first()[0]
            self.run = -1 if last is None else last
            for r in table.where(F.col("run") == self.run).collect():
                self.of = r["of"]
                if r["bucket"] is not None:
                    self.written[r["bucket"]], self.rows[r["bucket"]] = r["written"], r["rows"]

    def folder(self, bucket: int) -> str:
        return f"{self.store}/messages/run={self.written[bucket]}/bucket={bucket}"

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """Messages with places of the buckets given, of all without; no other folder is listed or read."""
        folders = [self.folder(b) for b in sorted(self.written if buckets is None else set(buckets) & set(self.written))]
        if not folders:
            return self.spark.createDataFrame([], _messages_schema())
        return self.spark.read.schema(_messages_schema()).parquet(*folders)

    def files(self) -> DataFrame | None:
        """The last record of each file: path, length, seen_at, buckets."""
        if self.run < 0:
            return None
        seen = self.spark.read.schema(FILES).parquet(f"{self.store}/files").where(F.col("run") <= self.run)
        last = seen.groupBy("path").agg(F.max_by(F.struct("length", "seen_at", "buckets"), "run").alias("last"))
        return last.select("path", "last.length", "last.seen_at", "last.buckets")


def listed_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, length, seen_at of all files below `path`, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_modification_time").alias("seen_at"))


def changed_files(spark: SparkSession, path: str, store: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, length, seen_at, buckets (of the stored version) of the files that are new or differ from their record."""
    now, seen = listed_files(spark, path, pattern), _State(spark, store).files()
    if seen is None:
        return now.withColumn("buckets", F.array().cast("array<int>"))
    was = seen.select("path", F.col("length").alias("_length"), F.col("seen_at").alias("_seen_at"), "buckets")
    same = (F.col("length") == F.col("_length")) & (F.col("seen_at") == F.col("_seen_at"))
    return now.join(was, "path", "left").where(~F.coalesce(same, F.lit(False))).select(
        "path", "length", "seen_at", F.coalesce("buckets", F.array().cast("array<int>")).alias("buckets"))


def read_changed(spark: SparkSession, changed: DataFrame, path: str, pattern: str, everything: bool) -> DataFrame:
    """Lines of the files of `changed` alone. Few files are named to the reader; of many, it lists those of their times."""
    if everything:
        return read_lines(spark, path, pattern)
    some = [r["path"] for r in changed.select("path").limit(NAMED_FILES + 1).collect()]
    if len(some) <= NAMED_FILES:
        return read_lines(spark, [re.sub(r"([\\\[\]{}*?,])", r"\\\1", unquote(p)) for p in some], pattern)
    oldest = changed.agg(F.date_format(F.min("seen_at") - F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    lines = read_lines(spark, path, pattern, modifiedAfter=oldest)
    return lines.join(changed.select("path"), "path", "left_semi")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The messages of a store."""
    return schema.conform(_State(spark, store).read(), schema.MESSAGES)


def refresh(spark: SparkSession, parse: Callable[..., DataFrame], path: str, store: str, pattern: str = "*.jsonl", **options) -> DataFrame:
    """Bring `store` up to date with the line files below `path`; gives the messages of all files, as one full ingest would.

    `parse` is a reader of a line format. A grown or rewritten file replaces what it gave before; a file that vanished stays
    stored. A call that fails leaves the store as it was. One call at a time may write a store; the folders that a call
    replaces stay until the next one, for readers that still hold them. Without changes nothing is written.
    """
    state = _State(spark, store)
    run, scratch = state.run + 1, shared_folder(spark, "incremental")
    changed_files(spark, path, store, pattern).write.parquet(f"{scratch}/changed")
    changed = spark.read.schema(FILES.rsplit(",", 1)[0]).parquet(f"{scratch}/changed")
    if changed.isEmpty() and state.run >= 0:
        remove(spark, scratch)
        return read_store(spark, store)
    lines = read_changed(spark, changed, path, pattern, everything=state.run < 0)
    parse(number_lines(lines), **options, finish=placed_messages).write.parquet(f"{scratch}/fresh")
    fresh = spark.read.schema(_messages_schema()).parquet(f"{scratch}/fresh")

    total = fresh.count() + sum(state.rows.values())
    deal = total > GROWTH * ROWS_PER_BUCKET * state.of or state.run < 0
    of = max(LEAST_BUCKETS, -(-total // ROWS_PER_BUCKET)) if deal else state.of
    if deal:
        touched = None
    else:
        here = fresh.select(_bucket(of).alias("bucket")).union(changed.select(F.explode("buckets"))).distinct()
        touched = [r["bucket"] for r in here.collect()]
    stay = state.read(touched).join(changed.select("path"), "path", "left_anti").select(fresh.columns)
    numbered = number_messages(stay.unionByName(fresh)).withColumn("bucket", _bucket(of))
    target = f"{store}/messages/run={run}"
    numbered.hint("rebalance", "bucket").sortWithinPartitions("bucket", "conversation_id", "msg_index").write.mode("overwrite").partitionBy(
        "bucket").parquet(target)

    written = spark.read.schema(_messages_schema() + ", bucket int").parquet(target)
    counts = {r["bucket"]: r["n"] for r in written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    _record_files(state, changed, written, f"{store}/files/run={run}", deal)
    kept = {} if touched is None else {b: (w, state.rows[b]) for b, w in state.written.items() if b not in touched}
    now = {**kept, **{b: (run, n) for b, n in counts.items()}}
    rows = [(b, w, n, of) for b, (w, n) in sorted(now.items())] or [(None, None, 0, of)]
    spark.createDataFrame(rows, BUCKETS.rsplit(",", 1)[0]).coalesce(1).write.mode("overwrite").parquet(f"{store}/buckets/run={run}")
    _tidy(spark, store, run)
    remove(spark, scratch)
    return read_store(spark, store)


def _record_files(state: _State, changed: DataFrame, written: DataFrame, target: str, deal: bool) -> None:
    """Record the changed files (after a new deal: all files) with the buckets that hold their messages now."""
    files = changed.select("path", "length", "seen_at")
    before = state.files()
    if deal and before is not None:
        files = files.unionByName(before.select(files.columns).join(changed.select("path"), "path", "left_anti"))
    places = written.join(files.select("path"), "path", "left_semi").groupBy("path").agg(F.collect_set("bucket").alias("buckets"))
    found = files.join(places, "path", "left").withColumn("buckets", F.coalesce("buckets", F.array().cast("array<int>")))
    found.write.mode("overwrite").parquet(target)


def _tidy(spark: SparkSession, store: str, run: int) -> None:
    """Remove the bucket folders that neither this run's state nor the one before it names, as far as the latter knew them."""
    table = spark.read.schema(BUCKETS).parquet(f"{store}/buckets").where("bucket is not null")
    named = {n: {(r["bucket"], r["written"]) for r in table.where(F.col("run") == n).collect()} for n in (run - 2, run - 1, run)}
    for bucket, written in named[run - 2] - named[run - 1] - named[run]:
        remove(spark, f"{store}/messages/run={written}/bucket={bucket}")
