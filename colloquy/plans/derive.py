"""The engine's tables derived from the given parquet tables (FIXTURES.md §2), over all their rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import schema
from colloquy.functions.jsonlist import json_list
from colloquy.operators.messages import canonicalize

NOISE_SAMPLES = ["ok", "Continue", "thank you", "42", "x", "[Tool Result]", "kill 12", "now?"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _minutes(n: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + n * 60)


def turn_text() -> Column:
    """Text of one turn: as given plus markers, or a noise sample."""
    c, t = F.col("conv_id"), F.col("turn")
    n = c + t

    def extra(step: int, text) -> Column:
        return F.when(n % step == 0, text).otherwise(F.lit(""))

    full = F.concat(
        "text",
        extra(3, F.lit(" what is the next step?")),
        extra(7, F.lit(" TODO python database")),
        extra(11, F.lit(" https://example.com/x")),
        extra(5, F.concat(F.lit(" see repo-"), (c % 20).cast("string"))),
        extra(17, F.lit(" no no no, step back and think with me")),
    )
    return F.when((c * 7 + t) % 13 == 0, _pick(NOISE_SAMPLES, n % 8)).otherwise(full)


def raw_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and assistant turns with the message columns that are not derived by the engine."""
    c, t = F.col("conv_id"), F.col("turn")
    conv = F.concat(F.lit("conv_"), c.cast("string"))
    rows = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')")
    return rows.select(
        c, t, "role",
        F.concat(F.lit("src"), (c % 4).cast("string")).alias("source"),
        F.concat(F.lit("model-"), (c % 3).cast("string")).alias("model"),
        F.concat(F.lit("proj-"), (c % 6).cast("string")).alias("project"),
        conv.alias("conversation_id"),
        F.concat(F.lit("Topic "), (c % 25).cast("string")).alias("conversation_title"),
        _minutes(c * 2880 + t * 5).alias("ts"),
        F.concat(conv, F.lit("_"), t.cast("string")).alias("message_id"),
        F.when(t > 0, F.concat(conv, F.lit("_"), (t - 1).cast("string"))).alias("parent_id"),
        t.cast("int").alias("msg_index"),
        F.when(c % 9 == 0, "day").otherwise("exact").alias("temporal_precision"),
        turn_text().alias("content"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical message table, positions as given."""
    return schema.conform(canonicalize(raw_turns(spark, sf_dir)), schema.MESSAGES)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.turns(messages(spark, sf_dir))


PATTERNS = ["deep-dive", "rapid-iteration", "brainstorming", "debugging", "architectural", "connecting-domains", "executing"]
TONES = ["excited", "frustrated", "analytical", "reflective", "focused"]
APPROACHES = ["top-down", "bottom-up", ""]
CATEGORIES = ["code", "plan", "", "note"]


def summary_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries with their lists still as JSON text."""
    d = F.col("doc_id")

    def text(prefix: str, n: Column) -> Column:
        return F.concat(F.lit(prefix), n.cast("string"))

    def listed(*items: Column) -> Column:
        return F.concat(F.lit('["'), F.concat_ws('","', *items), F.lit('"]'))

    questions = (
        F.when(d % 5 == 0, "[]")
        .when(d % 5 == 1, '["none identified"]')
        .otherwise(listed(text("q", d % 13), text("q", d % 7)))
    )
    return table(spark, sf_dir, "documents").select(
        text("conv_", d).alias("conversation_id"), "source", text("Doc ", d).alias("title"),
        (F.col("n_chars") % 50 + 1).alias("msg_count"), F.col("text").alias("summary"),
        listed(text("c", d % 17), text("c", d % 5)).alias("concepts"),
        F.when(d % 4 == 3, "[]").otherwise(listed(text("d", d % 11))).alias("decisions"),
        questions.alias("open_questions"),
        F.when(d % 3 == 0, text("quote ", d % 9)).otherwise("").alias("quotable"),
        listed(text("k", d % 6)).alias("key_insights"), listed(text("domain-", (d + 3) % 8)).alias("connections_to"),
        F.when(d % 10 == 0, "breakthrough").when(d % 3 == 0, "significant").otherwise("routine").alias("importance"),
        text("domain-", d % 8).alias("domain_primary"), text("domain-", (d + 1) % 8).alias("domain_secondary"),
        _pick(schema.STAGES, d % 4).alias("thinking_stage"), _pick(TONES, d % 5).alias("emotional_tone"),
        _pick(PATTERNS, d % 7).alias("cognitive_pattern"), _pick(APPROACHES, d % 3).alias("problem_solving_approach"),
        _pick(CATEGORIES, d % 4).alias("content_category"), F.lit("").alias("resurface_when"),
        F.col("text").alias("embedding_text"), _minutes(d * 60).alias("summarized_at"),
        F.left(F.md5("text"), F.lit(16)).alias("summary_hash"),
    )


LIST_COLUMNS = ["concepts", "decisions", "open_questions", "quotable", "key_insights", "connections_to"]


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary_columns(spark, sf_dir)
    rows = rows.withColumns({c: json_list(F.col(c)) for c in LIST_COLUMNS})
    return schema.conform(rows, schema.SUMMARIES)


def message_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("id"), F.concat(F.lit("conv_"), v.cast("string"), F.lit("_0")).alias("message_id"),
        F.concat(F.lit("conv_"), v.cast("string")).alias("conversation_id"),
        F.concat(F.lit("Topic "), F.col("label").cast("string")).alias("conversation_title"),
        F.concat(F.lit("message "), v.cast("string")).alias("content"),
        F.when(v % 2 == 0, "user").otherwise("assistant").alias("role"),
        (F.lit(2020) + v % 5).cast("int").alias("year"), (v % 12 + 1).cast("int").alias("month"),
        "label", "embedding",
    )


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors: the mean vector of every label."""
    items = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = items.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("p")).select(
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("query_id"),
        F.transform("p", lambda e: e.getField("m")).alias("vector"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("commit_id"),
        F.concat(F.lit("repo-"), (F.col("o_custkey") % 20).cast("string")).alias("repo_name"),
        F.col("o_orderpriority").alias("message"), F.col("o_orderstatus").alias("author"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("n")).agg(
        F.count(F.lit(1)).alias("stars"), F.max("o_orderdate").cast("timestamp").alias("pushed_at")
    )
    name = F.concat(F.lit("repo-"), F.col("n").cast("string"))
    return per.select(
        name.alias("repo_name"), F.concat(F.lit("repository number "), F.col("n").cast("string")).alias("description"),
        F.when(F.col("n") % 5 != 4, _pick(["Python", "Go", "Rust", "SQL"], F.col("n") % 4)).alias("language"),
        F.concat(F.lit("https://example.com/"), name).alias("url"), _minutes(F.col("n") * 7 * 1440).alias("created_at"),
        "pushed_at", (F.col("n") % 3 == 0).alias("is_private"), "stars",
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.concat(F.lit("doc-"), d.cast("string"), F.lit(".md")).alias("filename"),
        F.when(d % 6 != 5, F.concat(F.lit("Doc "), d.cast("string"))).alias("title"), F.col("text").alias("content"),
        F.col("source").alias("project"), _pick(["FIRST_PERSON", "THIRD_PERSON", "MIXED"], d % 3).alias("voice"),
        F.when((F.col("quality") == 1) & (d % 4 == 0), "BREAKTHROUGH").otherwise("STEADY").alias("energy"),
        (F.col("n_chars") % 100).alias("depth_score"), (d % 50).alias("harvest_score"), (d % 6).alias("decision_count"),
        F.regexp_count("text", F.lit(r"\S+")).alias("word_count"), (d % 9).alias("todos_open"), (d % 4).alias("todos_done"),
        _pick(["draft", "final"], d % 2).alias("draft_status"), F.concat(F.lit("c"), (d % 17).cast("string")).alias("seed_concepts"),
        F.substring_index("text", "\n", 1).alias("first_line"), _minutes(d * 60).alias("modified_at"),
    )


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_returnflag").alias("source"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost_usd"), F.col("l_quantity").alias("tokens_total"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_of(table(spark, sf_dir, "events"))


def telemetry_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    event = (
        F.when(kind == "click", "tool_called").when(kind == "view", "first_query")
        .when(kind == "purchase", "setup_started").when(kind == "signup", "setup_completed").otherwise(kind)
    )
    props = F.to_json(
        F.struct(
            F.when(k % 11 != 10, F.concat(F.lit("tool-"), (k % 11).cast("string"))).alias("tool"),
            F.col("value").alias("latency_ms"), F.concat(F.lit("e"), (k % 3).cast("string")).alias("error_type"),
        )
    )
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("machine_id"), event.alias("event"), props.alias("props"),
    )


def layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """L0 from all turns, L1 one per L0 row, L2 and L3 one per document; some rows break each rule."""
    c, t = F.col("conv_id"), F.col("turn")
    n = c * 1000 + t
    l0 = table(spark, sf_dir, "conversations").select(
        n.alias("id"), F.concat(F.lit("t"), (c % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("u"), (c % 10).cast("string")).alias("owner_user_id"),
        F.concat(F.lit("src"), (c % 4).cast("string")).alias("source"),
        F.concat(F.lit("m"), F.when(n % 19 == 0, F.floor(n / 2)).otherwise(n).cast("string")).alias("message_id"),
        F.when(n % 23 == 0, "narrator").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"),
        F.when(n % 29 == 0, "guess").otherwise("exact").alias("temporal_precision"),
        _pick(["private", "tenant", "public", "secret"], F.when(n % 13 == 0, 3).otherwise(n % 3)).alias("visibility"),
        _minutes(c * 2880 + t * 5).alias("msg_timestamp"),
    )
    l1 = l0.select(
        (F.col("id") * 10).alias("id"), F.when(F.col("id") % 37 == 5, -F.col("id")).otherwise(F.col("id")).alias("l0_id"),
        F.when(F.col("id") % 31 == 0, "guess").otherwise("entity").alias("extraction_type"),
        F.lit("v1").alias("extractor_version"), F.lit("private").alias("visibility"),
        F.col("msg_timestamp").alias("extracted_at"),
    )
    d = F.col("doc_id")
    base = d % 100 * 1000
    l2_cites = (
        F.when(d % 12 == 0, F.lit("{}"))
        .when(d % 4 == 1, F.concat(F.lit('{"l0_ids": ['), base.cast("string"), F.lit("]}")))
        .otherwise(F.concat(F.lit('{"l1_ids": ['), (base * 10).cast("string"), F.lit(", "), ((base + 1) * 10).cast("string"), F.lit("]}")))
    )
    source = table(spark, sf_dir, "documents")
    l2 = source.select(
        d.alias("id"), F.concat(F.lit("t"), (d % 3).cast("string")).alias("tenant_id"),
        F.when(d % 41 == 0, "notes").otherwise("enhanced-extraction-v5").alias("synthesis_type"),
        F.lit("v5").alias("synthesizer_version"),
        F.concat(F.lit("conv_"), F.when(d % 43 == 0, d + 3).otherwise(d).cast("string")).alias("conversation_id"),
        F.col("text").alias("summary"), F.when(d % 47 == 0, "dreaming").otherwise("exploring").alias("thinking_stage"),
        F.when(d % 53 == 0, "huge").otherwise("routine").alias("importance"), F.lit("tenant").alias("visibility"),
        l2_cites.alias("citations"), _minutes(d * 60).alias("synthesized_at"),
    )
    l3 = source.select(
        d.alias("id"), F.when(d % 59 == 0, "mood").otherwise("open-threads").alias("fusion_type"),
        F.lit("tenant").alias("visibility"),
        F.when(d % 15 == 0, F.lit('{"l2_ids": []}'))
        .otherwise(F.concat(F.lit('{"l2_ids": ['), d.cast("string"), F.lit(", "), (d + 1).cast("string"), F.lit("]}"))).alias("citations"),
        _minutes(d * 60 + 30).alias("fused_at"),
    )
    return l0, l1, l2, l3


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("t"), (F.col("c_nationkey") % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("u"), (F.col("c_custkey") % 50).cast("string")).alias("user_id"),
    )


def principles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        i.alias("position"), F.concat(F.lit("Principle "), i.cast("string")).alias("name"), F.col("text").alias("definition"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("formula"),
    )


# Turns per file split of the derived line files.
SPLIT = 1000


def generic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as record lines of seven files: several time formats, unknown roles, some broken lines."""
    c, t = F.col("conv_id"), F.col("turn")
    moment = _minutes(c * 2880 + t * 5)
    seconds = F.unix_seconds(moment)
    stamp = (
        F.when(c % 4 == 0, F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(c % 4 == 1, seconds.cast("string"))
        .when(c % 4 == 2, (seconds * 1000).cast("string"))
        .otherwise(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
    )
    record = F.to_json(
        F.struct(
            F.when((c + t) % 10 == 0, "Narrator").otherwise(F.col("role")).alias("role"),
            F.when((c + t) % 14 == 0, F.lit("   ")).otherwise(F.col("text")).alias("content"), stamp.alias("timestamp"),
            F.concat(F.lit("g"), c.cast("string")).alias("conversation_id"),
            F.when(c % 5 != 0, F.concat(F.lit("Topic "), (c % 25).cast("string"))).alias("title"),
            F.when(c % 2 == 0, "m1").alias("model"),
        )
    )
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("file:///logs/part-"), (c % 7).cast("string"), F.lit(".jsonl")).alias("path"),
        (c * 1_000_000 + F.floor(t / SPLIT)).alias("block"), (c * 1000 + t).alias("pos"),
        F.when((c + t) % 16 == 0, F.concat(F.lit("{broken "), record)).otherwise(record).alias("value"),
        moment.alias("modified_at"),
    )


def _blocks(text: Column) -> Column:
    return F.array(
        F.struct(F.lit("text").alias("type"), text.alias("text")),
        F.struct(F.lit("tool_use").alias("type"), F.lit("hidden").alias("text")),
    )


def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as coding-session lines, one file per conversation."""
    c, t = F.col("conv_id"), F.col("turn")
    moment = _minutes(c * 2880 + t * 5)
    value = F.to_json(
        F.struct(
            F.col("role").alias("type"), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            F.when(c % 3 != 0, F.concat(F.lit("s"), c.cast("string"))).alias("sessionId"),
            F.concat(F.lit("u"), c.cast("string"), F.lit("-"), t.cast("string")).alias("uuid"),
            F.struct(F.col("role"), F.lit("m2").alias("model"), _blocks(F.col("text")).alias("content")).alias("message"),
        )
    )
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("file:///p/-Users-me-Documents-proj-"), (c % 6).cast("string"), F.lit("/sess"), c.cast("string"), F.lit(".jsonl")).alias("path"),
        F.floor(t / SPLIT).alias("block"), t.alias("pos"), value.alias("value"), moment.alias("modified_at"),
    )


def agent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as agent-session lines; session and model records come first and again on the way."""
    c, t = F.col("conv_id"), F.col("turn")
    moment = _minutes(c * 2880 + t * 5)
    rows = table(spark, sf_dir, "conversations")
    place = [
        F.concat(F.lit("file:///a/x/sessions/run"), (c % 40).cast("string"), F.when(c % 40 == 39, F.lit(".deleted.1")).otherwise(F.lit("")), F.lit(".jsonl")).alias("path"),
        (c * 1_000_000 + F.floor(t / SPLIT)).alias("block"),
    ]

    def at(offset: int) -> Column:
        return (t * 10 + offset).alias("pos")

    heads = rows.where("turn = 0").select(
        *place, at(0), F.to_json(F.struct(F.lit("session").alias("type"), F.concat(F.lit("agent"), c.cast("string")).alias("id"))).alias("value"),
        moment.alias("modified_at"),
    )
    models = rows.where((t % 3 == 0) & (c % 2 == 0)).select(
        *place, at(1), F.to_json(F.struct(F.lit("model_change").alias("type"), F.concat(F.lit("model"), (t % 2).cast("string")).alias("modelId"))).alias("value"),
        moment.alias("modified_at"),
    )
    value = F.to_json(
        F.struct(
            F.lit("message").alias("type"), F.concat(F.lit("a"), c.cast("string"), F.lit("-"), t.cast("string")).alias("id"),
            (F.unix_seconds(moment) * 1000).alias("timestamp"), F.struct(F.col("role"), _blocks(F.col("text")).alias("content")).alias("message"),
        )
    )
    return heads.unionByName(models).unionByName(rows.select(*place, at(2), value.alias("value"), moment.alias("modified_at")))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as agent-transcript lines with role synonyms, flat and nested."""
    c, t = F.col("conv_id"), F.col("turn")
    moment = _minutes(c * 2880 + t * 5)
    stamp = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "bot").otherwise(F.col("role")).alias("role")
    nested = F.to_json(F.struct(stamp, F.struct(role, F.array("text").alias("content")).alias("message")))
    flat = F.to_json(F.struct(stamp, role, F.col("text").alias("content"), F.concat(F.lit("x"), c.cast("string"), F.lit("-"), t.cast("string")).alias("id")))
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("file:///c/proj-"), (c % 6).cast("string"), F.lit("/agent-transcripts/tr"), c.cast("string"), F.lit(".jsonl")).alias("path"),
        F.floor(t / SPLIT).alias("block"), t.alias("pos"), F.when(c % 2 == 0, nested).otherwise(flat).alias("value"), moment.alias("modified_at"),
    )


PART = 510


def _conversation_docs(spark: SparkSession, sf_dir: str, entry: Column) -> DataFrame:
    """Entries of every conversation as arrays of at most PART turns, for formats of one JSON value each."""
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", F.floor(F.col("turn") / PART).alias("part"), F.struct("turn", entry.alias("e")).alias("x")
    )
    listed = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("x")).alias("_x"))
    name = F.concat_ws("-", "conv_id", "part")
    return listed.select("conv_id", name.alias("name"), F.transform("_x", lambda x: x.getField("e")).alias("entries"))


def export_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as export files: a root node, then every turn as a reply to the one before or branching."""
    c, t = F.col("conv_id"), F.col("turn")
    parent = F.when(t == 0, F.lit("root")).otherwise(F.concat(F.lit("n"), F.when(t % 3 == 2, t - 2).otherwise(t - 1).cast("string")))
    node = F.struct(
        F.concat(F.lit("n"), t.cast("string")).alias("key"),
        F.struct(
            parent.alias("parent"),
            F.struct(
                F.struct(F.col("role")).alias("author"), F.struct(F.array("text").alias("parts")).alias("content"),
                (F.unix_seconds(_minutes(c * 2880)) + F.floor(t / 2) * 300).cast("double").alias("create_time"),
                F.struct(F.lit("m3").alias("model_slug")).alias("metadata"),
            ).alias("message"),
        ).alias("value"),
    )
    convs = _conversation_docs(spark, sf_dir, node)
    doc = F.array(
        F.struct(
            F.concat(F.lit("Topic "), (c % 25).cast("string")).alias("title"), F.concat(F.lit("e"), "name").alias("id"),
            F.unix_seconds(_minutes(c * 2880)).cast("double").alias("create_time"), F.map_from_entries("entries").alias("mapping"),
        )
    )
    return convs.select(F.concat(F.lit("file:///e/export-"), "name", F.lit(".json")).alias("path"), F.to_json(doc).alias("value"))


def export_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same conversations, all of a partition as the lines of one JSON array."""
    def lines(frames):
        mark = "["
        for frame in frames:
            for value in frame["value"]:
                yield pd.DataFrame({"value": [mark + value.strip()[1:-1]]})
                mark = ","
        yield pd.DataFrame({"value": [mark + "]" if mark == "[" else "]"]})

    return export_docs(spark, sf_dir).select("value").mapInPandas(lines, "value string")


def gemini_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    moment = _minutes(c * 2880 + t * 5)
    entry = F.struct(
        F.when(t % 2 == 0, F.concat(F.lit("i"), t.cast("string"))).alias("id"), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.when(F.col("role") == "assistant", "gemini").otherwise(F.col("role")).alias("type"), F.col("text").alias("content"),
    )
    convs = _conversation_docs(spark, sf_dir, entry)
    doc = F.struct(F.concat(F.lit("s"), "name").alias("sessionId"), F.col("entries").alias("messages"))
    return convs.select(
        F.concat(F.lit("file:///g/tmp/hash"), "name", F.lit("/chats/s.json")).alias("path"), F.to_json(doc).alias("value")
    )


def kv_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    entry = F.struct(
        F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise("system").alias("type"),
        F.col("text"), (F.unix_seconds(_minutes(c * 2880 + t * 5)) * 1000).alias("timestamp"),
    )
    convs = _conversation_docs(spark, sf_dir, entry)
    chat = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("tab"), "name").alias("id"), F.col("entries").alias("bubbles"))).alias("tabs")))
    composer = F.to_json(F.struct(F.concat(F.lit("Topic "), "name").alias("title"), F.col("entries").alias("messages")))
    key = F.when(c % 2 == 0, "workbench.panel.aichat.view.aichat.chatdata").otherwise(F.concat(F.lit("composerData:k"), "name"))
    return convs.select(key.alias("key"), F.when(c % 2 == 0, chat).otherwise(composer).alias("value"))


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary record per document, in the current and the older shape."""
    d = F.col("doc_id")

    def text(prefix: str, n: Column) -> Column:
        return F.concat(F.lit(prefix), n.cast("string"))

    relation = F.when(d % 7 == 0, "causes").otherwise("implements")
    edge = F.struct(text("c", d % 17).alias("from"), text("c", d % 5).alias("to"), relation.alias("relation"),
                    F.when(d % 9 == 0, 0.3).otherwise(0.8).alias("confidence"))
    asset = F.struct(F.when(d % 8 == 0, "poem").otherwise("quote").alias("kind"),
                     F.when(d % 6 == 0, "short").otherwise("a text that is long enough").alias("content"))
    concept = F.struct(text("c", d % 17).alias("name"), F.lit("tool").alias("kind"))
    current = F.to_json(
        F.struct(
            text("conv_", d).alias("conversation_id"), F.col("source"), text("Doc ", d).alias("title"), (d % 40).alias("msg_count"),
            F.struct(
                F.struct(F.col("text"), text("Domain_", d % 8).alias("domain_primary"), F.lit("exploring").alias("thinking_stage"),
                         F.lit("when needed").alias("resurface_when")).alias("summary"),
                F.array_repeat(concept, (d % 7).cast("int")).alias("concepts"), F.array(edge).alias("edges"), F.array(asset).alias("assets"),
                F.array(text("d", d % 11)).alias("decisions"), F.array(text("q", d % 13), text("q", d % 7)).alias("open_questions"),
            ).alias("data"),
        )
    )
    older = F.to_json(
        F.struct(
            text("conv_", d).alias("conversation_id"), F.col("source"), text("Doc ", d).alias("title"), (d % 40).alias("msg_count"),
            F.struct(F.col("text").alias("summary"), text("domain_", d % 8).alias("domain_primary"), F.lit("significant").alias("importance"),
                     F.array(text("c", d % 17)).alias("concepts"), F.array(text("d", d % 11)).alias("decisions")).alias("data"),
        )
    )
    return table(spark, sf_dir, "documents").select(F.when(d % 3 == 0, older).otherwise(current).alias("value"))


def problem_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monthly problem table rolled up from the summaries."""
    s = summaries(spark, sf_dir)
    return s.groupBy(F.trunc(F.to_date("summarized_at"), "month").alias("month_start")).agg(
        F.count(F.lit(1)).alias("chain_count"), F.array_sort(F.collect_set("domain_primary")).alias("domains"),
        F.array_sort(F.collect_set("importance")).alias("difficulties"), F.array_sort(F.collect_set("cognitive_pattern")).alias("debugging_patterns"),
        F.min("title").alias("hardest_problem"), F.max("title").alias("aha_quotes"),
    )
