"""Readers of formats where one JSON value holds whole conversations: exports, sessions, key-value chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import schema
from colloquy.functions import text as tx
from colloquy.operators.messages import canonicalize, reply_depths
from colloquy.sources.lines import block_text, directory, file_stem, moment

_NODE = (
    "struct<parent:string,children:array<string>,message:struct<author:struct<role:string>,content:string,"
    "create_time:double,metadata:struct<model_slug:string>>>"
)
EXPORT = f"array<struct<title:string,id:string,conversation_id:string,create_time:double,mapping:map<string,{_NODE}>>>"


def _numbered(rows: DataFrame, group: list[str], order: list[str], as_of: Column) -> DataFrame:
    """Canonical messages numbered inside one parsed JSON value, which bounds the group's size."""
    ready = canonicalize(rows, as_of)
    part = Window.partitionBy(*group)
    out = (
        ready.withColumn("msg_index", (F.row_number().over(part.orderBy(*order)) - 1).cast("int"))
        .withColumn("conversation_msg_count", F.count(F.lit(1)).over(part).cast("int"))
        .withColumn("is_first", (F.col("msg_index") == 0).cast("int"))
        .withColumn("is_last", (F.col("msg_index") == F.col("conversation_msg_count") - 1).cast("int"))
    )
    return schema.conform(out, schema.MESSAGES)


def export_nodes(docs: DataFrame) -> DataFrame:
    """One row per node of every conversation in export files: place, conversation fields and the node.

    `docs` are whole files (path, value), or their elements as `read_array_elements` gives them.
    """
    single = "element" in docs.columns
    conv = docs.select("path", *(["element"] if single else []), F.posexplode(F.from_json("value", EXPORT)).alias("conv_pos", "c"))
    conv = conv.withColumn("conv_pos", F.col("element") if single else F.col("conv_pos")).where("c.mapping IS NOT NULL")
    made_up = F.concat_ws("_", F.floor(F.coalesce("c.create_time", F.lit(0.0))), F.left(F.md5(F.coalesce("c.title", F.lit(""))), F.lit(8)))
    named = F.coalesce(F.when(F.col("c.id") != "", F.col("c.id")), F.when(F.col("c.conversation_id") != "", F.col("c.conversation_id")), made_up)
    return conv.select(
        "path", "conv_pos", named.alias("conv_key"), F.coalesce("c.title", F.lit("Untitled")).alias("title"),
        F.col("c.create_time").alias("conv_time"), F.posexplode("c.mapping").alias("node_pos", "node_id", "node"),
    )


def _part_text(part: Column, any_text: bool) -> Column:
    is_object = F.ltrim(part).startswith("{")
    value = F.get_json_object(part, "$.text")
    if not any_text:
        value = F.when(F.get_json_object(part, "$.content_type") == "text", F.coalesce(value, F.lit("")))
    return F.when(is_object, value).otherwise(part)


def _node_content(any_text: bool) -> Column:
    raw = F.col("node.message.content")
    parts = F.from_json(F.get_json_object(raw, "$.parts"), "array<string>")
    joined = F.array_join(F.transform(parts, lambda p: _part_text(p, any_text)), "\n")
    return F.when(F.ltrim(raw).startswith("{"), tx.strip(joined)).otherwise(raw)


def parse_export(docs: DataFrame, source: str = "chatgpt", tree_order: bool = False, as_of=None) -> DataFrame:
    """Export files: user and assistant nodes by time.

    With `tree_order`, equal times follow the depth in the reply tree, nodes outside every tree are
    left out, and parts of any kind that carry text are read.
    """
    now = moment(as_of)
    nodes = export_nodes(docs)
    stamp = F.coalesce(F.when(F.col("node.message.create_time") != 0, F.col("node.message.create_time")), "conv_time")
    if tree_order:
        # conv_key repeats when an export holds a conversation twice, so the walk keys on its place.
        place = F.concat_ws("#", "path", "conv_pos")
        links = nodes.select(place.alias("conversation_id"), F.col("node_id").alias("message_id"), F.col("node.parent").alias("parent_id"))
        rooted = reply_depths(links)
        roots = rooted.select(F.col("conversation_id").alias("_c")).distinct()
        depths = rooted.select(F.col("conversation_id").alias("_p"), F.col("message_id").alias("_n"), "depth")
        nodes = (
            nodes.withColumn("_place", place)
            .join(depths, (F.col("_place") == F.col("_p")) & (F.col("node_id") == F.col("_n")), "left")
            .join(roots.withColumn("_rooted", F.lit(True)), F.col("_place") == F.col("_c"), "left")
            .where("depth IS NOT NULL OR _rooted IS NULL")
        )
    else:
        nodes = nodes.withColumn("depth", F.lit(0))
    rows = (
        nodes.where("node.message.author.role IN ('user', 'assistant')")
        .withColumn("content", _node_content(tree_order))
        .where(F.length("content") >= 5)
        .select(
            "path", "conv_pos", "depth", "node_pos", F.lit(source).alias("source"),
            F.col("node.message.metadata.model_slug").alias("model"),
            F.concat(F.lit("chatgpt_export_" if tree_order else "chatgpt_"), "conv_key").alias("conversation_id"),
            F.col("title").alias("conversation_title"), F.col("node_id").alias("message_id"),
            F.col("node.parent").alias("parent_id"), F.col("node.message.author.role").alias("role"), "content",
            F.coalesce(F.when(stamp > 0, F.timestamp_micros(F.round(stamp * 1e6).cast("bigint"))), now).alias("ts"),
        )
    )
    return _numbered(rows, ["path", "conv_pos"], ["created", "depth", "node_pos"], now)


def parse_gemini(docs: DataFrame, source: str = "gemini-cli", as_of=None) -> DataFrame:
    """Session files of one JSON object each; the title is the first user message."""
    now = moment(as_of)
    fields = "sessionId string, messages array<struct<id:string,timestamp:string,type:string,content:string,model:string>>"
    doc = docs.withColumn("d", F.from_json("value", fields)).where("d IS NOT NULL")
    session = F.coalesce("d.sessionId", file_stem(F.col("path")))
    parent = directory(F.col("path"), 2)
    project = F.when((parent != "") & (parent != "tmp"), F.concat(F.lit("gemini-"), F.left(parent, F.lit(12)))).otherwise("gemini-cli")
    asked = F.get(F.filter("d.messages", lambda m: m.getField("type") == "user"), F.lit(0)).getField("content")
    opening = F.when(asked != "", F.concat(tx.strip(F.left(asked, F.lit(80))), F.when(F.length(asked) > 80, "...").otherwise("")))
    title = F.coalesce(opening, F.concat(F.lit("Gemini CLI "), F.left(session, F.lit(8))))
    rows = doc.select(
        "path", session.alias("session"), project.alias("project"), title.alias("conversation_title"),
        F.posexplode("d.messages").alias("i", "m"),
    ).where("m.type IN ('user', 'gemini')").where(F.length(tx.strip(F.col("m.content"))) >= 3)
    rows = rows.select(
        "path", "i", F.lit(source).alias("source"), F.col("m.model").alias("model"), "project",
        F.concat(F.lit("gemini_cli_"), "session").alias("conversation_id"), "conversation_title",
        F.coalesce("m.id", F.concat_ws("_", "session", "i")).alias("message_id"),
        tx.normalize_role(F.col("m.type")).alias("role"), F.col("m.content").alias("content"),
        tx.parse_ts(F.col("m.timestamp"), now).alias("ts"),
    )
    return _numbered(rows, ["path"], ["i"], now)


# The keys under which the editor stores its chats.
CHAT_KEY = "workbench.panel.aichat.view.aichat.chatdata"
COMPOSER_PREFIX = "composerData:"


def _json(c: Column, *names: str) -> Column:
    return F.coalesce(*[F.get_json_object(c, f"$.{n}") for n in names])


def parse_kv_chats(items: DataFrame, source: str = "cursor", as_of=None) -> DataFrame:
    """Editor key-value rows (key, value) with chat tabs or composer messages as JSON.

    Every editor store uses the same keys, so a row is told apart by its value as well.
    """
    now = moment(as_of)
    items = items.withColumn("item", F.md5("value"))
    tabs = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.tabs"))
    chat = (
        items.where(F.col("key") == CHAT_KEY)
        .select("key", "item", F.posexplode(F.from_json(tabs, "array<string>")).alias("tab", "t"))
        .select(
            "key", "item", "tab",
            F.concat(F.lit("cursor_"), F.coalesce(_json(F.col("t"), "id"), F.concat(F.lit("cursor_chat_"), "tab"))).alias("conversation_id"),
            F.coalesce(_json(F.col("t"), "title", "name"), F.lit("Cursor Chat")).alias("conversation_title"),
            F.posexplode(F.from_json(_json(F.col("t"), "bubbles"), "array<string>")).alias("i", "m"),
        )
        .select("*", _json(F.col("m"), "type", "role").alias("raw_role"), _json(F.col("m"), "text", "content", "message").alias("content"),
                F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("message_id"), F.lit(1).alias("least"))
    )
    listed = F.coalesce(_json(F.col("value"), "messages"), _json(F.col("value"), "conversation"))
    listed = F.when(F.ltrim(listed).startswith("{"), F.get_json_object(listed, "$.messages")).otherwise(listed)
    composer_id = F.replace("key", F.lit(COMPOSER_PREFIX), F.lit(""))
    composer = (
        items.where(F.col("key").startswith(COMPOSER_PREFIX))
        .select(
            "key", "item", F.lit(0).alias("tab"), F.concat(F.lit("cursor_composer_"), composer_id).alias("conversation_id"),
            F.coalesce(_json(F.col("value"), "title", "name"), F.concat(F.lit("Composer "), F.left(composer_id, F.lit(12)))).alias("conversation_title"),
            F.posexplode(F.from_json(listed, "array<string>")).alias("i", "m"),
        )
        .select("*", _json(F.col("m"), "role", "type").alias("raw_role"), block_text(_json(F.col("m"), "content", "text", "message")).alias("content"),
                _json(F.col("m"), "model").alias("model"), _json(F.col("m"), "id").alias("message_id"), F.lit(5).alias("least"))
    )
    rows = (
        chat.unionByName(composer)
        .withColumn("role", tx.normalize_role(F.col("raw_role")))
        .where(F.col("role").isNotNull() & (F.length(tx.strip(F.col("content"))) >= F.col("least")))
        .withColumn("ts", tx.parse_ts(_json(F.col("m"), "timestamp", "createdAt", "created_at"), now))
        .select("key", "item", "tab", "i", F.lit(source).alias("source"), "model", "conversation_id", "conversation_title",
                F.coalesce("message_id", F.concat_ws("_", "conversation_id", "i")).alias("message_id"), "role", "content", "ts")
    )
    return _numbered(rows, ["key", "item", "tab"], ["i"], now)
