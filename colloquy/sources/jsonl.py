"""Readers of line formats: generic records, coding sessions, agent sessions and transcripts.

What a reader makes of a file's lines depends on that file alone; only the numbers inside a conversation depend on others.
With `finish=placed_messages` a reader gives its messages with their places instead of numbering them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators.ranking import fill_forward
from colloquy.sources.lines import block_text, directory, file_name, file_stem, moment, once, to_messages

# Whole messages the coding-session format writes by itself.
SESSION_NOISE = ["warmup", "prompt is too long", "request interrupted"]


def parse_generic(lines: DataFrame, source: str = "custom", as_of=None, place_ids: bool = False, finish=to_messages) -> DataFrame:
    """One JSON record per line: role, content, a time, and optional ids, model, project and title.

    With `place_ids` a message without an id is named by its line's place (path, block, pos) instead of its number in
    the conversation, so that parts of a conversation read at different times do not share names.
    """
    fields = (
        "role string, content string, timestamp string, created_at string, date string, conversation_id string, "
        "model string, project string, title string, message_id string, parent_id string"
    )
    rec = lines.withColumn("r", F.from_json("value", fields)).where("r.role <> '' AND r.content <> ''")
    role = F.lower("r.role")
    rec = rec.where(~role.isin("system", "tool"))
    raw_ts = F.coalesce(*[F.when(F.col(f"r.{n}") != "", F.col(f"r.{n}")) for n in ("timestamp", "created_at", "date")])
    own_id = F.left(F.md5(F.concat(F.lit(f"{source}:"), file_name(F.col("path")))), F.lit(16))
    now = moment(as_of)

    def given(name: str):
        return F.when(F.col(f"r.{name}") != "", F.col(f"r.{name}"))

    place = F.md5(F.concat_ws(":", "path", "block", "pos"))
    rows = rec.select(
        "path", "block", "pos",
        F.lit(source).alias("source"), given("model").alias("model"), given("project").alias("project"),
        F.coalesce(given("conversation_id"), own_id).alias("conversation_id"),
        F.coalesce(given("title"), file_stem(F.col("path"))).alias("conversation_title"),
        (F.coalesce(given("message_id"), place) if place_ids else given("message_id")).alias("message_id"),
        given("parent_id").alias("parent_id"),
        F.when(role == "assistant", "assistant").otherwise("user").alias("role"),
        F.col("r.content").alias("content"), tx.parse_ts(raw_ts, now).alias("ts"),
    )
    return finish(rows, now)


def parse_sessions(lines: DataFrame, source: str = "claude-code", finish=to_messages) -> DataFrame:
    """Coding-session lines: text blocks of user and assistant, short and automatic messages left out."""
    fields = "type string, timestamp string, sessionId string, uuid string, message struct<role:string,model:string,content:string>"
    rec = lines.withColumn("r", F.from_json("value", fields)).where("r.type IN ('user', 'assistant')")
    # The session of a file is the first that one of its messages names, else the file's stem.
    named = F.when(F.col("r.sessionId") != "", F.struct("block", "pos", "r.sessionId"))
    first = rec.groupBy("path").agg(F.min(named).alias("f")).select(
        F.col("path").alias("_p"), F.col("f.sessionId").alias("_session")
    )
    content = block_text(F.col("r.message.content"))
    role = F.coalesce("r.message.role", "r.type")
    rows = (
        rec.join(first, F.col("path") == F.col("_p"))
        .withColumn("session", F.coalesce("_session", file_stem(F.col("path"))))
        .withColumn("_text", once(content))
        .withColumn("_length", F.length("_text"))
        .withColumn("content", tx.strip(F.col("_text")))
        .withColumn("role", role)
        .where(F.length("content") >= 5)
        .where((F.length("content") > 32) | ~F.lower("content").isin(SESSION_NOISE))
        .where(~((F.col("role") == "user") & (F.col("_length") < 15)))
        .where(~((F.col("role") == "assistant") & (F.col("_length") < 10)))
    )
    project = tx.project_name(directory(F.col("path")))
    stated = F.when(F.col("r.timestamp") != "", F.col("r.timestamp").try_cast("timestamp"))
    # A line without an id of its own is named by its place, which is unique inside the session.
    place = F.concat_ws("_", "session", "block", "pos")
    rows = rows.select(
        "path", "block", "pos", F.lit(source).alias("source"), F.col("r.message.model").alias("model"),
        project.alias("project"), F.concat(F.lit("cc_local_"), "session").alias("conversation_id"),
        project.alias("conversation_title"), F.coalesce("r.uuid", place).alias("message_id"), "role", "content",
        F.coalesce(stated, F.col("modified_at")).alias("ts"), F.lit("day").alias("temporal_precision"),
    )
    return finish(rows, F.current_timestamp())


def parse_agent_sessions(lines: DataFrame, source: str = "clawdbot", as_of=None, finish=to_messages) -> DataFrame:
    """Agent-session lines of three kinds; session id and model carry on to the later messages."""
    fields = (
        "type string, id string, modelId string, parentId string, timestamp string, "
        "message struct<role:string,model:string,timestamp:string,content:string>"
    )
    rec = lines.where(~file_name(F.col("path")).contains(".deleted.")).withColumn("r", F.from_json("value", fields))
    marked = rec.where("r.type IN ('session', 'model_change', 'message')").select(
        "path", "block", "pos", "r",
        F.when(F.col("r.type") == "session", F.col("r.id")).alias("session"),
        F.when(F.col("r.type") == "model_change", F.coalesce("r.modelId", F.lit("unknown"))).alias("carried_model"),
    )
    filled = fill_forward(marked, ["path"], ["block"], ["pos"], ["session", "carried_model"])
    now = moment(as_of)
    raw_ts = F.coalesce("r.timestamp", "r.message.timestamp")
    epoch_ms = F.timestamp_millis(raw_ts.try_cast("double").cast("bigint"))
    rows = filled.where("r.type = 'message' AND r.message.role IN ('user', 'assistant')").select(
        "path", "block", "pos", F.lit(source).alias("source"),
        F.coalesce("r.message.model", "carried_model", F.lit("unknown")).alias("model"),
        F.coalesce("session", file_stem(F.col("path"))).alias("conversation_id"),
        F.concat(F.lit("Clawdbot "), F.left(file_stem(F.col("path")), F.lit(8))).alias("conversation_title"),
        F.col("r.id").alias("message_id"), F.col("r.parentId").alias("parent_id"), F.col("r.message.role").alias("role"),
        once(block_text(F.col("r.message.content"))).alias("content"),
        F.coalesce(epoch_ms, raw_ts.try_cast("timestamp"), now).alias("ts"),
    )
    return finish(rows, now)


def parse_transcripts(lines: DataFrame, source: str = "cursor", as_of=None, finish=to_messages) -> DataFrame:
    """Agent transcripts with a flat or nested message and several names for the two roles."""
    fields = (
        "type string, role string, content string, model string, timestamp string, uuid string, id string, "
        "message struct<role:string,content:string,model:string,timestamp:string>"
    )
    now = moment(as_of)
    nested = F.col("r.message").isNotNull()
    rec = lines.withColumn("r", F.from_json("value", fields)).where("r IS NOT NULL")
    role = F.coalesce(F.when(nested, F.col("r.message.role")).otherwise(F.col("r.role")), "r.type")
    content = block_text(F.when(nested, F.col("r.message.content")).otherwise(F.col("r.content")))
    session, project = file_stem(F.col("path")), directory(F.col("path"), 2)
    rows = (
        rec.withColumn("role", tx.normalize_role(role)).where("role IS NOT NULL").withColumn("content", once(content))
        .where(F.length(tx.strip(F.col("content"))) >= 5)
        .select(
            "path", "block", "pos", F.lit(source).alias("source"),
            F.coalesce("r.message.model", "r.model").alias("model"), project.alias("project"),
            F.concat(F.lit("cursor_agent_"), session).alias("conversation_id"),
            F.concat(F.lit("Cursor Agent: "), project).alias("conversation_title"),
            F.coalesce("r.uuid", "r.id", F.concat_ws("_", session, "block", "pos")).alias("message_id"),
            "role", "content", tx.parse_ts(F.coalesce("r.timestamp", "r.message.timestamp"), now).alias("ts"),
        )
    )
    return finish(rows, now)
