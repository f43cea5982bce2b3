"""Canonical message table: derived columns, numbering, noise split, reply trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import schema
from colloquy.functions import noise, text
from colloquy.operators.ranking import number_in_order, number_rows
from colloquy.session import ensure_checkpoint_dir


def canonicalize(raw: DataFrame, as_of: Column | None = None, max_chars: int | None = None) -> DataFrame:
    """Derived columns of the canonical table; rows without text are dropped.

    Needs source, conversation_id, role, content, ts; model, project, conversation_title,
    message_id, parent_id, temporal_precision and msg_index are used when present. Other columns
    pass through. The whole text is stored; `max_chars` cuts the stored content on request, counts and flags never.
    """
    have = set(raw.columns)

    def opt(name: str, default: Column, dtype: str = "string") -> Column:
        return F.coalesce(F.col(name), default).cast(dtype) if name in have else default.cast(dtype)

    null = F.lit(None)
    df = raw.withColumn("content", text.strip(F.col("content"))).where(F.length("content") > 0)
    ts = F.coalesce("ts", as_of) if as_of is not None else F.col("ts")
    content = F.col("content")
    precision = opt("temporal_precision", F.lit("exact"))
    index = opt("msg_index", F.lit(0), "int")
    title = opt("conversation_title", F.lit("Untitled"))
    derived = {
        "model": opt("model", null),
        "project": opt("project", null),
        "conversation_title": F.when(title == "", F.lit("Untitled")).otherwise(title),
        "created": ts,
        "updated": ts,
        "year": F.year(ts),
        "month": F.month(ts),
        "day_of_week": F.date_format(ts, "EEEE"),
        "hour": F.hour(ts),
        "message_id": opt("message_id", F.concat_ws("_", "conversation_id", index)),
        "parent_id": opt("parent_id", null),
        "msg_index": index,
        "msg_timestamp": ts,
        "timestamp_is_fallback": (precision != "exact").cast("int"),
        "content_type": F.lit("text"),
        "is_first": (index == 0).cast("int"),
        "is_last": F.lit(0),
        "word_count": text.word_count(content),
        "char_count": F.length(content),
        "conversation_msg_count": F.lit(0),
        "has_code": text.has_code(content),
        "has_url": text.has_url(content),
        "has_question": text.flag(content.contains("?")),
        "has_attachment": F.lit(0),
        "has_citation": F.lit(0),
        "content": content if max_chars is None else F.left(content, F.lit(max_chars)),
        "temporal_precision": precision,
    }
    extra = [c for c in raw.columns if c not in derived and c != "ts"]
    out = df.select(*extra, *[c.alias(n) for n, c in derived.items()])
    order = [f.name for f in schema.MESSAGES.fields]
    return out.select(*order, *[c for c in extra if c not in order])


def finalize(
    messages: DataFrame, order: list[str] | None = None, block: list[str] | None = None
) -> DataFrame:
    """Renumber every conversation from 0 and set its count, first and last flags.

    Default order is (created, message_id), in even ranges of the whole table, which runs a job when called. Readers of line
    files pass the file split as block. Neither way has a conversation to fit into one task.
    """
    df = messages.drop("msg_index", "conversation_msg_count", "is_first", "is_last")
    if order is None:
        df = number_in_order(df, ["conversation_id"], ["created", "message_id"], "msg_index", "conversation_msg_count")
    else:
        df = number_rows(df, ["conversation_id"], block, order, "msg_index", "conversation_msg_count")
    df = df.withColumn("is_first", (F.col("msg_index") == 0).cast("int"))
    df = df.withColumn("is_last", (F.col("msg_index") == F.col("conversation_msg_count") - 1).cast("int"))
    return schema.conform(df, schema.MESSAGES)


def split_noise(messages: DataFrame, role: str | None = None) -> DataFrame:
    """All rows with a nullable drop_reason; null means kept. `role` limits the test to one role."""
    reason = noise.drop_reason(F.col("content"))
    if role:
        reason = F.when(F.col("role") == role, reason)
    return messages.withColumn("drop_reason", reason)


def kept(messages: DataFrame) -> DataFrame:
    return split_noise(messages).where("drop_reason IS NULL").drop("drop_reason")


def dropped_rows(messages: DataFrame) -> DataFrame:
    return split_noise(messages).where("drop_reason IS NOT NULL")


def noise_manifest(messages: DataFrame) -> DataFrame:
    """Rows in, kept, dropped and the share of user rows kept."""
    flagged = split_noise(messages)
    keep = F.col("drop_reason").isNull()
    user = F.col("role") == "user"
    return flagged.agg(
        F.count(F.lit(1)).alias("l0_in"),
        F.count_if(keep).alias("l1_kept"),
        F.count_if(~keep).alias("l1_dropped"),
        text.percent(F.count_if(keep & user), F.count_if(user)).alias("user_yield_pct"),
    )


def dedupe_messages(messages: DataFrame) -> DataFrame:
    """First row of each message_id by (created, conversation_id, content)."""
    order = Window.partitionBy("message_id").orderBy("created", "conversation_id", "content")
    return messages.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def reply_depths(nodes: DataFrame) -> DataFrame:
    """Depth of every reply below its root; nodes(conversation_id, message_id, parent_id).

    Roots have no parent or one outside the conversation. Each round doubles the distance the rows
    without a depth have looked upward, so a chain of n replies takes log2(n) joins, each of the rows
    that have not met a root yet. A round in which none does leaves reply cycles only; these are left
    out, as a walk down from the roots would leave them out.
    """
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)
    key = ["conversation_id", "message_id"]
    ids = nodes.select(*key, "parent_id").dropDuplicates(key)
    known = ids.select("conversation_id", F.col("message_id").alias("parent_id"))
    inside = ids.join(known, ["conversation_id", "parent_id"], "left_semi").select(
        *key, F.col("parent_id").alias("up")
    )
    state = (
        ids.select(*key)
        .join(inside, key, "left")
        .withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1))
        .checkpoint()
    )
    done, active = state.where("up IS NULL"), state.where("up IS NOT NULL")
    before, left = -1, active.count()
    while left not in (0, before):
        above = done.union(active).select(
            "conversation_id",
            F.col("message_id").alias("up"),
            F.col("up").alias("up2"),
            F.col("depth").alias("depth2"),
        )
        step = (
            active.join(above, ["conversation_id", "up"])
            .select(*key, F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"))
            .checkpoint()
        )
        done, active = done.union(step.where("up IS NULL")), step.where("up IS NOT NULL")
        before, left = left, active.count()
    return done.select(*key, F.col("depth").cast("int"))


def reply_tree(messages: DataFrame) -> DataFrame:
    """Messages in tree order: conversation, depth, then time."""
    depths = reply_depths(messages.select("conversation_id", "message_id", "parent_id"))
    return messages.join(depths, ["conversation_id", "message_id"]).select(
        "conversation_id", "message_id", "parent_id", "depth", "role", F.col("created").alias("ts")
    )
