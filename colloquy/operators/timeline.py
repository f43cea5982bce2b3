"""Counts, timelines, trends and snapshots over messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.matching import match_terms
from colloquy.operators.ranking import newest, running_total, top_per
from colloquy.operators.search import Terms, _moment, user_questions



def health(turns: DataFrame) -> DataFrame:
    """Turns per source with their time range, and one '(all)' row."""
    return turns.rollup("src").agg(
        F.grouping("src").alias("_all"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    ).select(F.when(F.col("_all") == 1, "(all)").otherwise(F.col("src")).alias("src"), "n", "first_ts", "last_ts")


def archive_stats(messages: DataFrame, models: int = 10) -> DataFrame:
    """Archive totals, then counts per source and for the most used models."""
    measures = [
        F.count(F.lit(1)).alias("messages"),
        F.countDistinct("conversation_id").alias("conversations"),
        F.min("created").alias("first_msg"),
        F.max("created").alias("last_msg"),
    ]
    total = messages.agg(*measures).select(F.lit("total").alias("section"), F.lit("all").alias("name"), "*")
    by_source = messages.groupBy("source").agg(*measures).select(
        F.lit("source").alias("section"), F.col("source").alias("name"), "messages", "conversations", "first_msg", "last_msg"
    )
    top = messages.groupBy("model").agg(*measures).orderBy(F.col("messages").desc(), "model").limit(models)
    by_model = top.select(
        F.lit("model").alias("section"), F.col("model").alias("name"), "messages", "conversations", "first_msg", "last_msg"
    )
    return total.unionByName(by_source).unionByName(by_model)


def conv_stats(messages: DataFrame) -> DataFrame:
    """One row per conversation: size, words, questions, messages with code."""
    return messages.groupBy("conversation_id").agg(
        F.max("conversation_title").alias("conversation_title"),
        F.count(F.lit(1)).alias("message_count"),
        F.sum(F.col("word_count").cast("long")).alias("total_words"),
        F.count_if((F.col("role") == "user") & (F.col("has_question") == 1)).alias("questions_asked"),
        F.count_if(F.col("has_code") == 1).alias("code_messages"),
    )


def conv_summary(messages: DataFrame, deep: int = 100) -> DataFrame:
    """Archive-wide totals of the conversation statistics and the number of deep conversations."""
    return conv_stats(messages).agg(
        F.count(F.lit(1)).alias("conversations"),
        F.sum("message_count").alias("messages"),
        F.sum("total_words").alias("words"),
        F.sum("questions_asked").alias("questions"),
        F.sum("code_messages").alias("code_msgs"),
        F.round(F.avg("message_count"), 6).alias("avg_length"),
        F.count_if(F.col("message_count") >= deep).alias("deep_conversations"),
    )


def longest_conversations(messages: DataFrame, n: int = 5) -> DataFrame:
    return (
        conv_stats(messages)
        .orderBy(F.col("message_count").desc(), "conversation_id")
        .limit(n)
        .select("conversation_id", "conversation_title", "message_count")
    )


def message_totals(messages: DataFrame) -> DataFrame:
    user = F.col("role") == "user"
    return messages.agg(
        F.count(F.lit(1)).alias("messages"),
        F.countDistinct("conversation_id").alias("conversations"),
        F.count_if(user).alias("user_messages"),
        F.count_if(user & (F.col("has_question") == 1)).alias("questions"),
    )


def timeline_day(messages: DataFrame, date: str | None = None, limit: int = 20) -> DataFrame:
    """Busiest conversations titles per source on one day, or on every day."""
    rows = messages
    if date:
        day = F.lit(date).cast("date")
        rows = rows.where((F.col("created") >= day.cast("timestamp")) & (F.col("created") < F.date_add(day, 1).cast("timestamp")))
    counted = rows.groupBy(F.to_date("created").alias("date"), "source", "conversation_title").agg(F.count(F.lit(1)).alias("msg_count"))
    return top_per(counted, ["date"], [F.col("msg_count").desc(), F.col("source"), F.col("conversation_title")], limit)


def convs_by_date(turns: DataFrame, date: str | None = None, src: str | None = None) -> DataFrame:
    """Conversations active per day: turns, time range and the first user text of that day."""
    rows = turns if src is None else turns.where(F.col("src") == src)
    if date:
        day = F.lit(date).cast("date")
        rows = rows.where((F.col("ts") >= day.cast("timestamp")) & (F.col("ts") < F.date_add(day, 1).cast("timestamp")))
    opening = F.struct("ts", "message_id", F.substring("text", 1, 240).alias("text"))
    return (
        rows.groupBy(F.to_date("ts").alias("date"), "src", "conv_id")
        .agg(
            F.count(F.lit(1)).alias("turns"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.min(F.when(F.col("role") == "user", opening)).getField("text").alias("first_user_text"),
        )
    )


def _mentions(messages: DataFrame, topics: Terms) -> DataFrame:
    return match_terms(messages.where("role = 'user'"), ["content"], topics, key="message_id")


def velocity(messages: DataFrame, topics: Terms, granularity: str = "month") -> DataFrame:
    """Mentions and distinct conversations of each topic per month or quarter."""
    if granularity == "quarter":
        period = F.concat(F.year("created"), F.lit("-Q"), F.quarter("created"))
    else:
        period = F.date_format("created", "yyyy-MM")
    return _mentions(messages, topics).groupBy("topic", period.alias("period")).agg(
        F.count(F.lit(1)).alias("mentions"), F.countDistinct("conversation_id").alias("conversations")
    )


def velocity_trend(messages: DataFrame, topics: Terms, granularity: str = "month") -> DataFrame:
    """Trend of each topic: the last three active periods against the first three, and the peak."""
    per = velocity(messages, topics, granularity)
    ahead = Window.partitionBy("topic").orderBy("period")
    back = Window.partitionBy("topic").orderBy(F.col("period").desc())
    placed = per.withColumn("_a", F.row_number().over(ahead)).withColumn("_b", F.row_number().over(back))
    early = F.avg(F.when(F.col("_a") <= 3, F.col("mentions")))
    late = F.avg(F.when(F.col("_b") <= 3, F.col("mentions")))
    agg = placed.groupBy("topic").agg(
        F.count(F.lit(1)).alias("periods"),
        F.sum("mentions").alias("total_mentions"),
        F.max("mentions").alias("peak_mentions"),
        F.min(F.struct((-F.col("mentions")).alias("m"), F.col("period").alias("p"))).getField("p").alias("peak_period"),
        early.alias("_early"),
        late.alias("_late"),
    )
    trend = (
        F.when(F.col("periods") < 6, "insufficient")
        .when(F.col("_late") > F.col("_early") * 1.5, "accelerating")
        .when(F.col("_late") < F.col("_early") * 0.5, "declining")
        .otherwise("stable")
    )
    return agg.select(
        "topic", "periods", "total_mentions", "peak_period", "peak_mentions",
        F.round("_early", 6).alias("early_avg"), F.round("_late", 6).alias("recent_avg"), trend.alias("trend"),
    )


def first_mention(messages: DataFrame, topics: Terms) -> DataFrame:
    """First and last user mention of each topic, the days between and the totals."""
    row = F.struct(
        "created", "message_id", "conversation_id", "conversation_title", "source",
        F.substring("content", 1, 300).alias("preview"),
    )
    return (
        _mentions(messages, topics)
        .groupBy("topic")
        .agg(
            F.min(row).alias("f"),
            F.max(F.struct("created", "message_id", "conversation_title")).alias("l"),
            F.count(F.lit(1)).alias("total_mentions"),
            F.countDistinct("conversation_id").alias("total_conversations"),
        )
        .select(
            "topic",
            F.col("f.created").alias("first_created"),
            F.col("f.conversation_title").alias("first_title"),
            F.col("f.conversation_id").alias("first_conversation_id"),
            F.col("f.source").alias("source"),
            F.col("f.preview").alias("preview"),
            F.col("l.created").alias("last_created"),
            F.col("l.conversation_title").alias("last_title"),
            F.floor((F.unix_timestamp("l.created") - F.unix_timestamp("f.created")) / 86400).alias("span_days"),
            "total_mentions",
            "total_conversations",
        )
    )


def month_snapshot(messages: DataFrame, month: str | None = None) -> DataFrame:
    """Totals of each month and its activity class against the mean month."""
    user = F.col("role") == "user"
    per = messages.groupBy(F.date_format("created", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("total_msgs"),
        F.countDistinct("conversation_id").alias("conversations"),
        F.count_if(user).alias("user_msgs"),
        F.count_if(user & (F.col("has_question") == 1)).alias("questions"),
    )
    mean = messages.groupBy(F.date_format("created", "yyyy-MM").alias("month")).count().agg(F.avg("count")).scalar()
    out = per.withColumn("_mean", mean)
    if month:
        out = out.where(F.col("month") == month)
    level = (
        F.when(F.col("total_msgs") > F.col("_mean") * 1.5, "high")
        .when(F.col("total_msgs") > F.col("_mean") * 0.5, "normal")
        .otherwise("low")
    )
    return out.select(
        "month", "total_msgs", "conversations", "user_msgs", "questions",
        F.round("_mean", 6).alias("avg_monthly"),
        F.floor(F.round(F.col("total_msgs") / F.col("_mean") * 100, 6)).alias("pct_of_avg"),
        level.alias("activity"),
    )


def _months(messages: DataFrame, month: str | None) -> DataFrame:
    out = messages.withColumn("period", F.date_format("created", "yyyy-MM"))
    return out.where(F.col("period") == month) if month else out


def month_titles(messages: DataFrame, month: str | None = None, n: int = 7) -> DataFrame:
    title = F.col("conversation_title")
    rows = _months(messages, month).where(title.isNotNull() & (title != "") & (title != "Untitled"))
    counted = rows.groupBy(F.col("period").alias("month"), "conversation_title").agg(F.count(F.lit(1)).alias("msg_count"))
    return top_per(counted, ["month"], [F.col("msg_count").desc(), title], n)


def month_questions(messages: DataFrame, month: str | None = None, n: int = 5) -> DataFrame:
    rows = newest(user_questions(_months(messages, month)), ["period"], "created", "message_id", n)
    return rows.select(F.col("period").alias("month"), F.substring("content", 1, 150).alias("question"), "created")


def month_sources(messages: DataFrame, month: str | None = None) -> DataFrame:
    return _months(messages, month).groupBy(F.col("period").alias("month"), "source").agg(F.count(F.lit(1)).alias("n"))


def heatmap(messages: DataFrame, as_of=None, days: int = 365, fill: bool = False) -> DataFrame:
    """Messages per day over the last `days`; with `fill`, days without messages count 0."""
    last = F.to_date(_moment(messages, "created", as_of))
    start = F.date_sub(last, days)
    per = (
        messages.where(F.col("created") >= start.cast("timestamp"))
        .groupBy(F.to_date("created").alias("date"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not fill:
        return per
    one = messages.sparkSession.range(1)
    calendar = one.select(F.explode(F.sequence(start, last)).alias("date"))
    return calendar.join(per, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("n"))


def recent_convs(messages: DataFrame, limit: int = 5) -> DataFrame:
    return (
        messages.groupBy("conversation_id")
        .agg(
            F.coalesce(F.max("conversation_title"), F.lit("Untitled")).alias("title"),
            F.max("created").alias("last_date"),
            F.count(F.lit(1)).alias("message_count"),
        )
        .orderBy(F.col("last_date").desc(), "conversation_id")
        .limit(limit)
    )


def source_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("source").agg(
        F.count(F.lit(1)).alias("messages"),
        F.countDistinct("conversation_id").alias("conversations"),
        F.max("created").alias("last_message"),
    )


def source_status(messages: DataFrame, configured: DataFrame | Sequence[tuple[str, str]]) -> DataFrame:
    """Configured sources with their counts, and sources found only in the data.

    `configured` holds (source, path) pairs.
    """
    if not isinstance(configured, DataFrame):
        configured = messages.sparkSession.createDataFrame(list(configured), "source string, path string")
    return (
        configured.select("source", "path", F.lit(True).alias("configured"))
        .join(source_stats(messages), "source", "full")
        .select(
            "source",
            F.coalesce("path", F.lit("(auto-detected from data)")).alias("path"),
            F.coalesce("configured", F.lit(False)).alias("configured"),
            F.coalesce("messages", F.lit(0)).alias("messages"),
            F.coalesce("conversations", F.lit(0)).alias("conversations"),
            "last_message",
        )
    )


def transcripts(
    messages: DataFrame, done: DataFrame | None = None, per_message: int | None = None, cap: int | None = None,
    minimum: int = 100, part_chars: int = 1_000_000,
) -> DataFrame:
    """Ordered transcript of every conversation not yet summarised, whole unless the caller asks for cuts.

    Lines are placed by the number of characters before them, counted in blocks of the conversation, and gathered in
    parts of about `part_chars` characters: a conversation of any length is some rows of bounded size. `per_message` cuts
    each message, `cap` the transcript; the lines behind the cap are counted but not gathered.
    """
    rows = messages
    if done is not None:
        rows = rows.join(done.select("conversation_id").distinct(), "conversation_id", "left_anti")
    content = F.coalesce("content", F.lit(""))
    line = F.concat(F.coalesce("role", F.lit("user")), F.lit(": "), content if per_message is None else F.left(content, F.lit(per_message)))
    rows = rows.withColumn("_line", F.concat(line, F.lit("\n\n"))).withColumn("_block", F.floor(F.col("msg_index") / 1024))
    keys = ["conversation_id"]
    rows = running_total(rows, keys, ["_block"], ["msg_index", "message_id"], F.length("_line"), "_start", {
        "_first": (F.min(F.struct("msg_index", "message_id", "source", "conversation_title")), F.min),
        "msg_count": (F.count(F.lit(1)), F.sum), "_all": (F.sum(F.length("_line")), F.sum),
    })
    rows = rows.withColumn("_chars", F.col("_all") - 2).where(F.col("conversation_id").isNotNull() & (F.col("_chars") >= minimum))
    end = F.col("_chars") if cap is None else F.least("_chars", F.lit(cap))
    shown = rows.where(F.col("_start") < end).select(
        "conversation_id", "_first", "msg_count", F.floor(F.col("_start") / part_chars).alias("part"), "_start",
        F.left("_line", (end - F.col("_start")).cast("int")).alias("_line"),
    )
    return shown.groupBy("conversation_id", "part").agg(
        F.first("_first").alias("_first"), F.first("msg_count").alias("msg_count"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_start", "_line"))), lambda p: p.getField("_line")), "").alias("text"),
    ).select(
        "conversation_id", F.col("_first.source").alias("source"), F.col("_first.conversation_title").alias("title"), "msg_count", "part", "text",
    )


def command_language(messages: DataFrame) -> DataFrame:
    """Command phrases of five classes in the user messages of each conversation."""
    from colloquy.functions.text import phrase_counts

    counts = phrase_counts(F.col("content"))
    return messages.where("role = 'user'").groupBy("conversation_id").agg(
        *[F.sum(c).alias(name) for name, c in counts.items()]
    )
