"""Keyword search and listing operators over turns and messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import domains as dom
from colloquy.functions import text as tx
from colloquy.operators.matching import match_terms
from colloquy.operators.ranking import newest, top_per
from colloquy.session import listed_rows

Terms = Sequence[str] | DataFrame

# Wording that marks unfinished work.
OPEN_TOKENS = ["todo", "next step", "waiting on", "blocked", "follow up", "still need"]


def _only(df: DataFrame, **equal: str | None) -> DataFrame:
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def latest(df: DataFrame, ts: str) -> Column:
    """Newest timestamp of the table as a scalar, the default for `as_of`."""
    return df.agg(F.max(ts)).scalar()


def _moment(df: DataFrame, ts: str, as_of) -> Column:
    return latest(df, ts) if as_of is None else F.lit(as_of).cast("timestamp")


def kw_search(
    turns: DataFrame, topics: Terms, src: str | None = None, role: str | None = None,
    limit: int = 12, wildcards: bool = False,
) -> DataFrame:
    """Newest turns that contain each topic, text cut at 600 characters."""
    rows = match_terms(_only(turns, src=src, role=role), ["text"], topics, wildcards=wildcards, key="message_id")
    return newest(rows, ["topic"], "ts", "message_id", limit).select(
        "topic", "ts", "src", "conv_id", "role", tx.preview(F.col("text"), 600).alias("text")
    )


def recent(
    turns: DataFrame, as_of=None, hours: int = 24, src: str | None = None, role: str | None = None, limit: int = 20
) -> DataFrame:
    start = _moment(turns, "ts", as_of) - F.make_interval(hours=F.lit(hours))
    rows = _only(turns, src=src, role=role).where(F.col("ts") >= start)
    return newest(rows, [], "ts", "message_id", limit).select(
        "ts", "src", "conv_id", "role", tx.preview(F.col("text"), 400).alias("text")
    )


def kw_search_role(messages: DataFrame, terms: Terms, role: str | None = None, limit: int = 15) -> DataFrame:
    rows = match_terms(_only(messages, role=role), ["content"], terms, key="message_id")
    return newest(rows, ["topic"], "created", "message_id", limit).select(
        "topic", "source", "model", "conversation_title", "created", "role",
        F.substring("content", 1, 200).alias("preview"), "conversation_id",
    )


def user_questions(messages: DataFrame) -> DataFrame:
    return messages.where("role = 'user' AND has_question = 1")


def recent_questions(messages: DataFrame, limit: int = 15) -> DataFrame:
    return newest(user_questions(messages), [], "created", "message_id", limit).select(
        "source", "conversation_title", "created", F.substring("content", 1, 300).alias("question"), "conversation_id"
    )


def kw_facets(
    messages: DataFrame, topics: Terms, source: str | None = None, role: str | None = None,
    date_from: str | None = None, date_to: str | None = None, limit: int = 20, offset: int = 0,
) -> DataFrame:
    """Faceted keyword search with paging, newest first."""
    rows = _only(messages, source=source, role=role)
    if date_from:
        rows = rows.where(F.col("created") >= F.to_timestamp(F.lit(date_from)))
    if date_to:
        rows = rows.where(F.col("created") < F.to_timestamp(F.date_add(F.lit(date_to).cast("date"), 1)))
    rows = match_terms(rows, ["content"], topics, key="message_id")
    order = [F.col("created").desc(), F.col("message_id").desc()]
    page = top_per(rows, ["topic"], order, limit + offset, "position").where(F.col("position") > offset)
    return page.select(
        "topic", "position", "source", "conversation_id", "conversation_title",
        tx.truncate_words(F.col("content"), 250).alias("content_preview"), "role", "created",
    )


def facets(messages: DataFrame) -> DataFrame:
    return messages.select("source").distinct()


def get_conversation(messages: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Every message of the given conversations, in order of position."""
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias("conversation_id")).distinct()
        rows = messages.join(wanted, "conversation_id", "left_semi")
    else:
        rows = messages.where(F.col("conversation_id").isin(list(ids)))
    return rows.select(
        "conversation_id", "msg_index", "role", "content", "created", "conversation_title", "source", "model"
    ).orderBy("conversation_id", "msg_index")


def open_turns(turns: DataFrame, as_of=None, days: int = 14, limit: int = 15) -> DataFrame:
    """User turns of the last days that ask something or name unfinished work."""
    start = _moment(turns, "ts", as_of) - F.make_interval(days=F.lit(days))
    low = F.lower("text")
    open_text = tx.contains_any(low, OPEN_TOKENS) | tx.strip(F.col("text")).endswith("?")
    rows = turns.where((F.col("role") == "user") & (F.col("ts") >= start) & open_text)
    return newest(rows, [], "ts", "message_id", limit).select("ts", "src", "conv_id", "role", "text")


def dropped(turns_dropped: DataFrame, reason: str | None = None, limit: int = 12) -> DataFrame:
    """Newest dropped turns with their reason; turns_dropped has the turn columns and drop_reason."""
    return newest(_only(turns_dropped, drop_reason=reason), [], "ts", "message_id", limit).select(
        "ts", "src", "conv_id", "drop_reason", tx.preview(F.col("text"), 400).alias("text")
    )


def sample_messages(messages: DataFrame, n: int = 3) -> DataFrame:
    rows = messages.where((F.col("role") == "user") & (F.length("content") > 20))
    return newest(rows, [], "created", "message_id", n).select(
        F.substring("content", 1, 120).alias("preview"), "conversation_title", "source"
    )


def positions(turns: DataFrame, topics: Terms, limit: int = 10) -> DataFrame:
    """The user's own statements per topic, one per 200-character opening, newest first."""
    rows = match_terms(turns.where("role = 'user'"), ["text"], topics, key="message_id")
    rows = rows.withColumn("_opening", F.substring("text", 1, 200))
    order = [F.col("ts").desc(), F.col("message_id").desc()]
    single = top_per(rows, ["topic", "_opening"], order, 1)
    return top_per(single, ["topic"], order, limit).select("topic", "ts", "src", "conv_id", "role", "text")


def trajectory(turns: DataFrame, topics: Terms, limit: int = 12) -> DataFrame:
    """Oldest user turns per topic."""
    rows = match_terms(turns.where("role = 'user'"), ["text"], topics, key="message_id")
    return top_per(rows, ["topic"], [F.col("ts"), F.col("message_id")], limit).select(
        "topic", "ts", "src", "conv_id", "role", "text"
    )


def tunnel_recent(turns: DataFrame, topics: Terms, convs: int = 5, limit: int = 15) -> DataFrame:
    """Newest hits of each topic inside its most recently active conversations."""
    hits = match_terms(turns, ["text"], topics, key="message_id")
    active = hits.groupBy("topic", "conv_id", "src").agg(F.max("ts").alias("last_ts"))
    top = top_per(active, ["topic"], [F.col("last_ts").desc(), F.col("conv_id"), F.col("src")], convs)
    rows = hits.join(top.select("topic", "conv_id", "src"), ["topic", "conv_id", "src"], "left_semi")
    return newest(rows, ["topic"], "ts", "message_id", limit).select(
        "topic", "ts", "src", "conv_id", "role", tx.preview(F.col("text"), 300).alias("text")
    )


def keyword_hits(messages: DataFrame, domain_names: Sequence[str]) -> DataFrame:
    """Messages whose text or title holds a keyword of a domain: (domain, keyword, rank, message...)."""
    spark = messages.sparkSession
    listed = dom.keyword_rows(list(domain_names))
    table = listed_rows(spark, listed, "domain string, keyword string, rank int")
    keywords = [k for _, k, _ in listed]
    rows = match_terms(messages, ["content", "conversation_title"], keywords, "keyword", key="message_id")
    # The keyword table is made of the caller's own list, so its size is known here.
    return rows.join(F.broadcast(table), "keyword")


def first_keyword_hits(hits: DataFrame) -> DataFrame:
    """Only the hits of each domain's first keyword that found anything."""
    first = hits.groupBy("domain").agg(F.min("rank").alias("rank"))
    return hits.join(first, ["domain", "rank"], "left_semi")


def domain_search(messages: DataFrame, domain_names: Sequence[str], limit: int = 10) -> DataFrame:
    """User messages about each domain.

    If the domain's own name is found: its newest 3·limit messages. Otherwise the newest `limit`
    of every keyword, one per 100-character opening in keyword order, at most 3·limit.
    """
    hits = keyword_hits(messages.where("role = 'user'"), domain_names)
    order = [F.col("created").desc(), F.col("message_id").desc()]
    exact = top_per(hits.where("rank = 0"), ["domain"], order, 3 * limit, "position")
    found = hits.where("rank = 0").select("domain").distinct()
    others = hits.where("rank > 0").join(found, "domain", "left_anti")
    picked = top_per(others, ["domain", "keyword"], order, limit)
    picked = picked.withColumn("_opening", F.substring("content", 1, 100))
    in_order = [F.col("rank"), *order]
    picked = top_per(picked, ["domain", "_opening"], in_order, 1)
    expanded = top_per(picked, ["domain"], in_order, 3 * limit, "position")
    columns = ["domain", "keyword", "position", "conversation_title", "content", "created", "source", "message_id"]
    return exact.select(columns).unionByName(expanded.select(columns))


def visible_rows(rows: DataFrame, members: DataFrame, user_id: str, public: bool = True) -> DataFrame:
    """Rows the user owns, rows shared with one of their tenants and, if `public`, public rows."""
    mine = (
        members.where(F.col("user_id") == user_id).select("tenant_id").distinct().withColumn("_member", F.lit(True))
    )
    seen = (F.col("owner_user_id") == user_id) | (
        (F.col("visibility") == "tenant") & F.coalesce("_member", F.lit(False))
    )
    if public:
        seen = seen | (F.col("visibility") == "public")
    return rows.join(mine, "tenant_id", "left").where(seen).drop("_member")
