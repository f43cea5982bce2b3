"""Domain answers from the messages alone, for archives without summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.domain_state import band
from colloquy.operators.matching import match_terms
from colloquy.operators.ranking import top_per
from colloquy.operators.search import Terms, domain_search, first_keyword_hits, keyword_hits, user_questions


def asked_by_user() -> Column:
    return (F.col("role") == "user") & (F.col("has_question") == 1)


def _titles(rows: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The first n distinct titles per key, in order of position."""
    first = (
        rows.where("conversation_title <> ''")
        .groupBy(*keys, "conversation_title")
        .agg(F.min("position").alias("position"))
    )
    return (
        top_per(first, keys, [F.col("position"), F.col("conversation_title")], n)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("position", "conversation_title"))).alias("_t"))
        .select(*keys, F.transform("_t", lambda t: t.getField("conversation_title")).alias("titles"))
    )


def domain_state_raw(messages: DataFrame, domains: Sequence[str], limit: int = 10) -> DataFrame:
    """All matching messages and questions of each domain, counted, and recent titles."""
    rows = domain_search(messages, domains, limit)
    hits = keyword_hits(messages.where("role = 'user'"), domains)
    named = hits.where("rank = 0").select("domain").distinct()
    every = hits.where("rank = 0").unionByName(hits.where("rank > 0").join(named, "domain", "left_anti"))
    facts = every.dropDuplicates(["domain", "message_id"]).groupBy("domain").agg(
        F.count(F.lit(1)).alias("matches"),
        F.count_if(F.col("content").contains("?")).alias("questions"),
        F.countDistinct(F.when(F.col("conversation_title") != "", F.col("conversation_title"))).alias("conversations"),
    )
    return facts.join(_titles(rows, ["domain"]), "domain", "left")


def dormant_raw(messages: DataFrame, limit: int = 20) -> DataFrame:
    """Titles with user questions, the longest silent first."""
    return (
        messages.groupBy("conversation_title")
        .agg(F.max("created").alias("last_active"), F.count(F.lit(1)).alias("msgs"), F.count_if(asked_by_user()).alias("questions"))
        .where((F.col("questions") > 0) & (F.col("conversation_title") != ""))
        .orderBy("last_active", "conversation_title")
        .limit(limit)
    )


def _brief_rows(messages: DataFrame, domains: Sequence[str], n: int) -> DataFrame:
    hits = first_keyword_hits(keyword_hits(messages, domains))
    return top_per(hits, ["domain"], [F.col("created").desc(), F.col("message_id").desc()], n * 10, "position")


def domain_brief_raw(messages: DataFrame, domains: Sequence[str], n: int = 5) -> DataFrame:
    """Matches and user questions of each domain's first useful keyword, all counted, and recent titles."""
    rows = _brief_rows(messages, domains, n)
    facts = first_keyword_hits(keyword_hits(messages, domains)).groupBy("domain", "keyword").agg(
        F.count(F.lit(1)).alias("matches"),
        F.countDistinct(F.when(F.col("conversation_title") != "", F.col("conversation_title"))).alias("conversations"),
        F.count_if((F.col("role") == "user") & F.col("content").contains("?")).alias("questions"),
    )
    return facts.join(_titles(rows, ["domain"]), "domain", "left")


def domain_brief_raw_items(messages: DataFrame, domains: Sequence[str], n: int = 5) -> DataFrame:
    return _brief_rows(messages, domains, n).where(F.col("position") <= 2 * n).select(
        "domain", "position", "conversation_title", "source", "role", F.substring("content", 1, 300).alias("preview")
    )


def domain_history_raw(messages: DataFrame, domains: Sequence[str]) -> DataFrame:
    hits = first_keyword_hits(keyword_hits(messages, domains))
    return hits.groupBy("domain", "keyword", "year", "month", "source").agg(
        F.count(F.lit(1)).alias("msgs"), F.count_if(asked_by_user()).alias("questions")
    )


def switch_cost_raw(messages: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Cost estimate for (current, target) pairs of search terms from message counts."""
    spark = messages.sparkSession
    names = list(dict.fromkeys(name for pair in pairs for name in pair))
    hits = match_terms(messages, ["content", "conversation_title"], names, "name", key="message_id")
    facts = hits.groupBy("name").agg(
        F.count(F.lit(1)).alias("msgs"), F.count_if(asked_by_user()).alias("questions"), F.max("created").alias("last_active")
    )
    titles = hits.where("conversation_title IS NOT NULL").select("name", "conversation_title").distinct()
    asked = spark.createDataFrame([tuple(p) for p in pairs], "current string, target string").distinct()
    cur = titles.withColumnRenamed("name", "current")
    tgt = titles.withColumnRenamed("name", "target")
    shared = (
        asked.join(cur, "current")
        .join(tgt, ["target", "conversation_title"], "left_semi")
        .groupBy("current", "target")
        .agg(F.count(F.lit(1)).alias("shared_titles"))
    )
    rows = (
        asked.join(facts.select(F.col("name").alias("current"), "msgs", "questions", "last_active"), "current")
        .join(facts.select(F.col("name").alias("target"), F.col("msgs").alias("target_msgs")), "target")
        .join(shared, ["current", "target"], "left")
        .na.fill(0, ["shared_titles"])
    )
    question_cost = F.least(F.col("questions") / 10.0, F.lit(1.0))
    volume_cost = F.least(F.col("msgs") / 100.0, F.lit(0.5))
    discount = F.least(F.col("shared_titles") / F.greatest(F.col("msgs") / 10.0, F.lit(1.0)), F.lit(1.0))
    raw = F.round(question_cost * 0.4 + volume_cost * 0.3 - discount * 0.3, 3)
    return rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).select(
        "current", "target", "msgs", "questions", "last_active", "target_msgs", "shared_titles", "score",
        band("score").alias("band"),
    )


def activity_raw(messages: DataFrame, domains: Sequence[str] | None = None, months: int = 5) -> DataFrame:
    """Totals, busiest months and sources: (scope, section, name, value), for all messages or per domain."""
    if domains is None:
        rows = messages.withColumn("scope", F.lit("(all)"))
    else:
        rows = first_keyword_hits(keyword_hits(messages, domains)).withColumnRenamed("domain", "scope")
    one = rows.groupBy("scope").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(asked_by_user()).alias("questions"),
        F.countDistinct("source").alias("sources"),
        F.countDistinct("conversation_title").alias("conversations"),
    )
    totals = one.select(
        "scope",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in one.columns if c != "scope"])
        ).alias("t"),
    ).select("scope", F.lit("total").alias("section"), "t.name", "t.value")
    by_month = rows.groupBy("scope", F.date_format("created", "yyyy-MM").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    busiest = top_per(by_month, ["scope"], [F.col("value").desc(), F.col("name")], months)
    by_source = rows.groupBy("scope", F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return (
        totals.unionByName(busiest.select("scope", F.lit("month").alias("section"), "name", "value"))
        .unionByName(by_source.select("scope", F.lit("source").alias("section"), "name", "value"))
    )


def open_threads_raw(messages: DataFrame, per_topic: int = 5, topics: int = 20) -> DataFrame:
    """All user questions grouped by title, newest title first; the newest of each title are shown."""
    rows = user_questions(messages).withColumn("title", F.coalesce("conversation_title", F.lit("Untitled")))
    per = rows.groupBy("title").agg(
        F.count(F.lit(1)).alias("questions"), F.max(F.struct("created", "message_id")).alias("_last")
    ).orderBy(F.col("_last").desc()).limit(topics)
    shown = top_per(rows, ["title"], [F.col("created").desc(), F.col("message_id").desc()], per_topic, "position")
    return shown.join(per, "title").select(
        "title", "questions", "position", F.substring("content", 1, 200).alias("question"), "created"
    )


def coverage_raw(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """What the archive preserves when there are no summaries."""
    n_vectors = vectors.agg(F.count(F.lit(1))).scalar()
    return messages.agg(
        F.count(F.lit(1)).alias("messages"),
        F.countDistinct("conversation_title").alias("conversations"),
        F.countDistinct("source").alias("sources"),
        F.min("created").alias("first_msg"),
        F.max("created").alias("last_msg"),
        F.count_if(asked_by_user()).alias("questions"),
    ).withColumn("vectors", n_vectors).withColumn(
        "vector_status", F.when(F.col("vectors") > 0, "good").otherwise("missing")
    )


def position_raw(
    messages: DataFrame, topics: Terms, semantic: DataFrame | None = None, limit: int = 10
) -> DataFrame:
    """Direct mentions of each topic, one per conversation, plus semantic hits when given.

    `semantic` has (topic, rank, conversation_title, content, similarity).
    """
    hits = match_terms(messages.where("role = 'user'"), ["content"], topics, key="message_id")
    order = [F.col("created").desc(), F.col("message_id").desc()]
    single = top_per(top_per(hits, ["topic", "conversation_id"], order, 1), ["topic"], order, limit)
    direct = single.select(
        "topic", F.lit("mention").alias("kind"), "conversation_title",
        F.substring("content", 1, 300).alias("preview"), F.col("created").cast("string").alias("at"),
        F.lit(None).cast("double").alias("similarity"),
    )
    if semantic is None:
        return direct
    return direct.unionByName(
        semantic.where(F.col("rank") <= limit).select(
            "topic", F.lit("semantic").alias("kind"), "conversation_title",
            F.substring("content", 1, 250).alias("preview"), F.lit(None).cast("string").alias("at"), "similarity",
        )
    )
