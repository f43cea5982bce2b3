"""Daily and monthly fact tables built from messages, commits and spend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.matching import tokens
from colloquy.operators.ranking import top_per


# Words too common to name a day's focus.
STOP_WORDS = [
    "about", "after", "also", "been", "before", "could", "from", "have", "here", "into", "just", "like", "more",
    "only", "other", "over", "should", "some", "than", "that", "their", "them", "then", "there", "these", "they",
    "this", "those", "what", "when", "where", "which", "will", "with", "would", "your",
]

# Technology names looked for in messages.
TECHNOLOGIES = [
    "python", "sql", "database", "react", "docker", "postgres", "typescript", "javascript", "rust", "spark",
    "kubernetes", "duckdb", "pandas", "redis", "graphql", "https",
]


def daily_facts(messages: DataFrame, commits: DataFrame, spend: DataFrame) -> DataFrame:
    """One row per day with messages, new conversations, commits, cost and tokens.

    The inputs are reduced to one row per day each, stacked and summed: one small shuffle instead
    of a chain of outer joins.
    """
    zero, nothing = F.lit(0), F.lit(0.0)

    def line(df: DataFrame, **values) -> DataFrame:
        base = {"messages_sent": zero, "convos_started": zero, "commits_made": zero, "cost_total": nothing, "tokens_used": nothing}
        base.update(values)
        types = {"cost_total": "double", "tokens_used": "double"}
        return df.select("date", *[v.cast(types.get(k, "bigint")).alias(k) for k, v in base.items()])

    sent = messages.where("role = 'user'").groupBy(F.to_date("created").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    began = messages.groupBy("conversation_id").agg(F.to_date(F.min("created")).alias("date")).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    made = commits.groupBy(F.to_date("timestamp").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    paid = spend.groupBy("date").agg(F.sum("cost_usd").alias("cost"), F.sum("tokens_total").alias("tokens"))
    rows = (
        line(sent, messages_sent=F.col("n"))
        .unionByName(line(began, convos_started=F.col("n")))
        .unionByName(line(made, commits_made=F.col("n")))
        .unionByName(line(paid, cost_total=F.col("cost"), tokens_used=F.col("tokens")))
    )
    per = rows.groupBy("date").agg(*[F.sum(c).alias(c) for c in rows.columns if c != "date"])
    return per.select(
        "date",
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.month("date").alias("month"),
        F.date_format("date", "EEEE").alias("day_of_week"),
        (F.dayofweek("date").isin(1, 7)).alias("is_weekend"),
        "messages_sent", "convos_started", F.lit(0).cast("bigint").alias("videos_watched"), "commits_made",
        F.round("cost_total", 4).alias("cost_total"),
        F.col("tokens_used").cast("bigint").alias("tokens_used"),
        ((F.col("messages_sent") > 0) | (F.col("commits_made") > 0)).alias("was_active"),
    )


def daily_focus(messages: DataFrame, n: int = 5, min_length: int = 4) -> DataFrame:
    """Most frequent words of each day's user messages; the score is the top word's share."""
    words = (
        messages.where("role = 'user'")
        .select(F.to_date("created").alias("date"), F.explode(tokens(F.col("content"))).alias("word"))
        .where((F.length("word") >= min_length) & ~F.col("word").isin(STOP_WORDS))
        .groupBy("date", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = words.groupBy("date").agg(F.sum("n").alias("total"))
    heads = (
        top_per(words, ["date"], [F.col("n").desc(), F.col("word")], n, "position")
        .groupBy("date")
        .agg(F.sort_array(F.collect_list(F.struct("position", "word", "n"))).alias("_w"))
    )
    return heads.join(totals, "date").select(
        "date",
        F.element_at("_w", 1).getField("word").alias("top_keyword"),
        F.transform("_w", lambda w: w.getField("word")).alias("keywords"),
        F.round(F.element_at("_w", 1).getField("n") / F.col("total"), 6).alias("focus_score"),
    )


def tech_stacks(messages: DataFrame, technologies: Sequence[str] = tuple(TECHNOLOGIES)) -> DataFrame:
    """Technologies named each month: how many, the dominant one, and what came and went since the month before."""
    known = F.array(*[F.lit(t) for t in technologies])
    used = (
        messages.select(
            F.trunc(F.to_date("created"), "month").alias("month_start"),
            F.explode(F.array_intersect(tokens(F.col("content")), known)).alias("tech"),
        )
        .groupBy("month_start", "tech")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    months = used.groupBy("month_start").agg(
        F.count(F.lit(1)).alias("stack_count"),
        F.min(F.struct((-F.col("n")).alias("k"), F.col("tech"))).getField("tech").alias("dominant_stack"),
        F.array_sort(F.collect_set("tech")).alias("all_techs"),
    )
    before = F.coalesce(F.lag("all_techs").over(Window.orderBy("month_start")), F.array().cast("array<string>"))
    return months.withColumn("_before", before).select(
        "month_start", "stack_count", "dominant_stack",
        F.array_except("all_techs", "_before").alias("new_adoptions"),
        F.array_except("_before", "all_techs").alias("abandonments"),
        "all_techs",
    )


def problems(monthly: DataFrame, month: str | None = None, limit: int = 12) -> DataFrame:
    """Browse the monthly problem table, newest first."""
    rows = monthly if month is None else monthly.where(F.date_format("month_start", "yyyy-MM").startswith(month))
    return rows.orderBy(F.col("month_start").desc()).limit(limit).select(
        "month_start", "chain_count", "domains", "difficulties", "debugging_patterns", "hardest_problem", "aha_quotes"
    )


def spend_daily(spend: DataFrame, month: str | None = None, source: str | None = None) -> DataFrame:
    rows = spend
    if month:
        start = F.to_date(F.lit(f"{month}-01"))
        rows = rows.where((F.col("date") >= start) & (F.col("date") < F.add_months(start, 1)))
    if source:
        rows = rows.where(F.col("source") == source)
    return rows.groupBy("date", "source").agg(
        F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.sum("tokens_total").cast("bigint").alias("tokens_total")
    )


def spend_monthly(spend: DataFrame, source: str | None = None) -> DataFrame:
    """Cost and tokens per month and source with a total per month and over all ('(all)')."""
    rows = spend if source is None else spend.where(F.col("source") == source)
    rows = rows.select(F.date_format("date", "yyyy-MM").alias("month"), "source", "cost_usd", "tokens_total")
    return rows.rollup("month", "source").agg(
        F.grouping("month").alias("_m"), F.grouping("source").alias("_s"),
        F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.sum("tokens_total").cast("bigint").alias("tokens_total"),
    ).select(
        F.when(F.col("_m") == 1, "(all)").otherwise(F.col("month")).alias("month"),
        F.when(F.col("_s") == 1, "(all)").otherwise(F.col("source")).alias("source"),
        "cost_usd", "tokens_total",
    )
