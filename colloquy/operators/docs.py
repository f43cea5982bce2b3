"""Listings and totals of markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.matching import match_terms
from colloquy.operators.ranking import top_per
from colloquy.operators.search import Terms


def deepest_first() -> list[Column]:
    return [F.col("depth_score").desc(), F.col("harvest_score").desc(), F.col("filename")]


def docs_search(docs: DataFrame, topics: Terms, limit: int = 15) -> DataFrame:
    """Documents whose content, title or file name holds each topic, the deepest first."""
    rows = match_terms(docs, ["content", "title", "filename"], topics, key="filename")
    return top_per(rows, ["topic"], deepest_first(), limit, "position").select(
        "topic", "position", "filename", "project", "voice", "energy", "depth_score", "harvest_score",
        "decision_count", "word_count", F.left("first_line", F.lit(100)).alias("first_line"),
    )


def docs_breakthrough(docs: DataFrame, limit: int = 20) -> DataFrame:
    return docs.where("energy = 'BREAKTHROUGH'").orderBy(*deepest_first()).limit(limit).select(
        "filename", "project", "depth_score", "harvest_score", "decision_count", "word_count",
        F.left("first_line", F.lit(120)).alias("first_line"),
    )


def docs_deep(docs: DataFrame, min_depth: int = 70, limit: int = 20) -> DataFrame:
    rows = docs.where(F.col("depth_score") >= min_depth)
    return rows.orderBy(F.col("depth_score").desc(), "filename").limit(limit).select(
        "filename", "project", "voice", "energy", "depth_score", "harvest_score", "decision_count", "seed_concepts",
        "word_count",
    )


def docs_project(docs: DataFrame, project: str, limit: int = 20) -> DataFrame:
    rows = docs.where(F.col("project") == project.lower())
    return rows.orderBy(F.col("depth_score").desc(), "filename").limit(limit).select(
        "filename", "voice", "energy", "depth_score", "harvest_score", "decision_count", "todos_open", "word_count",
        F.left("first_line", F.lit(100)).alias("first_line"),
    )


def docs_todos(docs: DataFrame, project: str | None = None, limit: int = 20) -> DataFrame:
    """Documents with open items (any in one project, more than five overall) and their progress."""
    if project:
        rows = docs.where((F.col("project") == project.lower()) & (F.col("todos_open") > 0))
    else:
        rows = docs.where(F.col("todos_open") > 5)
    total = F.col("todos_open") + F.col("todos_done")
    done = F.when(total > 0, F.bround(F.lit(100.0) * F.col("todos_done") / total)).otherwise(F.lit(0.0))
    return rows.orderBy(F.col("todos_open").desc(), "filename").limit(limit).select(
        "filename", "project", "todos_open", "todos_done", done.cast("long").alias("pct_done"), "draft_status", "depth_score"
    )


def docs_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.col("word_count").cast("long")).alias("words"),
        F.count_if(F.col("voice") == "FIRST_PERSON").alias("first_person"),
        F.count_if(F.col("energy") == "BREAKTHROUGH").alias("breakthrough"),
        F.count_if(F.col("depth_score") >= 70).alias("deep"),
        F.sum(F.col("decision_count").cast("long")).alias("decisions"),
        F.sum(F.col("todos_open").cast("long")).alias("todos_open"),
    )
