"""Links between conversations, repositories, principles and the citation layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.matching import match_names, match_terms
from colloquy.operators.ranking import newest, top_per
from colloquy.operators.search import Terms



def project_mentions(messages: DataFrame, repos: DataFrame, projects: Terms, limit: int = 10) -> DataFrame:
    """Newest user messages about each project, marked when older than its repository."""
    matched = match_terms(repos, ["repo_name"], projects, "project", key="repo_name")
    created = matched.groupBy("project").agg(F.min_by("created_at", "repo_name").alias("project_created"))
    rows = match_terms(messages.where("role = 'user'"), ["content", "conversation_title"], projects, "project", key="message_id")
    rows = newest(rows, ["project"], "created", "message_id", limit)
    return rows.join(created, "project", "left").select(
        "project", "conversation_title", F.substring("content", 1, 250).alias("preview"), "created",
        "conversation_id", "project_created",
        F.coalesce(F.col("created") < F.col("project_created"), F.lit(False)).alias("predates_project"),
    )


def date_validity(messages: DataFrame, repos: DataFrame) -> DataFrame:
    """Verdict on every conversation's date from the repositories its user messages name."""
    facts = messages.groupBy("conversation_id").agg(
        F.max("conversation_title").alias("conversation_title"),
        F.min("created").alias("first_msg"),
        F.count(F.lit(1)).alias("msg_count"),
        F.max("timestamp_is_fallback").alias("has_fallback"),
    )
    user = messages.where("role = 'user'").select("message_id", "conversation_id", "content")
    named = match_names(user, "content", repos.select("repo_name", "created_at"), "repo_name", "message_id")
    pairs = named.select("conversation_id", "repo_name", "created_at").distinct()
    judged = pairs.join(facts.select("conversation_id", "first_msg"), "conversation_id").withColumn(
        "_conflict", F.col("first_msg") < F.col("created_at")
    )
    per = judged.groupBy("conversation_id").agg(
        F.count_if("_conflict").alias("conflicts"),
        F.count_if(~F.col("_conflict")).alias("valid_references"),
        F.max(F.when(F.col("_conflict"), F.to_date("created_at"))).alias("earliest_valid_date"),
        F.max(
            F.when(F.col("_conflict"), F.floor((F.unix_timestamp("created_at") - F.unix_timestamp("first_msg")) / 86400))
        ).alias("max_days_before"),
    )
    verdict = (
        F.when(F.col("conflicts") > 0, "likely incorrect")
        .when(F.col("has_fallback") == 1, "uncertain")
        .otherwise("likely valid")
    )
    return (
        facts.join(per, "conversation_id", "left")
        .na.fill(0, ["conflicts", "valid_references"])
        .withColumn("verdict", verdict)
    )


def _matched_repos(repos: DataFrame, projects: Terms | None, per_project: int) -> DataFrame:
    if projects is None:
        return repos.withColumn("project", F.col("repo_name"))
    rows = match_terms(repos, ["repo_name"], projects, "project", key="repo_name")
    return top_per(rows, ["project"], [F.col("created_at").desc(), F.col("repo_name")], per_project)


def repo_timeline(
    repos: DataFrame, commits: DataFrame, projects: Terms | None = None, per_project: int = 5, last: int = 10
) -> DataFrame:
    """Matching repositories with their newest commits (one row per commit, or one without)."""
    chosen = _matched_repos(repos, projects, per_project)
    order = [F.col("timestamp").desc(), F.col("commit_id").desc()]
    newest_commits = top_per(commits, ["repo_name"], order, last, "commit_position").select(
        "repo_name", "commit_position", "timestamp", F.substring_index("message", "\n", 1).alias("_m"), "author"
    )
    return chosen.join(newest_commits, "repo_name", "left").select(
        "project", "repo_name", "created_at", "pushed_at", F.left("description", F.lit(100)).alias("description"),
        "language", "is_private", "stars", "url", "commit_position",
        F.col("timestamp").alias("committed_at"), F.left("_m", F.lit(60)).alias("message"), "author",
    )


def repo_activity(
    repos: DataFrame, commits: DataFrame, projects: Terms | None = None, per_project: int = 5, months: int = 6
) -> DataFrame:
    """Commits per month of the matching repositories, the last active months only."""
    chosen = _matched_repos(repos, projects, per_project).select("project", "repo_name")
    per = commits.groupBy("repo_name", F.date_format("timestamp", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("commits"))
    return top_per(per, ["repo_name"], [F.col("month").desc()], months).join(chosen, "repo_name")


def repo_stats(repos: DataFrame, commits: DataFrame) -> DataFrame:
    """Repository and commit totals in one row."""
    by_commit = commits.agg(
        F.count(F.lit(1)).alias("commits"), F.countDistinct("repo_name").alias("repos_with_commits"),
        F.min("timestamp").alias("first_commit"), F.max("timestamp").alias("last_commit"),
    )
    return repos.agg(
        F.count(F.lit(1)).alias("repos"),
        F.count_if("is_private").alias("private"),
        F.count_if(~F.col("is_private")).alias("public"),
        F.min("created_at").alias("first_created"),
        F.max("pushed_at").alias("last_pushed"),
    ).select("*", *[by_commit.select(c).scalar().alias(c) for c in by_commit.columns])


def repo_languages(repos: DataFrame, n: int = 10) -> DataFrame:
    return (
        repos.where("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "language").limit(n)
    )


def citation_ids(citations: Column, kind: str) -> Column:
    """Ids of one kind from citation JSON text such as {"l1_ids": [1, 2]}."""
    return F.coalesce(
        F.from_json(citations, "l0_ids array<bigint>, l1_ids array<bigint>, l2_ids array<bigint>").getField(kind),
        F.array().cast("array<bigint>"),
    )


def citation_chain(l3: DataFrame, l2: DataFrame, l1: DataFrame, l0: DataFrame, l3_ids: Sequence[int] | None = None) -> DataFrame:
    """Every row that each fusion rests on, down to the source messages: one row per path step.

    Syntheses that cite messages directly are followed as well as those that cite extractions.
    """
    top = l3 if l3_ids is None else l3.where(F.col("id").isin(list(l3_ids)))
    start = top.select(
        F.col("id").alias("l3_id"), F.lit("L3").alias("layer"), F.col("id").alias("row_id"),
        F.lit(None).cast("string").alias("preview"), F.col("fused_at").alias("at"),
    )
    to_l2 = top.select(F.col("id").alias("l3_id"), F.explode(F.array_distinct(citation_ids(F.col("citations"), "l2_ids"))).alias("id"))
    at_l2 = to_l2.join(l2, "id")
    second = at_l2.select(
        "l3_id", F.lit("L2").alias("layer"), F.col("id").alias("row_id"),
        F.left("summary", F.lit(200)).alias("preview"), F.col("synthesized_at").alias("at"),
    )
    to_l1 = at_l2.select("l3_id", F.explode(F.array_distinct(citation_ids(F.col("citations"), "l1_ids"))).alias("id"))
    at_l1 = to_l1.join(l1, "id")
    third = at_l1.select(
        "l3_id", F.lit("L1").alias("layer"), F.col("id").alias("row_id"),
        F.lit(None).cast("string").alias("preview"), F.col("extracted_at").alias("at"),
    )
    direct = at_l2.select("l3_id", F.explode(F.array_distinct(citation_ids(F.col("citations"), "l0_ids"))).alias("id"))
    at_l0 = at_l1.select("l3_id", F.col("l0_id").alias("id")).unionByName(direct).join(l0, "id")
    fourth = at_l0.select(
        "l3_id", F.lit("L0").alias("layer"), F.col("id").alias("row_id"),
        F.left("content", F.lit(200)).alias("preview"), F.col("msg_timestamp").alias("at"),
    )
    return start.unionByName(second).unionByName(third).unionByName(fourth)


def alignment(decisions: DataFrame, principles: DataFrame, n: int = 3) -> DataFrame:
    """First n principles that share a word of more than four letters with each decision.

    decisions(decision_id, decision), principles(position, name, definition, description, formula).
    A word counts when it occurs anywhere in a principle, so words are matched as substrings, each
    distinct word once however many decisions use it. A word keeps its first n principles: no
    decision can need more of them.
    """
    words = decisions.select(
        "decision_id", F.explode(F.array_distinct(F.split(F.lower("decision"), r"\s+"))).alias("word")
    ).where(F.length("word") > 4)
    text = F.concat_ws(" ", "name", "definition", "description")
    targets = principles.select("position", text.alias("_text"))
    found = match_terms(targets, ["_text"], words.select("word").distinct(), "word", key="position").drop("_text")
    first = top_per(found, ["word"], [F.col("position")], n)
    pairs = words.join(first, "word").select("decision_id", "position").distinct()
    ranked = top_per(pairs, ["decision_id"], [F.col("position")], n, "rank")
    return ranked.join(principles, "position").select(
        "decision_id", "rank", "name", F.left("definition", F.lit(200)).alias("definition"), "formula"
    )
