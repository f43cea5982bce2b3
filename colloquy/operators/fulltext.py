"""Full-text and hybrid ranking, unified search and extraction from ranked summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import schema
from colloquy.functions.jsonlist import real_item, real_items
from colloquy.functions.text import cite, preview
from colloquy.operators.domain_state import importance_rank
from colloquy.operators.matching import match_terms, tokens
from colloquy.operators.ranking import top_per
from colloquy.session import listed_rows, shared_folder

K1, B, RRF = 1.2, 0.75, 60

Queries = Sequence[tuple[str, str]] | DataFrame


def query_frame(df: DataFrame, queries: Queries) -> DataFrame:
    """(query_id, query) rows from a list or a DataFrame."""
    if isinstance(queries, DataFrame):
        return queries.select("query_id", "query")
    return listed_rows(df.sparkSession, list(queries), "query_id string, query string")


def bm25(docs: DataFrame, queries: Queries, k: int = 10, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Best k documents per query by BM25: (query_id, rank, id, score). Rows that share an id are one document.

    A list of queries is matched while the texts are read, once: lengths and matched terms, a small table, go to the shared
    folder (this runs a job), and statistics and scores come from there. A table of queries is joined.
    """
    asked = query_frame(docs, queries).select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if isinstance(queries, DataFrame):
        scored = _bm25_joined(rows, asked)
    else:
        pairs = [(r["query_id"], r["term"]) for r in asked.collect()]
        scored = _bm25_listed(rows, pairs) if pairs else _bm25_joined(rows, asked)
    scored = scored.withColumn("score", F.round("score", 9))
    return top_per(scored, ["query_id"], [F.col("score").desc(), F.col("id")], k, "rank").select(
        "query_id", "rank", "id", "score"
    )


def _weight(idf: Column, tf: Column, length: Column, mean: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))


def _bm25_listed(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Scores of listed terms from each document's length and the listed words it holds."""
    terms = sorted({t for _, t in pairs})
    low = F.lower("text")
    words = F.regexp_count(low, F.lit(r"(?U)\w+"))
    hits = F.regexp_extract_all(low, F.lit(r"(?U)\b(" + "|".join(sorted(terms, key=len, reverse=True)) + r")\b"), F.lit(1))
    path = shared_folder(rows.sparkSession, "bm25")
    rows.select("id", F.coalesce(words, F.lit(0)).alias("dl"), hits.alias("hits")).write.parquet(path)
    known = rows.sparkSession.read.parquet(path).groupBy("id").agg(F.sum("dl").alias("dl"), F.flatten(F.collect_list("hits")).alias("hits"))
    totals = known.agg(
        F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"),
        F.array(*[F.count_if(F.array_contains("hits", t)) for t in terms]).alias("df"),
    ).first()
    idf = {t: math.log(1 + (totals["n"] - df + 0.5) / (df + 0.5)) for t, df in zip(terms, totals["df"])}

    def part(term: str) -> Column:
        tf = F.size(F.filter("hits", lambda w: w == term)).cast("double")
        return _weight(F.lit(idf[term]), tf, F.col("dl"), F.lit(totals["mean"]))

    parts = known.where(F.size("hits") > 0).select("id", *[part(t).alias(f"_p{i}") for i, t in enumerate(terms)])
    by_query: dict[str, Column] = {}
    for query_id, term in pairs:
        own = F.col(f"_p{terms.index(term)}")
        by_query[query_id] = by_query[query_id] + own if query_id in by_query else own
    found = F.array(*[F.struct(F.lit(q).alias("query_id"), total.alias("score")) for q, total in by_query.items()])
    return parts.select("id", F.explode(found).alias("r")).select("r.query_id", "id", "r.score").where("score > 0")


def _bm25_joined(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Scores by joining tokens with a table of query terms of any size."""
    terms = asked.select("term").distinct()
    words = rows.select("id", tokens(F.col("text")).alias("_w"))
    lengths = words.groupBy("id").agg(F.coalesce(F.sum(F.size("_w")), F.lit(0)).alias("dl"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"))
    n_docs, mean = totals.select("n").scalar(), totals.select("avg").scalar()
    # Equal tokens of a text merge before the join, so a frequent word moves once per text.
    postings = (
        words.select("id", F.explode("_w").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
        .join(terms, "term", "left_semi").join(lengths, "id")
    )
    idf = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", _idf(n_docs, F.col("df")).alias("idf"))
    weights = asked.join(idf, "term")
    part = _weight(F.col("idf"), F.col("tf").cast("double"), F.col("dl"), mean)
    return postings.join(weights, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of two rankings over the same ids."""
    a = text_hits.select("query_id", "id", F.col("rank").alias("text_rank"))
    b = vector_hits.select("query_id", "id", F.col("rank").alias("vector_rank"))

    def share(name: str):
        return F.coalesce(F.lit(1.0) / (F.lit(float(RRF)) + F.col(name)), F.lit(0.0))

    fused = a.join(b, ["query_id", "id"], "full").withColumn(
        "score", F.round(share("text_rank") + share("vector_rank"), 9)
    )
    return top_per(fused, ["query_id"], [F.col("score").desc(), F.col("id")], k, "rank").select(
        "query_id", "rank", "id", "text_rank", "vector_rank", "score"
    )


def filter_summaries(s: DataFrame, **filters: str | None) -> DataFrame:
    """Equality filters on domain, importance, thinking_stage and source."""
    columns = {"domain": "domain_primary"}
    for name, value in filters.items():
        if value is not None:
            s = s.where(F.col(columns.get(name, name)) == value)
    return s


def search_summaries(
    s: DataFrame, queries: Queries, vector_hits: DataFrame | None = None, mode: str = "hybrid", k: int = 10, **filters
) -> DataFrame:
    """Ranked summaries by text, vector or both; over-fetches 3k of each ranking before fusing.

    `vector_hits` is vector_topk over the same filtered summaries, with conversation_id as id.
    """
    rows = filter_summaries(s, **filters)
    if mode == "vector":
        hits = vector_hits.where(F.col("rank") <= k).select("query_id", "rank", "id", F.col("similarity").alias("score"))
    else:
        text_hits = bm25(rows, queries, k if mode == "fts" else 3 * k, "conversation_id", "embedding_text")
        if mode == "fts" or vector_hits is None:
            hits = text_hits.where(F.col("rank") <= k)
        else:
            hits = hybrid(text_hits, vector_hits.where(F.col("rank") <= 3 * k), k).select("query_id", "rank", "id", "score")
    return hits.join(rows, hits["id"] == rows["conversation_id"]).select(
        "query_id", "rank", "score", "conversation_id", F.left("title", F.lit(80)).alias("title"),
        F.left("summary", F.lit(400)).alias("summary"), "domain_primary", "thinking_stage", "source", "importance",
        F.slice("concepts", 1, 8).alias("concepts"),
    )


def extract_items(hits: DataFrame, s: DataFrame, field: str, n: int = 20, width: int = 250) -> DataFrame:
    """The listed questions, decisions or quotes of ranked summaries, in rank order, at most n per query.

    hits(query_id, rank, id) with conversation ids.
    """
    rows = hits.join(s, hits["id"] == s["conversation_id"])
    listed = rows.select(
        "query_id", "rank", "title", "domain_primary", "importance", "conversation_id", F.posexplode(field).alias("pos", "item")
    ).where(real_item(F.col("item"), "contains"))
    return top_per(listed, ["query_id"], [F.col("rank"), F.col("pos")], n, "position").select(
        "query_id", "position", F.left("item", F.lit(width)).alias("item"), "title", "domain_primary", "importance", "conversation_id"
    )


def unified(
    queries: Queries, message_hits: DataFrame, commits: DataFrame, docs: DataFrame, k: int = 15,
    per_source: tuple[int, int, int] = (5, 3, 3),
) -> DataFrame:
    """One ranking over message vectors, commits (0.40) and documents (0.45) per query.

    message_hits(query_id, rank, title, content, date, similarity, id).
    """
    asked = query_frame(commits, queries)
    texts = asked.select("query")
    n_messages, n_commits, n_docs = per_source
    messages = message_hits.where(F.col("rank") <= n_messages).select(
        "query_id", F.lit("conversation").alias("kind"), "title", "content", "date",
        F.round("similarity", 9).alias("score"), F.col("id").cast("string").alias("key"),
    )
    # The query texts form a list small enough to evaluate inside the scan.
    terms = [t for _, t in queries] if not isinstance(queries, DataFrame) else texts
    found_commits = match_terms(commits, ["message", "repo_name"], terms, "query", key="commit_id")
    found_commits = top_per(found_commits, ["query"], [F.col("timestamp").desc(), F.col("commit_id").desc()], n_commits)
    as_commits = found_commits.join(asked, "query").select(
        "query_id", F.lit("github").alias("kind"),
        F.concat("repo_name", F.lit(": "), F.left("message", F.lit(80))).alias("title"),
        F.col("message").alias("content"), F.date_format("timestamp", "yyyy-MM-dd").alias("date"),
        F.lit(0.4).alias("score"), F.col("commit_id").cast("string").alias("key"),
    )
    found_docs = match_terms(docs, ["content", "title", "filename"], terms, "query", key="filename")
    found_docs = top_per(found_docs, ["query"], [F.col("depth_score").desc(), F.col("filename")], n_docs)
    as_docs = found_docs.join(asked, "query").select(
        "query_id", F.lit("markdown").alias("kind"), F.coalesce("title", "filename").alias("title"),
        F.left("content", F.lit(500)).alias("content"), F.date_format("modified_at", "yyyy-MM-dd").alias("date"),
        F.lit(0.45).alias("score"), F.col("filename").alias("key"),
    )
    together = messages.unionByName(as_commits).unionByName(as_docs)
    order = [F.col("score").desc(), F.col("kind"), F.col("key")]
    return top_per(together, ["query_id"], order, k, "rank").select(
        "query_id", "rank", "kind", "title", preview(F.col("content"), 150).alias("preview"), "date", "score"
    )


def position_summary(hits: DataFrame, s: DataFrame) -> DataFrame:
    """What the ranked summaries say: (query_id, kind, position, text, title, citation).

    Hits are put in order of importance, then rank. Shown are the first five summaries, and the first decisions, open
    questions (both without repeats of the same 80-character opening) and quotes of all of them.
    """
    ordered = hits.join(s, hits["id"] == s["conversation_id"]).withColumn("_imp", F.greatest(importance_rank(F.col("importance")), F.lit(1)))
    top = ordered.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("_imp").desc(), "rank")))
    mark = cite(F.col("conversation_id"), F.col("summarized_at"))
    title = F.coalesce("title", F.lit("Untitled"))
    texts = top_per(top.where("summary <> ''"), ["query_id"], [F.col("place")], 5, "position").select(
        "query_id", F.lit("summary").alias("kind"), "position", preview(F.col("summary"), 300).alias("text"),
        title.alias("title"), mark.alias("citation"),
    )
    out = texts
    for kind, field, cap, width, dedupe in [
        ("decision", "decisions", 10, 200, True), ("question", "open_questions", 8, 200, True), ("quote", "quotable", 5, 250, False),
    ]:
        listed = top.select(
            "query_id", "place", title.alias("title"), mark.alias("citation"), F.posexplode(field).alias("pos", "item")
        ).where(real_item(F.col("item"), "contains"))
        order = [F.col("place"), F.col("pos")]
        if dedupe:
            listed = top_per(listed.withColumn("_opening", F.lower(F.left("item", F.lit(80)))), ["query_id", "_opening"], order, 1)
        rows = top_per(listed, ["query_id"], order, cap, "position")
        out = out.unionByName(
            rows.select("query_id", F.lit(kind).alias("kind"), "position", F.left("item", F.lit(width)).alias("text"), "title", "citation")
        )
    return out


def precedents(hits: DataFrame, s: DataFrame, shown: int = 10) -> DataFrame:
    """Similar past conversations with their first three real decisions."""
    top = hits.where(F.col("rank") <= shown)
    real = real_items(F.col("decisions"), "contains")
    return top.join(s, top["id"] == s["conversation_id"]).select(
        "query_id", "rank", "title", "domain_primary", "thinking_stage", "source", "importance",
        preview(F.col("summary"), 350).alias("summary"),
        F.slice(F.transform(real, lambda d: F.left(d, F.lit(150))), 1, 3).alias("decisions"), "conversation_id",
    )


def stage_progress(hits: DataFrame, s: DataFrame) -> DataFrame:
    """Ranked summaries in order of thinking stage."""
    order = F.array_position(F.array(*[F.lit(x) for x in schema.STAGES]), F.col("thinking_stage"))
    rows = hits.join(s, hits["id"] == s["conversation_id"]).where(F.col("thinking_stage").isin(schema.STAGES))
    return rows.select(
        "query_id", order.alias("stage_order"), "thinking_stage", "rank", "title", "importance", "domain_primary"
    )


def related_by_period(hits: DataFrame, messages: DataFrame, periods: int = 4, per_period: int = 2) -> DataFrame:
    """Ranked messages grouped by month, newest months first; messages(id, year, month, title, content)."""
    rows = hits.join(messages, "id").withColumn(
        "period", F.concat_ws("-", "year", F.lpad(F.col("month").cast("string"), 2, "0"))
    )
    months = rows.groupBy("query_id", "period").agg(F.count(F.lit(1)).alias("related"))
    kept = top_per(months, ["query_id"], [F.col("period").desc()], periods)
    heads = top_per(rows, ["query_id", "period"], [F.col("rank")], per_period, "position")
    return heads.join(kept, ["query_id", "period"]).select(
        "query_id", "period", "related", "position", "title", F.left("content", F.lit(150)).alias("preview"), "similarity"
    )
