"""The registered queries: name to callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import schema
from colloquy.functions import domains as dom
from colloquy.functions import noise
from colloquy.functions import text as tx
from colloquy.functions.jsonlist import json_list
from colloquy.operators import (
    docs, domain_state, facts, fulltext, links, messages as msg, quality, raw_domains, search, telemetry,
    text_index, timeline, vector, vector_index,
)
from colloquy.plans import derive
from colloquy.session import listed_rows, prepare, shared_folder
from colloquy.sources import documents as doc_sources
from colloquy.sources import jsonl
from colloquy.sources import summaries as summary_source
from colloquy.sources import registry
from colloquy.sources.arrays import read_array_elements
from colloquy.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]

TOPICS = ["python", "next step", "database", "the", "example.com", "repo-1"]
DOMAINS = ["database", "python", "data-engineering", "documentation", "ai-dev", "next-step"]
PAIRS = [("python", "database"), ("database", "next step"), ("next step", "the"), ("the", "python"), ("repo-1", "python")]
TEXT_QUERIES = [("a", "python database"), ("b", "the next step"), ("c", "der die das"), ("d", "example repo")]
CONFIGURED = [("src0", "/logs/0"), ("src1", "/logs/1"), ("other", "/logs/2")]
REQUIREMENTS = {
    "kw_search": ["messages"], "vector_topk": ["vectors"], "hybrid": ["summaries", "vectors"],
    "repo_timeline": ["repos", "commits"], "alignment": ["principles", "vectors"],
}


def present(df: DataFrame) -> DataFrame:
    """Plain comparable columns: wide integers, text dates and times, joined lists."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), " | ")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


_REGISTRY: dict[str, Query] = {}


def _add(name: str, build: Query) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(build(prepare(spark), sf_dir))

    run.__name__ = name
    _REGISTRY[name] = run


def _on(source: Query, operator) -> Query:
    return lambda spark, d: operator(source(spark, d))


M, TN, S = derive.messages, derive.turns, derive.summaries


def _summary_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Nearest summaries of every label centroid; a summary's vector is that of its document."""
    vectors = derive.message_vectors(spark, d).join(S(spark, d).select("conversation_id"), "conversation_id", "left_semi")
    return vector.vector_topk(vectors, derive.centroids(spark, d), k, "conversation_id")


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("distance", F.round("distance", 6)).withColumn("similarity", F.round("similarity", 6))


# Projections and derived columns
_add("canonicalize", lambda spark, d: M(spark, d).drop("created", "updated"))
_add("finalize", lambda spark, d: msg.finalize(M(spark, d)).select(
    "conversation_id", "message_id", "msg_index", "conversation_msg_count", "is_first", "is_last"))
_add("parse_ts", lambda spark, d: derive.generic_lines(spark, d).select(
    "path", "pos", F.get_json_object("value", "$.timestamp").alias("raw")).where("raw IS NOT NULL").select(
    "path", "pos", tx.parse_ts(F.col("raw"), F.lit("2024-06-01").cast("timestamp")).alias("ts")))
_add("normalize_role", lambda spark, d: derive.transcript_lines(spark, d).select(
    "path", "pos", tx.normalize_role(F.coalesce(F.get_json_object("value", "$.message.role"), F.get_json_object("value", "$.role"))).alias("role")))
_add("project_name", lambda spark, d: derive.session_lines(spark, d).select(
    "path", tx.project_name(F.element_at(F.split("path", "/"), -2)).alias("project")).distinct())
_add("noise_flag", _on(M, lambda m: m.select("message_id", noise.drop_reason(F.col("content")).alias("drop_reason"))))
_add("noise_manifest", _on(M, msg.noise_manifest))
_add("preview", _on(M, lambda m: m.select(
    "message_id", tx.preview(F.col("content"), 80).alias("cut"), tx.truncate_words(F.col("content"), 250).alias("words"))))
_add("guess_source", lambda spark, d: derive.table(spark, d, "conversations").select(
    F.concat(derive._pick(["cc_", "chatgpt_", "CB_", "clawdbot-", "cd_", "zz_"], F.col("conv_id") % 6), F.col("conv_id").cast("string")).alias("id")
    ).distinct().withColumn("source", tx.guess_source(F.col("id"))))
_add("match_label", lambda spark, d: derive.table(spark, d, "events").select("event_id", (F.col("value") / 20.0).alias("s")).select(
    "event_id", tx.match_label(F.col("s")).alias("label"), tx.match_class(F.col("s")).alias("css"), tx.similarity_class(F.col("s")).alias("level")))
_add("cite", _on(S, lambda s: s.select("conversation_id", tx.cite(F.col("conversation_id"), F.col("summarized_at")).alias("mark"))))
_add("json_list", lambda spark, d: derive.summary_columns(spark, d).select("conversation_id", "open_questions", "quotable").select(
    "conversation_id", json_list(F.col("open_questions")).alias("questions"), json_list(F.col("quotable")).alias("quotes"),
    json_list(F.when(F.col("quotable") == "", F.lit('{"a": 1}')).otherwise(F.lit("[broken"))).alias("odd")))
_add("domain_keywords", _on(M, lambda m: search.keyword_hits(m, DOMAINS).groupBy("domain", "keyword", "rank").agg(F.count(F.lit(1)).alias("hits"))))

# Keyword search and listings
_add("kw_search", _on(TN, lambda t: search.kw_search(t, TOPICS)))
_add("kw_search_batch", _on(TN, lambda t: search.kw_search(
    t, t.sparkSession.createDataFrame([(x,) for x in TOPICS], "topic string"), role="user", limit=5)))
_add("kw_search_wildcards", _on(TN, lambda t: search.kw_search(t, ["what%step", "repo-_"], wildcards=True)))
_add("recent", _on(TN, lambda t: search.recent(t, hours=96)))
_add("kw_search_role", _on(M, lambda m: search.kw_search_role(m, TOPICS, role="assistant")))
_add("recent_questions", _on(M, search.recent_questions))
_add("kw_facets", _on(M, lambda m: search.kw_facets(m, TOPICS, source="src1", role="user", date_from="2024-02-01", date_to="2024-06-30", limit=4, offset=2)))
_add("facets", _on(M, search.facets))
_add("get_conversation", _on(M, lambda m: search.get_conversation(m, ["conv_1", "conv_7", "conv_42"])))
_add("open_turns", _on(TN, search.open_turns))
_add("dropped", _on(M, lambda m: search.dropped(
    msg.dropped_rows(m).select(F.col("msg_timestamp").alias("ts"), F.col("source").alias("src"), F.col("conversation_id").alias("conv_id"),
                               "role", F.col("content").alias("text"), "message_id", "drop_reason"))))
_add("sample_messages", _on(M, search.sample_messages))
_add("positions", _on(TN, lambda t: search.positions(t, TOPICS)))
_add("trajectory", _on(TN, lambda t: search.trajectory(t, TOPICS)))
_add("tunnel_recent", _on(TN, lambda t: search.tunnel_recent(t, TOPICS)))
_add("domain_search", _on(M, lambda m: search.domain_search(m, DOMAINS).drop("content")))
_add("visible_rows", lambda spark, d: search.visible_rows(derive.layers(spark, d)[0], derive.members(spark, d), "u3").select("id", "owner_user_id", "visibility"))

# Counts, timelines and trends
_add("health", _on(TN, timeline.health))
_add("archive_stats", _on(M, timeline.archive_stats))
_add("overview", lambda spark, d: quality.overview(
    M(spark, d), derive.message_vectors(spark, d), S(spark, d), derive.repos(spark, d), derive.commits(spark, d), derive.docs(spark, d)))
_add("conv_stats", _on(M, timeline.conv_stats))
_add("conv_summary", _on(M, timeline.conv_summary))
_add("longest_conversations", _on(M, timeline.longest_conversations))
_add("message_totals", _on(M, timeline.message_totals))
_add("timeline_day", _on(M, timeline.timeline_day))
_add("convs_by_date", _on(TN, timeline.convs_by_date))
_add("velocity", _on(M, lambda m: timeline.velocity(m, TOPICS)))
_add("velocity_quarter", _on(M, lambda m: timeline.velocity(m, TOPICS, "quarter")))
_add("velocity_trend", _on(M, lambda m: timeline.velocity_trend(m, TOPICS)))
_add("first_mention", _on(M, lambda m: timeline.first_mention(m, TOPICS)))
_add("month_snapshot", _on(M, timeline.month_snapshot))
_add("month_titles", _on(M, timeline.month_titles))
_add("month_questions", _on(M, timeline.month_questions))
_add("month_sources", _on(M, timeline.month_sources))
_add("heatmap", _on(M, lambda m: timeline.heatmap(m, days=100)))
_add("heatmap_filled", _on(M, lambda m: timeline.heatmap(m, days=30, fill=True)))
_add("recent_convs", _on(M, timeline.recent_convs))
_add("source_status", _on(M, lambda m: timeline.source_status(m, CONFIGURED)))
_add("transcripts", _on(M, timeline.transcripts))
_add("summarize_pending", lambda spark, d: timeline.transcripts(
    M(spark, d), S(spark, d).where("importance <> 'routine'").select("conversation_id")).select("conversation_id", "msg_count"))
_add("command_language", _on(M, timeline.command_language))
_add("coverage_progress", lambda spark, d: quality.coverage_progress(M(spark, d), derive.message_vectors(spark, d), S(spark, d)))
_add("input_status", lambda spark, d: quality.input_status(
    REQUIREMENTS, messages=M(spark, d), vectors=derive.message_vectors(spark, d), summaries=S(spark, d),
    repos=derive.repos(spark, d), commits=derive.commits(spark, d)))

# Domains from summaries
_add("domain_map", _on(S, domain_state.domain_map))
_add("distributions", _on(S, domain_state.distributions))
_add("top_concepts", _on(S, domain_state.top_concepts))
_add("pulse", _on(S, domain_state.pulse))
_add("pulse_domain", _on(S, lambda s: domain_state.pulse(s, "domain-3")))
_add("domain_state", _on(S, domain_state.domain_state))
_add("domain_brief", _on(S, domain_state.domain_brief))
_add("domain_brief_items", _on(S, domain_state.domain_brief_items))
_add("dormant", _on(S, domain_state.dormant))
_add("open_threads", _on(S, domain_state.open_threads))
_add("domain_history", _on(S, domain_state.domain_history))
_add("domain_switches", _on(S, domain_state.domain_switches))
_add("switch_cost", _on(S, lambda s: domain_state.switch_cost(s, domain_state.domain_switches(s))))
_add("patterns", _on(S, domain_state.patterns))
_add("patterns_by_domain", _on(S, lambda s: domain_state.patterns(s, by_domain=True)))
_add("coverage", _on(S, domain_state.coverage))
_add("domain_coverage", _on(S, domain_state.domain_coverage))
_add("unfinished", _on(S, domain_state.unfinished))

# Domains from messages alone
_add("domain_state_raw", _on(M, lambda m: raw_domains.domain_state_raw(m, DOMAINS)))
_add("dormant_raw", _on(M, raw_domains.dormant_raw))
_add("domain_brief_raw", _on(M, lambda m: raw_domains.domain_brief_raw(m, DOMAINS)))
_add("domain_brief_raw_items", _on(M, lambda m: raw_domains.domain_brief_raw_items(m, DOMAINS)))
_add("domain_history_raw", _on(M, lambda m: raw_domains.domain_history_raw(m, DOMAINS)))
_add("switch_cost_raw", _on(M, lambda m: raw_domains.switch_cost_raw(m, PAIRS)))
_add("activity_raw", _on(M, raw_domains.activity_raw))
_add("activity_raw_domains", _on(M, lambda m: raw_domains.activity_raw(m, DOMAINS)))
_add("open_threads_raw", _on(M, raw_domains.open_threads_raw))
_add("coverage_raw", lambda spark, d: raw_domains.coverage_raw(M(spark, d), derive.message_vectors(spark, d)))
_add("position_raw", _on(M, lambda m: raw_domains.position_raw(m, TOPICS)))

# Links
_add("project_mentions", lambda spark, d: links.project_mentions(M(spark, d), derive.repos(spark, d), ["repo-1", "repo-7", "python"]))
_add("date_validity", lambda spark, d: links.date_validity(M(spark, d), derive.repos(spark, d)))
_add("repo_timeline", lambda spark, d: links.repo_timeline(derive.repos(spark, d), derive.commits(spark, d), ["repo-1", "repo-7"]))
_add("repo_activity", lambda spark, d: links.repo_activity(derive.repos(spark, d), derive.commits(spark, d)))
_add("repo_stats", lambda spark, d: links.repo_stats(derive.repos(spark, d), derive.commits(spark, d)))
_add("repo_languages", lambda spark, d: links.repo_languages(derive.repos(spark, d)))
_add("citation_chain", lambda spark, d: links.citation_chain(*reversed(derive.layers(spark, d))))
_add("alignment", lambda spark, d: links.alignment(
    search.user_questions(M(spark, d)).select(F.col("message_id").alias("decision_id"), F.col("content").alias("decision")),
    derive.principles(spark, d)).drop("formula"))
_add("layer_violations", lambda spark, d: quality.layer_violations(*derive.layers(spark, d)))
_add("reply_tree", lambda spark, d: msg.reply_tree(M(spark, d)))
_add("dedupe_messages", lambda spark, d: msg.dedupe_messages(
    M(spark, d).unionByName(M(spark, d).withColumn("created", F.col("created") + F.make_interval(hours=F.lit(1))))).select("message_id", "created"))

# Documents
_add("docs_search", lambda spark, d: docs.docs_search(derive.docs(spark, d), ["the", "doc 1", "der"]))
_add("docs_breakthrough", _on(derive.docs, docs.docs_breakthrough))
_add("docs_deep", _on(derive.docs, docs.docs_deep))
_add("docs_project", _on(derive.docs, lambda x: docs.docs_project(x, "src3")))
_add("docs_todos", _on(derive.docs, docs.docs_todos))
_add("docs_todos_project", _on(derive.docs, lambda x: docs.docs_todos(x, "src3")))
_add("docs_stats", _on(derive.docs, docs.docs_stats))

# Facts and telemetry
_add("daily_facts", lambda spark, d: facts.daily_facts(M(spark, d), derive.commits(spark, d), derive.spend(spark, d)))
_add("daily_focus", _on(M, facts.daily_focus))
_add("tech_stacks", _on(M, facts.tech_stacks))
_add("problems", _on(derive.problem_months, facts.problems))
_add("spend", _on(derive.spend, facts.spend_monthly))
_add("spend_daily", _on(derive.spend, lambda x: facts.spend_daily(x, "1998-05")))
_add("tool_popularity", _on(derive.telemetry, telemetry.tool_popularity))
_add("funnel", _on(derive.telemetry, telemetry.funnel))
_add("error_rates", _on(derive.telemetry, telemetry.error_rates))
_add("weekly_growth", _on(derive.telemetry, telemetry.weekly_growth))

# Vectors and ranking
_add("vector_topk", lambda spark, d: _rounded(vector.vector_topk(derive.message_vectors(spark, d), derive.centroids(spark, d), 10)))
_add("vector_topk_filtered", lambda spark, d: _rounded(vector.vector_topk(
    derive.message_vectors(spark, d).where("role = 'user' AND year >= 2021"), derive.centroids(spark, d), 5, min_similarity=0.3, offset=3)))


def _vector_ann(spark: SparkSession, d: str) -> DataFrame:
    """Whether the stored index, made of two thirds of the vectors and grown by the rest, finds nine of the ten nearest."""
    path, vectors, asked = shared_folder(spark, "vector-index"), derive.message_vectors(spark, d), derive.centroids(spark, d)
    later = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    vector_index.build_index(vectors.where(~later), path)
    vector_index.add_to_index(vectors.where(later), path)
    found = vector.recall(vector.vector_topk(vectors, asked, 10), vector_index.search_index(spark, path, asked, 10))
    return found.select("query_id", (F.col("recall") >= 0.9).alias("found"))


_add("vector_ann", _vector_ann)
_add("vector_stats", _on(derive.message_vectors, vector.vector_stats))
_add("dim_check", _on(derive.message_vectors, lambda v: vector.dim_check(v, 64)))
_add("embed_pending", lambda spark, d: vector.embed_pending(M(spark, d), derive.message_vectors(spark, d)))
_add("summary_texts", _on(S, vector.summary_texts))
_add("hash_embed", _on(M, lambda m: vector.hash_embed(m.select("message_id", "content"), "content", dim=64).select(
    "message_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight > 0").withColumn("weight", F.round(F.col("weight").cast("double"), 6))))


def _semantic(spark: SparkSession, rows: DataFrame, id_col: str, text_col: str, k: int = 10) -> DataFrame:
    asked = listed_rows(spark, TEXT_QUERIES, "query_id string, query string")
    return vector.semantic_topk(rows, asked, k, id_col, text_col, lambda df, text: vector.hash_embed(df, text, dim=64))


def _search_summaries(spark: SparkSession, d: str, mode: str) -> DataFrame:
    rows = fulltext.filter_summaries(S(spark, d), importance="significant")
    hits = _semantic(spark, rows, "conversation_id", "embedding_text", 30)
    return fulltext.search_summaries(S(spark, d), TEXT_QUERIES, hits, mode=mode, importance="significant").select(
        "query_id", "rank", "conversation_id", F.round("score", 6).alias("score"))


_add("semantic_search", lambda spark, d: _semantic(spark, M(spark, d), "message_id", "content").withColumn("similarity", F.round("similarity", 6)))


def _position_raw_full(spark: SparkSession, d: str) -> DataFrame:
    """Mentions and hits by meaning; position_raw holds the mentions only."""
    users = M(spark, d).where("role = 'user'")
    asked = listed_rows(spark, [(t, t) for t in TOPICS], "query_id string, query string")
    hits = vector.semantic_topk(users, asked, 10, "message_id", "content", lambda df, text: vector.hash_embed(df, text, dim=64))
    semantic = hits.join(users.select(F.col("message_id").alias("id"), "conversation_title", "content"), "id").select(
        F.col("query_id").alias("topic"), "rank", "conversation_title", "content", F.round("similarity", 6).alias("similarity"))
    return raw_domains.position_raw(M(spark, d), TOPICS, semantic)


_add("position_raw_full", _position_raw_full)
_add("docs_semantic", lambda spark, d: _semantic(spark, derive.docs(spark, d), "filename", "content").withColumn("similarity", F.round("similarity", 6)))
_add("commits_semantic", lambda spark, d: _semantic(spark, derive.commits(spark, d), "commit_id", "message").withColumn("similarity", F.round("similarity", 6)))
_add("search_summaries_vector", lambda spark, d: _search_summaries(spark, d, "vector"))
_add("search_summaries_hybrid", lambda spark, d: _search_summaries(spark, d, "hybrid"))
_add("bm25", _on(S, lambda s: fulltext.bm25(s, TEXT_QUERIES, 10, "conversation_id", "embedding_text").withColumn("score", F.round("score", 6))))


def _bm25_index(spark: SparkSession, d: str) -> DataFrame:
    """As bm25, from a stored index made of half of the summaries and grown by the other half."""
    path, later = shared_folder(spark, "text-index"), F.pmod(F.xxhash64("conversation_id"), F.lit(2)) == 0
    text_index.build_text_index(S(spark, d).where(~later), path, "conversation_id", "embedding_text")
    text_index.add_to_text_index(S(spark, d).where(later), path, "conversation_id", "embedding_text")
    return text_index.search_text_index(spark, path, TEXT_QUERIES, 10).withColumn("score", F.round("score", 6))


_add("bm25_index", _bm25_index)
_add("hybrid", lambda spark, d: fulltext.hybrid(
    fulltext.bm25(S(spark, d), [(f"label-{i}", q) for i, (_, q) in enumerate(TEXT_QUERIES)], 30, "conversation_id", "embedding_text"),
    _summary_hits(spark, d, 30), 10))
_add("search_summaries", lambda spark, d: fulltext.search_summaries(
    S(spark, d), TEXT_QUERIES, mode="fts", importance="significant").withColumn("score", F.round("score", 6)))
_add("extract_items", lambda spark, d: fulltext.extract_items(_summary_hits(spark, d, 10), S(spark, d), "open_questions", 8))
_add("unified", lambda spark, d: fulltext.unified(
    [("label-0", "high"), ("label-1", "the"), ("label-2", "repo-7")],
    vector.vector_topk(derive.message_vectors(spark, d), derive.centroids(spark, d), 5).join(
        derive.message_vectors(spark, d).select("id", F.col("conversation_title").alias("title"), "content", F.concat_ws("-", "year", F.lpad(F.col("month").cast("string"), 2, "0")).alias("date")), "id"),
    derive.commits(spark, d), derive.docs(spark, d)).withColumn("score", F.round("score", 6)))
_add("position_summary", lambda spark, d: fulltext.position_summary(_summary_hits(spark, d, 20), S(spark, d)))
_add("precedents", lambda spark, d: fulltext.precedents(_summary_hits(spark, d, 15), S(spark, d)))
_add("stage_progress", lambda spark, d: fulltext.stage_progress(_summary_hits(spark, d, 20), S(spark, d)))
_add("related_by_period", lambda spark, d: fulltext.related_by_period(
    vector.vector_topk(derive.message_vectors(spark, d), derive.centroids(spark, d), 20),
    derive.message_vectors(spark, d).select("id", "year", "month", F.col("conversation_title").alias("title"), "content")).withColumn(
    "similarity", F.round("similarity", 6)))

# Ingestion
INGESTED = ["source", "model", "project", "conversation_id", "conversation_title", "message_id", "msg_index", "conversation_msg_count",
            "is_first", "is_last", "role", "msg_timestamp", "temporal_precision", "content"]
AS_OF = "2024-06-01"
_add("ingest_generic", lambda spark, d: jsonl.parse_generic(derive.generic_lines(spark, d), as_of=AS_OF).select(INGESTED))
_add("ingest_sessions", lambda spark, d: jsonl.parse_sessions(derive.session_lines(spark, d)).select(INGESTED))
_add("ingest_forward_fill", lambda spark, d: jsonl.parse_agent_sessions(derive.agent_lines(spark, d), as_of=AS_OF).select(INGESTED))
_add("ingest_transcript", lambda spark, d: jsonl.parse_transcripts(derive.transcript_lines(spark, d), as_of=AS_OF).select(INGESTED))
_add("ingest_export", lambda spark, d: doc_sources.parse_export(derive.export_docs(spark, d), as_of=AS_OF).select(INGESTED))


def _ingest_export_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The export's conversations as files of one large array each, read element by element."""
    folder = shared_folder(spark, "arrays")
    derive.export_arrays(spark, d).write.text(folder)
    return doc_sources.parse_export(read_array_elements(spark, folder, "*.txt"), as_of=AS_OF).select(INGESTED)


_add("ingest_export_arrays", _ingest_export_arrays)
_add("ingest_export_tree", lambda spark, d: doc_sources.parse_export(
    derive.export_docs(spark, d), "chatgpt-export", tree_order=True, as_of=AS_OF).select(INGESTED))
_add("ingest_gemini", lambda spark, d: doc_sources.parse_gemini(derive.gemini_docs(spark, d), as_of=AS_OF).select(INGESTED))
_add("ingest_kv_chats", lambda spark, d: doc_sources.parse_kv_chats(derive.kv_items(spark, d), as_of=AS_OF).select(INGESTED))
DERIVED_SOURCES = {
    "custom": lambda spark, d: jsonl.parse_generic(derive.generic_lines(spark, d), as_of=AS_OF),
    "claude-code": lambda spark, d: jsonl.parse_sessions(derive.session_lines(spark, d)),
    "clawdbot": lambda spark, d: jsonl.parse_agent_sessions(derive.agent_lines(spark, d), as_of=AS_OF),
    "cursor": lambda spark, d: jsonl.parse_transcripts(derive.transcript_lines(spark, d), as_of=AS_OF),
    "cursor-kv": lambda spark, d: doc_sources.parse_kv_chats(derive.kv_items(spark, d), as_of=AS_OF),
    "chatgpt": lambda spark, d: doc_sources.parse_export(derive.export_docs(spark, d), as_of=AS_OF),
    "chatgpt-export": lambda spark, d: doc_sources.parse_export(derive.export_docs(spark, d), "chatgpt-export", tree_order=True, as_of=AS_OF),
    "gemini-cli": lambda spark, d: doc_sources.parse_gemini(derive.gemini_docs(spark, d), as_of=AS_OF),
}


def _ingest_all(spark: SparkSession, d: str) -> DataFrame:
    """All eight formats through the registry into the stored table, counted from there."""
    for name, reader in DERIVED_SOURCES.items():
        registry.register_source(f"derived:{name}", reader)
    target = f"{shared_folder(spark, 'all')}/messages"
    registry.write_messages(registry.ingest_all(spark, [(f"derived:{name}", d) for name in DERIVED_SOURCES]), target)
    return timeline.source_stats(registry.read_messages(spark, target))


_add("ingest_all", _ingest_all)
_add("summaries_from_records", lambda spark, d: summary_source.summaries_from_records(derive.record_lines(spark, d), AS_OF).select(
    "conversation_id", "source", "title", "msg_count", "summary", "concepts", "decisions", "open_questions", "importance",
    "domain_primary", "thinking_stage", "resurface_when", "embedding_text", "summary_hash", "command_language", "edges_json",
    "corrections_json", "temporal_facts_json", "assets_json"))
_add("record_violations", lambda spark, d: quality.record_violations(summary_source.decode_records(derive.record_lines(spark, d))))
_add("concept_edges", lambda spark, d: quality.concept_degrees(quality.concept_edges(summary_source.decode_records(derive.record_lines(spark, d)))))


# Streams over the given tables
def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    shape = derive.table(spark, d, "events").schema
    return derive.telemetry_of(spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(d))


def _tool_popularity_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counts as they are; the approximate ones as whether users are within a tenth (or one) and the 95th percentile is between the 90th and the largest."""
    found = streams.run_updates(streams.tool_popularity_stream(_event_stream(spark, d)), shared_folder(spark, "tools"), ["window_start", "tool"])
    calls = derive.telemetry(spark, d).where("event = 'tool_called'").select(
        F.date_trunc("day", "ts").alias("window_start"), "machine_id", F.from_json("props", "tool string, latency_ms double").alias("p"))
    exact = calls.groupBy("window_start", F.col("p.tool").alias("tool")).agg(
        F.countDistinct("machine_id").alias("n"), F.percentile("p.latency_ms", F.array(F.lit(0.9), F.lit(1.0))).alias("p"))
    near = F.abs(F.col("users") - F.col("n")) <= F.greatest(F.col("n") * 0.1, F.lit(1))
    fast = F.col("p95_latency_ms").between(F.col("p")[0], F.col("p")[1])
    return found.join(exact, ["window_start", "tool"]).select("window_start", "tool", "calls", near.alias("users_within"), F.coalesce(fast, F.lit(True)).alias("p95_within"))


_add("stream_event_counts", lambda spark, d: streams.run_updates(
    streams.window_counts(_event_stream(spark, d), "ts", "event"), shared_folder(spark, "counts"), ["window_start", "event"]))
_add("stream_tool_popularity", _tool_popularity_stream)


def _message_stream(spark: SparkSession, d: str) -> DataFrame:
    shape = derive.table(spark, d, "events").schema
    raw = spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(d)
    ids = F.explode(F.array(F.col("event_id"), F.col("event_id")))
    return raw.select(ids.alias("message_id"), F.col("ts").cast("timestamp").alias("msg_timestamp"), F.col("event_type").alias("source"))


_add("stream_unique_messages", lambda spark, d: streams.run_to_files(
    streams.unique_messages(_message_stream(spark, d)), shared_folder(spark, "unique")))


def _stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "ingest")
    summary_source.append_records(derive.generic_lines(spark, d).select("value"), f"{folder}/in", full=True)
    lines = streams.stream_lines(spark, f"{folder}/in", "part-*")
    streams.ingest_stream(lines, "generic", f"{folder}/out", f"{folder}/state").awaitTermination()
    return registry.read_messages(spark, f"{folder}/out").select("conversation_id", "role", "msg_timestamp", "content")


def _move_parts(spark: SparkSession, folder: str, target: str) -> None:
    """Put the part files of `folder` in the place of those of the same numbers in `target`, under their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    old = {f.getPath().getName()[:10]: f.getPath().getName() for f in fs.listStatus(path(target))}
    for f in fs.listStatus(path(folder)):
        name = f.getPath().getName()
        if name.startswith("part-"):
            place = path(f"{target}/{old.get(name[:10], name)}")
            fs.delete(place, False)
            fs.rename(f.getPath(), place)


def _ingest_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Two calls: files that lack some lines, then the same files grown by these, and new ones."""
    folder = shared_folder(spark, "incremental")
    lines = derive.generic_lines(spark, d).select("value", F.get_json_object("value", "$.conversation_id").alias("c"), "path", "block", "pos")
    half = F.pmod(F.xxhash64("c"), F.lit(2))

    def put(rows: DataFrame, name: str) -> None:
        dealt = rows.repartition(4, "c").sortWithinPartitions("path", "block", "pos")
        summary_source.append_records(dealt.select("value"), f"{folder}/{name}", full=True)

    put(lines.where((half == 0) & (F.pmod(F.xxhash64("value"), F.lit(3)) > 0)), "in/turn=0")
    registry.ingest_incremental(spark, "generic", f"{folder}/in", f"{folder}/store", "part-*", as_of=AS_OF)
    put(lines.where(half == 0), "grown")
    _move_parts(spark, f"{folder}/grown", f"{folder}/in/turn=0")
    put(lines.where(half == 1), "in/turn=1")
    out = registry.ingest_incremental(spark, "generic", f"{folder}/in", f"{folder}/store", "part-*", as_of=AS_OF)
    return out.select("conversation_id", "message_id", "msg_index", "conversation_msg_count", "role", "msg_timestamp", "content")


def _stream_vectors(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "vectors")
    registry.write_messages(M(spark, d), f"{folder}/in")
    arriving = spark.readStream.schema(schema.MESSAGES).option("maxFilesPerTrigger", 200).parquet(f"{folder}/in")
    streams.embed_stream(
        arriving, lambda rows: vector.hash_embed(rows, "content", dim=64), f"{folder}/out", f"{folder}/state"
    ).awaitTermination()
    stored = spark.read.schema(schema.MESSAGE_VECTORS).parquet(f"{folder}/out")
    return stored.select("message_id", F.size("embedding").alias("dim"))


_add("stream_ingest", _stream_ingest)
_add("ingest_incremental", _ingest_incremental)
_add("stream_vectors", _stream_vectors)
_add("source_inventory", lambda spark, d: registry.source_inventory(
    spark, [(t, d, f"{t}.parquet") for t in ("conversations", "documents", "events", "embeddings")]).drop("path", "newest"))


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)
