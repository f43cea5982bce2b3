"""DuckDB SQL that computes the registered queries from the given tables.

Each entry names the shared table expressions it needs; they restate FIXTURES.md §2 in SQL.
"""

from __future__ import annotations

from colloquy.functions import domains as dom
from colloquy.functions import noise
from colloquy.functions.text import CODE_MARKERS, COMMAND_PHRASES
from colloquy.operators.facts import STOP_WORDS, TECHNOLOGIES
from colloquy.operators.search import OPEN_TOKENS
from colloquy.plans import derive, queries as q
from colloquy.schema import (
    EXTRACTION_TYPES, FUSION_TYPES, IMPORTANCE, PRECISIONS, ROLES, STAGES, SYNTHESIS_TYPES, VISIBILITIES,
)


def lit(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def among(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def rows(values) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else lit(v) for v in row) + ")" for row in values)


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def minutes(n: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({n} AS BIGINT)))"


def pick(values, index: str) -> str:
    return f"list_extract({listed(values)}, CAST({index} AS BIGINT) + 1)"


def joined(c: str) -> str:
    return f"array_to_string({c}, ' | ')"


def cut(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN left({c}, {n}) || '...' ELSE {c} END"


NL = "chr(10)"
MENTION = "contains(lower(content), lower(topic))"
HIT2 = "(contains(lower(content), lower({0})) OR contains(lower(conversation_title), lower({0})))"
_code = " OR ".join(f"contains(content, {lit(m)})" for m in CODE_MARKERS)
_ask = "role = 'user' AND has_question = 1"

_noise = (
    "CASE WHEN n IN {tool} OR starts_with(n, '[request interrupted') OR starts_with(n, '[image: user uploaded') "
    "OR starts_with(n, '<local-command') THEN 'tool-output' WHEN n IN {conf} THEN 'confirmation' "
    "WHEN n IN {comm} THEN 'generic-command' "
    "WHEN regexp_matches(n, '^([a-z]|[0-9]+x?|kill [0-9]+)$') THEN 'single-token' END"
).format(tool=among(noise.TOOL_TEXTS), conf=among(noise.CONFIRMATIONS), comm=among(noise.COMMANDS))

# Shared table expressions in order of dependence.
VIEWS: dict[str, str] = {
    "raw_turns": f"""
        SELECT conv_id, turn, role, 'src' || (conv_id % 4) AS source, 'model-' || (conv_id % 3) AS model,
          'proj-' || (conv_id % 6) AS project, 'conv_' || conv_id AS conversation_id,
          'Topic ' || (conv_id % 25) AS conversation_title, {minutes('conv_id * 2880 + turn * 5')} AS created,
          'conv_' || conv_id || '_' || turn AS message_id,
          CASE WHEN turn > 0 THEN 'conv_' || conv_id || '_' || (turn - 1) END AS parent_id, turn AS msg_index,
          CASE WHEN conv_id % 9 = 0 THEN 'day' ELSE 'exact' END AS temporal_precision,
          CASE WHEN (conv_id * 7 + turn) % 13 = 0 THEN {pick(derive.NOISE_SAMPLES, '(conv_id + turn) % 8')}
            ELSE text || CASE WHEN (conv_id + turn) % 3 = 0 THEN ' what is the next step?' ELSE '' END
              || CASE WHEN (conv_id + turn) % 7 = 0 THEN ' TODO python database' ELSE '' END
              || CASE WHEN (conv_id + turn) % 11 = 0 THEN ' https://example.com/x' ELSE '' END
              || CASE WHEN (conv_id + turn) % 5 = 0 THEN ' see repo-' || (conv_id % 20) ELSE '' END
              || CASE WHEN (conv_id + turn) % 17 = 0 THEN ' no no no, step back and think with me' ELSE '' END
          END AS raw_text
        FROM conversations WHERE role IN ('user', 'assistant')""",
    "m": f"""
        SELECT * EXCLUDE (full_text), full_text AS content,
          CAST(len(regexp_extract_all(full_text, '\\S+')) AS BIGINT) AS word_count, length(full_text) AS char_count,
          CASE WHEN {_code.replace('content', 'full_text')} THEN 1 ELSE 0 END AS has_code,
          CASE WHEN regexp_matches(full_text, 'https?://') THEN 1 ELSE 0 END AS has_url,
          CASE WHEN contains(full_text, '?') THEN 1 ELSE 0 END AS has_question,
          CASE WHEN temporal_precision = 'exact' THEN 0 ELSE 1 END AS timestamp_is_fallback,
          year(created) AS year, month(created) AS month, hour(created) AS hour, strftime(created, '%A') AS day_of_week,
          strftime(created, '%Y-%m') AS period, CAST(created AS DATE) AS d
        FROM (SELECT * EXCLUDE (raw_text), regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g') AS full_text FROM raw_turns)
        WHERE length(full_text) > 0""",
    "nm": f"SELECT *, {_noise} AS drop_reason FROM (SELECT *, lower(content) AS n FROM m)",
    "topics": f"SELECT unnest({listed(q.TOPICS)}) AS topic",
    "hits": f"SELECT topic, m.* FROM m JOIN topics ON {MENTION}",
    "uhits": "SELECT * FROM hits WHERE role = 'user'",
    "kw": f"SELECT * FROM (VALUES {rows(dom.keyword_rows(q.DOMAINS))}) t(domain, keyword, rank)",
    "khits": f"SELECT domain, keyword, rank, m.* FROM m JOIN kw ON {HIT2.format('keyword')}",
    "fhits": "SELECT * FROM khits WHERE (domain, rank) IN (SELECT (domain, min(rank)) FROM khits GROUP BY domain)",
    "dsearch": """
        SELECT domain, keyword, position, conversation_title, content, created, source, message_id FROM (
          SELECT *, row_number() OVER (PARTITION BY domain ORDER BY created DESC, message_id DESC) AS position
          FROM khits WHERE role = 'user' AND rank = 0) WHERE position <= 30
        UNION ALL
        SELECT domain, keyword, position, conversation_title, content, created, source, message_id FROM (
          SELECT *, row_number() OVER (PARTITION BY domain ORDER BY rank, created DESC, message_id DESC) AS position FROM (
            SELECT * FROM (
              SELECT * FROM khits WHERE role = 'user' AND rank > 0
                AND domain NOT IN (SELECT domain FROM khits WHERE role = 'user' AND rank = 0)
              QUALIFY row_number() OVER (PARTITION BY domain, keyword ORDER BY created DESC, message_id DESC) <= 10)
            QUALIFY row_number() OVER (PARTITION BY domain, left(content, 100) ORDER BY rank, created DESC, message_id DESC) = 1))
        WHERE position <= 30""",
    "scols": f"""
        SELECT doc_id, 'conv_' || doc_id AS conversation_id, source, 'Doc ' || doc_id AS title, n_chars % 50 + 1 AS msg_count,
          text AS summary, '["c' || (doc_id % 17) || '","c' || (doc_id % 5) || '"]' AS concepts_j,
          CASE WHEN doc_id % 4 = 3 THEN '[]' ELSE '["d' || (doc_id % 11) || '"]' END AS decisions_j,
          CASE WHEN doc_id % 5 = 0 THEN '[]' WHEN doc_id % 5 = 1 THEN '["none identified"]'
            ELSE '["q' || (doc_id % 13) || '","q' || (doc_id % 7) || '"]' END AS questions_j,
          CASE WHEN doc_id % 3 = 0 THEN 'quote ' || (doc_id % 9) ELSE '' END AS quotable,
          'k' || (doc_id % 6) AS insight, 'domain-' || ((doc_id + 3) % 8) AS connection,
          CASE WHEN doc_id % 10 = 0 THEN 'breakthrough' WHEN doc_id % 3 = 0 THEN 'significant' ELSE 'routine' END AS importance,
          'domain-' || (doc_id % 8) AS domain_primary, {pick(STAGES, 'doc_id % 4')} AS thinking_stage,
          {pick(derive.TONES, 'doc_id % 5')} AS emotional_tone, {pick(derive.PATTERNS, 'doc_id % 7')} AS cognitive_pattern,
          {pick(derive.APPROACHES, 'doc_id % 3')} AS problem_solving_approach,
          {pick(derive.CATEGORIES, 'doc_id % 4')} AS content_category, {minutes('doc_id * 60')} AS summarized_at
        FROM documents""",
    "s": """
        SELECT *, from_json(concepts_j, '["VARCHAR"]') AS concepts, from_json(decisions_j, '["VARCHAR"]') AS decisions,
          list_filter(from_json(questions_j, '["VARCHAR"]'), lambda x: lower(x) <> 'none identified') AS questions,
          CASE WHEN quotable = '' THEN CAST([] AS VARCHAR[]) ELSE [quotable] END AS quotes FROM scols""",
    "sitems": """
        SELECT domain_primary, item, min(ord) AS ord FROM (
          SELECT domain_primary, unnest(questions) AS item,
            {'age': -epoch_us(summarized_at), 'c': conversation_id, 'pos': unnest(range(len(questions)))} AS ord FROM s)
        GROUP BY ALL""",
    "mv": """
        SELECT vec_id AS id, 'conv_' || vec_id || '_0' AS message_id, 'conv_' || vec_id AS conversation_id,
          'Topic ' || label AS conversation_title, 'message ' || vec_id AS content,
          CASE WHEN vec_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, 2020 + vec_id % 5 AS year,
          vec_id % 12 + 1 AS month, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings""",
    "cents": """
        SELECT 'label-' || label AS query_id, list(x ORDER BY pos) AS vector FROM (
          SELECT label, pos, avg(x) AS x FROM (
            SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
          GROUP BY label, pos) GROUP BY label""",
    "dists": """
        SELECT query_id, mv.*, list_sum(list_transform(list_zip(embedding, vector), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance
        FROM mv CROSS JOIN cents""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dists",
    "shits": """
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, conversation_id) AS rank, s.*
        FROM dists JOIN s USING (conversation_id)""",
    "commits": """
        SELECT o_orderkey AS commit_id, 'repo-' || (o_custkey % 20) AS repo_name, o_orderpriority AS message,
          o_orderstatus AS author, CAST(o_orderdate AS TIMESTAMP) AS timestamp FROM orders""",
    "repos": f"""
        SELECT 'repo-' || n AS repo_name, 'repository number ' || n AS description,
          CASE WHEN n % 5 <> 4 THEN {pick(['Python', 'Go', 'Rust', 'SQL'], 'n % 4')} END AS language,
          'https://example.com/repo-' || n AS url, {minutes('n * 7 * 1440')} AS created_at, pushed_at, n % 3 = 0 AS is_private, stars
        FROM (SELECT o_custkey % 20 AS n, count(*) AS stars, CAST(max(o_orderdate) AS TIMESTAMP) AS pushed_at FROM orders GROUP BY 1)""",
    "dt": f"""
        SELECT 'doc-' || doc_id || '.md' AS filename, CASE WHEN doc_id % 6 <> 5 THEN 'Doc ' || doc_id END AS title, text AS content,
          source AS project, {pick(['FIRST_PERSON', 'THIRD_PERSON', 'MIXED'], 'doc_id % 3')} AS voice,
          CASE WHEN quality = 1 AND doc_id % 4 = 0 THEN 'BREAKTHROUGH' ELSE 'STEADY' END AS energy, n_chars % 100 AS depth_score,
          doc_id % 50 AS harvest_score, doc_id % 6 AS decision_count, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS word_count,
          doc_id % 9 AS todos_open, doc_id % 4 AS todos_done, {pick(['draft', 'final'], 'doc_id % 2')} AS draft_status,
          'c' || (doc_id % 17) AS seed_concepts, split_part(text, {NL}, 1) AS first_line, {minutes('doc_id * 60')} AS modified_at
        FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id)""",
    "spend": """
        SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS source, l_extendedprice * (1 - l_discount) AS cost_usd,
          l_quantity AS tokens_total FROM lineitem""",
    "tel": """
        SELECT event_id AS id, ts, 'm' || user_id AS machine_id,
          CASE event_type WHEN 'click' THEN 'tool_called' WHEN 'view' THEN 'first_query' WHEN 'purchase' THEN 'setup_started'
            WHEN 'signup' THEN 'setup_completed' ELSE event_type END AS event,
          CASE WHEN k % 11 <> 10 THEN 'tool-' || (k % 11) END AS tool, value AS latency_ms, 'e' || (k % 3) AS error_type
        FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events)""",
    "l0": f"""
        SELECT n AS id, 't' || (conv_id % 3) AS tenant_id, 'u' || (conv_id % 10) AS owner_user_id, 'src' || (conv_id % 4) AS source,
          'm' || CASE WHEN n % 19 = 0 THEN n // 2 ELSE n END AS message_id, CASE WHEN n % 23 = 0 THEN 'narrator' ELSE role END AS role,
          text AS content, CASE WHEN n % 29 = 0 THEN 'guess' ELSE 'exact' END AS temporal_precision,
          {pick(['private', 'tenant', 'public', 'secret'], 'CASE WHEN n % 13 = 0 THEN 3 ELSE n % 3 END')} AS visibility,
          {minutes('conv_id * 2880 + turn * 5')} AS msg_timestamp FROM (SELECT *, conv_id * 1000 + turn AS n FROM conversations)""",
    "l1": """
        SELECT id * 10 AS id, CASE WHEN id % 37 = 5 THEN -id ELSE id END AS l0_id,
          CASE WHEN id % 31 = 0 THEN 'guess' ELSE 'entity' END AS extraction_type, 'v1' AS extractor_version,
          'private' AS visibility, msg_timestamp AS extracted_at FROM l0""",
    "l2": f"""
        SELECT doc_id AS id, 't' || (doc_id % 3) AS tenant_id, CASE WHEN doc_id % 41 = 0 THEN 'notes' ELSE 'enhanced-extraction-v5' END AS synthesis_type,
          'v5' AS synthesizer_version, 'conv_' || CASE WHEN doc_id % 43 = 0 THEN doc_id + 3 ELSE doc_id END AS conversation_id, text AS summary,
          CASE WHEN doc_id % 47 = 0 THEN 'dreaming' ELSE 'exploring' END AS thinking_stage,
          CASE WHEN doc_id % 53 = 0 THEN 'huge' ELSE 'routine' END AS importance, 'tenant' AS visibility,
          CASE WHEN doc_id % 12 <> 0 AND doc_id % 4 = 1 THEN [doc_id % 100 * 1000] ELSE [] END AS l0_ids,
          CASE WHEN doc_id % 12 <> 0 AND doc_id % 4 <> 1 THEN [doc_id % 100 * 10000, (doc_id % 100 * 1000 + 1) * 10] ELSE [] END AS l1_ids,
          {minutes('doc_id * 60')} AS synthesized_at FROM documents""",
    "l3": f"""
        SELECT doc_id AS id, CASE WHEN doc_id % 59 = 0 THEN 'mood' ELSE 'open-threads' END AS fusion_type, 'tenant' AS visibility,
          CASE WHEN doc_id % 15 = 0 THEN [] ELSE [doc_id, doc_id + 1] END AS l2_ids, {minutes('doc_id * 60 + 30')} AS fused_at FROM documents""",
    "g": f"""
        SELECT conv_id AS c, turn AS t, role, text, conv_id + turn AS n, {minutes('conv_id * 2880 + turn * 5')} AS stamp,
          conv_id || '-' || (turn // {derive.PART}) AS nm, turn % {derive.PART} AS u,
          regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS clean FROM conversations""",
}

_DEPENDS = {
    "m": ["raw_turns"], "nm": ["m"], "hits": ["m", "topics"], "uhits": ["hits"], "khits": ["m", "kw"], "fhits": ["khits"],
    "dsearch": ["khits"], "s": ["scols"], "sitems": ["s"], "dists": ["mv", "cents"], "ranked": ["dists"], "shits": ["dists", "s"],
    "l1": ["l0"],
}


def _closure(names: list[str]) -> list[str]:
    need: set[str] = set()

    def visit(name: str) -> None:
        for other in _DEPENDS.get(name, []):
            visit(other)
        need.add(name)

    for name in names:
        visit(name)
    return [v for v in VIEWS if v in need]


_SQL: dict[str, str] = {}


def _sql(name: str, views: str, body: str) -> None:
    names = _closure(views.split())
    head = "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in names) + " " if names else ""
    _SQL[name] = head + body


_CANON = """source, model, project, conversation_id, conversation_title, year, month, day_of_week, hour, message_id, parent_id, msg_index"""
_sql("canonicalize", "m", f"""
    SELECT {_CANON}, {ts('created')} AS msg_timestamp, CAST(timestamp_is_fallback AS BIGINT) AS timestamp_is_fallback, role,
      'text' AS content_type, CAST(msg_index = 0 AS BIGINT) AS is_first, CAST(0 AS BIGINT) AS is_last, word_count, char_count,
      CAST(0 AS BIGINT) AS conversation_msg_count, CAST(has_code AS BIGINT) AS has_code, CAST(has_url AS BIGINT) AS has_url,
      CAST(has_question AS BIGINT) AS has_question, CAST(0 AS BIGINT) AS has_attachment, CAST(0 AS BIGINT) AS has_citation,
      content, temporal_precision FROM m""")
_sql("finalize", "m", """
    SELECT conversation_id, message_id, i AS msg_index, n AS conversation_msg_count, CAST(i = 0 AS BIGINT) AS is_first,
      CAST(i = n - 1 AS BIGINT) AS is_last FROM (
      SELECT conversation_id, message_id, row_number() OVER (PARTITION BY conversation_id ORDER BY created, message_id) - 1 AS i,
        count(*) OVER (PARTITION BY conversation_id) AS n FROM m)""")
_sql("parse_ts", "g", f"SELECT 'file:///logs/part-' || (c % 7) || '.jsonl' AS path, c * 1000 + t AS pos, {ts('stamp')} AS ts FROM g WHERE n % 16 <> 0")
_sql("normalize_role", "g", """
    SELECT 'file:///c/proj-' || (c % 6) || '/agent-transcripts/tr' || c || '.jsonl' AS path, t AS pos,
      CASE WHEN role IN ('user', 'assistant') THEN role END AS role FROM g""")
_sql("project_name", "g", """
    SELECT DISTINCT 'file:///p/-Users-me-Documents-proj-' || (c % 6) || '/sess' || c || '.jsonl' AS path, 'me-proj-' || (c % 6) AS project FROM g""")
_sql("noise_flag", "nm", "SELECT message_id, drop_reason FROM nm")
_sql("noise_manifest", "nm", """
    SELECT count(*) AS l0_in, count(*) FILTER (drop_reason IS NULL) AS l1_kept, count(*) FILTER (drop_reason IS NOT NULL) AS l1_dropped,
      round(100.0 * count(*) FILTER (drop_reason IS NULL AND role = 'user') / CAST(count(*) FILTER (role = 'user') AS DOUBLE), 1) AS user_yield_pct FROM nm""")
_sql("preview", "m", f"""
    SELECT message_id, {cut('content', 80)} AS cut,
      CASE WHEN length(content) <= 250 THEN content ELSE regexp_replace(left(content, 250), ' [^ ]*$', '') || '...' END AS words FROM m""")
_sql("guess_source", "", """
    SELECT DISTINCT list_extract(['cc_', 'chatgpt_', 'CB_', 'clawdbot-', 'cd_', 'zz_'], conv_id % 6 + 1) || conv_id AS id,
      list_extract(['claude-code', 'chatgpt', 'clawdbot', 'clawdbot', 'claude-desktop', 'unknown'], conv_id % 6 + 1) AS source FROM conversations""")
_sql("match_label", "", """
    SELECT event_id, CASE WHEN x > 0.9 THEN 'Best match' WHEN x >= 0.7 THEN 'Good match' WHEN x >= 0.5 THEN 'Related' ELSE 'Weak match' END AS label,
      CASE WHEN x > 0.9 THEN 'match-best' WHEN x >= 0.7 THEN 'match-good' ELSE 'match-related' END AS css,
      CASE WHEN x >= 0.8 THEN 'sim-high' WHEN x >= 0.6 THEN 'sim-med' ELSE 'sim-low' END AS level
    FROM (SELECT event_id, value / CAST(20 AS DOUBLE) AS x FROM events)""")
_sql("cite", "s", f"SELECT conversation_id, '[' || left(conversation_id, 12) || ' · ' || {day('summarized_at')} || ']' AS mark FROM s")
_sql("json_list", "scols", f"""
    SELECT conversation_id, {joined("from_json(questions_j, '[\"VARCHAR\"]')")} AS questions, quotable AS quotes,
      CASE WHEN quotable = '' THEN '{{"a":1}}' ELSE '[broken' END AS odd FROM scols""")
_sql("domain_keywords", "khits", "SELECT domain, keyword, CAST(rank AS BIGINT) AS rank, count(*) AS hits FROM khits GROUP BY ALL")

_NEW = "created DESC, message_id DESC"


def _top(view: str, keys: str, n: int, where: str = "TRUE", order: str = _NEW) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"SELECT *, row_number() OVER ({part}ORDER BY {order}) AS position FROM {view} WHERE {where} QUALIFY position <= {n}"


_TURN = f"topic, {ts('created')} AS ts, source AS src, conversation_id AS conv_id, role"
_TURN1 = f"{ts('created')} AS ts, source AS src, conversation_id AS conv_id, role"
_sql("kw_search", "hits", f"SELECT {_TURN}, {cut('content', 600)} AS text FROM ({_top('hits', 'topic', 12)})")
_sql("kw_search_batch", "uhits", f"SELECT {_TURN}, {cut('content', 600)} AS text FROM ({_top('uhits', 'topic', 5)})")
_sql("kw_search_wildcards", "m", f"""
    SELECT {_TURN}, {cut('content', 600)} AS text FROM ({_top("(SELECT topic, m.* FROM m JOIN (SELECT unnest(['what%step', 'repo-_']) AS topic) w ON content ILIKE '%' || topic || '%')", 'topic', 12)})""")
_sql("recent", "m", f"SELECT {_TURN1}, {cut('content', 400)} AS text FROM ({_top('m', '', 20, 'created >= (SELECT max(created) FROM m) - INTERVAL 96 HOUR')})")
_sql("kw_search_role", "hits", f"""
    SELECT topic, source, model, conversation_title, {ts('created')} AS created, role, left(content, 200) AS preview, conversation_id
    FROM ({_top('hits', 'topic', 15, "role = 'assistant'")})""")
_sql("recent_questions", "m", f"SELECT source, conversation_title, {ts('created')} AS created, left(content, 300) AS question, conversation_id FROM ({_top('m', '', 15, _ask)})")
_facet = "source = 'src1' AND role = 'user' AND d >= DATE '2024-02-01' AND d <= DATE '2024-06-30'"
_sql("kw_facets", "hits", f"""
    SELECT topic, position, source, conversation_id, conversation_title,
      CASE WHEN length(content) <= 250 THEN content ELSE regexp_replace(left(content, 250), ' [^ ]*$', '') || '...' END AS content_preview,
      role, {ts('created')} AS created FROM ({_top('hits', 'topic', 6, _facet)}) WHERE position > 2""")
_sql("facets", "m", "SELECT DISTINCT source FROM m")
_sql("get_conversation", "m", f"""
    SELECT conversation_id, msg_index, role, content, {ts('created')} AS created, conversation_title, source, model FROM m
    WHERE conversation_id IN ('conv_1', 'conv_7', 'conv_42')""")
_open = " OR ".join(f"contains(lower(content), {lit(t)})" for t in OPEN_TOKENS)
_sql("open_turns", "m", f"""
    SELECT {_TURN1}, content AS text FROM ({_top('m', '', 15, f"role = 'user' AND created >= (SELECT max(created) FROM m) - INTERVAL 14 DAY AND ({_open} OR content LIKE '%?')")})""")
_sql("dropped", "nm", f"""
    SELECT {ts('created')} AS ts, source AS src, conversation_id AS conv_id, drop_reason, {cut('content', 400)} AS text FROM ({_top('nm', '', 12, 'drop_reason IS NOT NULL')})""")
_sql("sample_messages", "m", f"""SELECT left(content, 120) AS preview, conversation_title, source FROM ({_top('m', '', 3, "role = 'user' AND length(content) > 20")})""")
_sql("positions", "uhits", f"""SELECT {_TURN}, content AS text FROM ({_top('(SELECT * FROM uhits QUALIFY row_number() OVER (PARTITION BY topic, left(content, 200) ORDER BY created DESC, message_id DESC) = 1)', 'topic', 10)})""")
_sql("trajectory", "uhits", f"SELECT {_TURN}, content AS text FROM ({_top('uhits', 'topic', 12, order='created, message_id')})")
_sql("tunnel_recent", "hits", f"""
    , act AS (SELECT topic, conversation_id, source, max(created) AS last_ts FROM hits GROUP BY topic, conversation_id, source
      QUALIFY row_number() OVER (PARTITION BY topic ORDER BY last_ts DESC, conversation_id, source) <= 5)
    SELECT {_TURN}, {cut('content', 300)} AS text FROM ({_top('(SELECT * FROM hits SEMI JOIN act USING (topic, conversation_id, source))', 'topic', 15)})""")
_sql("domain_search", "dsearch", f"SELECT domain, keyword, position, conversation_title, {ts('created')} AS created, source, message_id FROM dsearch")
_sql("visible_rows", "l0", """
    SELECT id, owner_user_id, visibility FROM l0 WHERE owner_user_id = 'u3' OR visibility = 'public' OR (visibility = 'tenant' AND tenant_id IN (
      SELECT 't' || (c_nationkey % 3) FROM customer WHERE 'u' || (c_custkey % 50) = 'u3'))""")

_sql("health", "m", f"SELECT coalesce(source, '(all)') AS src, count(*) AS n, {ts('min(created)')} AS first_ts, {ts('max(created)')} AS last_ts FROM m GROUP BY ROLLUP (source)")
_arch = f"count(*) AS messages, count(DISTINCT conversation_id) AS conversations, {ts('min(created)')} AS first_msg, {ts('max(created)')} AS last_msg"
_sql("archive_stats", "m", f"""
    SELECT 'total' AS section, 'all' AS name, {_arch} FROM m UNION ALL SELECT 'source', source, {_arch} FROM m GROUP BY source
    UNION ALL SELECT * FROM (SELECT 'model', model, {_arch} FROM m GROUP BY model ORDER BY count(*) DESC, model LIMIT 10)""")
_sql("overview", "m mv s repos commits dt", """
    SELECT * FROM (SELECT 'domain:' || domain_primary AS metric, count(*) AS value FROM s GROUP BY domain_primary ORDER BY count(*) DESC, domain_primary LIMIT 10)
    UNION ALL SELECT 'messages', count(*) FROM m UNION ALL SELECT 'user_messages', count(*) FROM m WHERE role = 'user'
    UNION ALL SELECT 'vectors', count(*) FROM mv UNION ALL SELECT 'summaries', count(*) FROM s
    UNION ALL SELECT 'breakthroughs', count(*) FROM s WHERE importance = 'breakthrough'
    UNION ALL SELECT 'with_decisions', count(*) FROM s WHERE decisions_j <> '[]' AND decisions_j NOT LIKE '%none identified%'
    UNION ALL SELECT 'with_open_questions', count(*) FROM s WHERE questions_j <> '[]' AND questions_j NOT LIKE '%none identified%'
    UNION ALL SELECT 'topics', count(DISTINCT domain_primary) FROM s UNION ALL SELECT 'repos', count(*) FROM repos
    UNION ALL SELECT 'commits', count(*) FROM commits UNION ALL SELECT 'docs', count(*) FROM dt""")
_conv = f"""SELECT conversation_id, max(conversation_title) AS conversation_title, count(*) AS message_count, CAST(sum(word_count) AS BIGINT) AS total_words,
    count(*) FILTER ({_ask}) AS questions_asked, count(*) FILTER (has_code = 1) AS code_messages FROM m GROUP BY conversation_id"""
_sql("conv_stats", "m", _conv)
_sql("conv_summary", "m", f"""
    SELECT count(*) AS conversations, CAST(sum(message_count) AS BIGINT) AS messages, CAST(sum(total_words) AS BIGINT) AS words,
      CAST(sum(questions_asked) AS BIGINT) AS questions, CAST(sum(code_messages) AS BIGINT) AS code_msgs, round(avg(message_count), 6) AS avg_length,
      count(*) FILTER (message_count >= 100) AS deep_conversations FROM ({_conv})""")
_sql("longest_conversations", "m", f"SELECT conversation_id, conversation_title, message_count FROM ({_conv}) ORDER BY message_count DESC, conversation_id LIMIT 5")
_sql("message_totals", "m", f"""
    SELECT count(*) AS messages, count(DISTINCT conversation_id) AS conversations, count(*) FILTER (role = 'user') AS user_messages,
      count(*) FILTER ({_ask}) AS questions FROM m""")
_sql("timeline_day", "m", f"""
    SELECT {day('d')} AS date, source, conversation_title, msg_count FROM (SELECT d, source, conversation_title, count(*) AS msg_count FROM m GROUP BY d, source, conversation_title
      QUALIFY row_number() OVER (PARTITION BY d ORDER BY msg_count DESC, source, conversation_title) <= 20)""")
_sql("convs_by_date", "m", f"""
    SELECT {day('d')} AS date, source AS src, conversation_id AS conv_id, count(*) AS turns, {ts('min(created)')} AS first_ts, {ts('max(created)')} AS last_ts,
      left(arg_min(content, (created, message_id)) FILTER (role = 'user'), 240) AS first_user_text FROM m GROUP BY ALL""")
_vel = "SELECT topic, {p} AS period, count(*) AS mentions, count(DISTINCT conversation_id) AS conversations FROM uhits GROUP BY ALL"
_month, _quarter = _vel.format(p="period"), _vel.format(p="year || '-Q' || quarter(created)")
_sql("velocity", "uhits", _month)
_sql("velocity_quarter", "uhits", _quarter)
_sql("velocity_trend", "uhits", f"""
    SELECT topic, periods, total_mentions, peak_period, peak_mentions, round(early, 6) AS early_avg, round(late, 6) AS recent_avg,
      CASE WHEN periods < 6 THEN 'insufficient' WHEN late > early * 1.5 THEN 'accelerating' WHEN late < early * 0.5 THEN 'declining' ELSE 'stable' END AS trend
    FROM (SELECT topic, count(*) AS periods, CAST(sum(mentions) AS BIGINT) AS total_mentions, arg_min(period, (-mentions, period)) AS peak_period,
        max(mentions) AS peak_mentions, avg(mentions) FILTER (a <= 3) AS early, avg(mentions) FILTER (b <= 3) AS late
      FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY period) AS a, row_number() OVER (PARTITION BY topic ORDER BY period DESC) AS b FROM ({_month}))
      GROUP BY topic)""")
_sql("first_mention", "uhits", f"""
    SELECT topic, {ts('min(created)')} AS first_created, arg_min(conversation_title, (created, message_id)) AS first_title,
      arg_min(conversation_id, (created, message_id)) AS first_conversation_id, arg_min(source, (created, message_id)) AS source,
      left(arg_min(content, (created, message_id)), 300) AS preview, {ts('max(created)')} AS last_created,
      arg_max(conversation_title, (created, message_id)) AS last_title, CAST(floor((epoch(max(created)) - epoch(min(created))) / 86400) AS BIGINT) AS span_days,
      count(*) AS total_mentions, count(DISTINCT conversation_id) AS total_conversations FROM uhits GROUP BY topic""")
_sql("month_snapshot", "m", f"""
    SELECT month, total_msgs, conversations, user_msgs, questions, round(mean, 6) AS avg_monthly, CAST(floor(round(total_msgs / mean * 100, 6)) AS BIGINT) AS pct_of_avg,
      CASE WHEN total_msgs > mean * 1.5 THEN 'high' WHEN total_msgs > mean * 0.5 THEN 'normal' ELSE 'low' END AS activity
    FROM (SELECT *, avg(total_msgs) OVER () AS mean FROM (SELECT period AS month, count(*) AS total_msgs, count(DISTINCT conversation_id) AS conversations,
      count(*) FILTER (role = 'user') AS user_msgs, count(*) FILTER ({_ask}) AS questions FROM m GROUP BY period))""")
_sql("month_titles", "m", """
    SELECT period AS month, conversation_title, count(*) AS msg_count FROM m GROUP BY period, conversation_title
    QUALIFY row_number() OVER (PARTITION BY period ORDER BY msg_count DESC, conversation_title) <= 7""")
_sql("month_questions", "m", f"SELECT period AS month, left(content, 150) AS question, {ts('created')} AS created FROM ({_top('m', 'period', 5, _ask)})")
_sql("month_sources", "m", "SELECT period AS month, source, count(*) AS n FROM m GROUP BY ALL")
_sql("heatmap", "m", f"SELECT {day('d')} AS date, count(*) AS n FROM m WHERE created >= (SELECT max(d) FROM m) - INTERVAL 100 DAY GROUP BY d")
_sql("heatmap_filled", "m", f"""
    SELECT {day('g.d')} AS date, count(m.message_id) AS n FROM (SELECT CAST(unnest(generate_series((SELECT max(d) FROM m) - INTERVAL 30 DAY,
      CAST((SELECT max(d) FROM m) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d) g LEFT JOIN m ON m.d = g.d GROUP BY g.d""")
_sql("recent_convs", "m", f"""
    SELECT conversation_id, title, {ts('last_date')} AS last_date, message_count FROM (SELECT conversation_id, max(conversation_title) AS title,
      max(created) AS last_date, count(*) AS message_count FROM m GROUP BY conversation_id ORDER BY last_date DESC, conversation_id LIMIT 5)""")
_sql("source_status", "m", f"""
    SELECT coalesce(c.source, x.source) AS source, coalesce(path, '(auto-detected from data)') AS path, path IS NOT NULL AS configured,
      coalesce(messages, 0) AS messages, coalesce(conversations, 0) AS conversations, {ts('last_message')} AS last_message
    FROM (VALUES {rows(q.CONFIGURED)}) c(source, path) FULL JOIN (SELECT source, count(*) AS messages, count(DISTINCT conversation_id) AS conversations,
      max(created) AS last_message FROM m GROUP BY source) x ON c.source = x.source""")
_trans = f"""SELECT conversation_id, arg_min(source, msg_index) AS source, arg_min(conversation_title, msg_index) AS title, count(*) AS msg_count,
    string_agg(role || ': ' || content, {NL} || {NL} ORDER BY msg_index) AS full_text FROM m {{where}} GROUP BY conversation_id HAVING length(full_text) >= 100"""
_sql("transcripts", "m", f"SELECT conversation_id, source, title, msg_count, CAST(0 AS BIGINT) AS part, full_text AS text FROM ({_trans.format(where='')})")
_sql("summarize_pending", "m s", f"""
    SELECT conversation_id, msg_count FROM ({_trans.format(where="WHERE conversation_id NOT IN (SELECT conversation_id FROM s WHERE importance <> 'routine')")})""")
_sql("command_language", "m", "SELECT conversation_id, " + ", ".join(
    f"CAST(sum(len(regexp_extract_all(lower(content), {lit('|'.join(p))}))) AS BIGINT) AS {n}" for n, p in COMMAND_PHRASES.items()
) + " FROM m WHERE role = 'user' GROUP BY conversation_id")
_sql("coverage_progress", "m mv s", """
    SELECT step, total, done, greatest(0, total - done) AS remaining, CASE WHEN total > 0 THEN round(100.0 * done / CAST(total AS DOUBLE), 1) ELSE 0 END AS percent
    FROM (SELECT 'embedding' AS step, (SELECT count(*) FROM m WHERE role = 'user') AS total, (SELECT count(*) FROM mv) AS done
      UNION ALL SELECT 'summary', (SELECT count(DISTINCT conversation_id) FROM m), (SELECT count(*) FROM s))""")
_sql("input_status", "m mv s repos commits", """
    , have AS (SELECT CAST((SELECT count(*) FROM m) > 0 AS BIGINT) AS m, CAST((SELECT count(*) FROM mv) > 0 AS BIGINT) AS v,
      CAST((SELECT count(*) FROM s) > 0 AS BIGINT) AS s, CAST((SELECT count(*) FROM repos) > 0 AS BIGINT) AS r,
      CAST((SELECT count(*) FROM commits) > 0 AS BIGINT) AS c),
    need AS (SELECT 'kw_search' AS operator, 1 AS needs, m AS present FROM have UNION ALL SELECT 'vector_topk', 1, v FROM have
      UNION ALL SELECT 'hybrid', 2, s + v FROM have UNION ALL SELECT 'repo_timeline', 2, r + c FROM have UNION ALL SELECT 'alignment', 2, v FROM have)
    SELECT operator, CAST(needs AS BIGINT) AS needs, present, CASE WHEN present = needs THEN 'ok' WHEN present = 0 THEN 'unavailable' ELSE 'degraded' END AS status FROM need""")

_sql("domain_map", "s", """
    SELECT domain_primary, count(*) AS n, count(*) FILTER (importance = 'breakthrough') AS breakthroughs,
      count(*) FILTER (importance = 'significant') AS significant, round(CAST(100 AS DOUBLE) * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 1) AS pct FROM s GROUP BY domain_primary""")
_sql("distributions", "s", " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, {c} AS value, count(*) AS n FROM s GROUP BY {c}"
    for a, c in [("source", "source"), ("importance", "importance"), ("domain", "domain_primary"), ("stage", "thinking_stage")]))
_sql("top_concepts", "s", """
    SELECT domain_primary, concept, n, row_number() OVER (PARTITION BY domain_primary ORDER BY n DESC, concept) AS position FROM (
      SELECT domain_primary, unnest(concepts) AS concept, count(*) AS n FROM s WHERE domain_primary IN (
        SELECT domain_primary FROM s GROUP BY 1 ORDER BY count(*) DESC, domain_primary LIMIT 5) GROUP BY ALL) QUALIFY position <= 8""".replace(
    "SELECT domain_primary, unnest(concepts) AS concept, count(*) AS n FROM s WHERE", "SELECT domain_primary, concept, count(*) AS n FROM (SELECT domain_primary, unnest(concepts) AS concept FROM s) WHERE"))
_stages = ", ".join(f"count(*) FILTER (thinking_stage = '{x}') AS {x}" for x in STAGES)
_sql("pulse", "s", f"""
    SELECT *, crystallizing > exploring AND crystallizing > 0 AS ready_to_ship, exploring > crystallizing + refining + executing AND exploring > 0 AS still_exploring
    FROM (SELECT domain_primary, {_stages}, count(*) AS total FROM s GROUP BY domain_primary) ORDER BY total DESC, domain_primary LIMIT 25""")
_sql("pulse_domain", "s", "SELECT thinking_stage, count(*) AS n, count(*) FILTER (importance = 'breakthrough') AS breakthroughs FROM s WHERE domain_primary = 'domain-3' GROUP BY 1")


def _flat(field: str) -> str:
    """Entries of one list column of view t in first-seen order without repeats."""
    return f"""(SELECT list(item ORDER BY o) FROM (SELECT item, min(o) AS o FROM (
        SELECT unnest(x.{field}) AS item, x.r * 1000 + unnest(range(len(x.{field}))) AS o FROM newest x WHERE x.domain_primary = b.domain_primary) GROUP BY item))"""


def _all(field: str) -> str:
    """Number of different entries of one list column over all summaries of the domain of view b."""
    return f"(SELECT count(DISTINCT item) FROM (SELECT domain_primary AS d, unnest({field}) AS item FROM s) WHERE d = b.domain_primary)"


_newest = """, newest AS (SELECT *, [insight] AS insights_l, [connection] AS connections_l,
    row_number() OVER (PARTITION BY domain_primary ORDER BY summarized_at DESC, conversation_id) AS r FROM s QUALIFY r <= {n})"""
_sql("domain_state", "s", _newest.format(n=10) + f"""
    SELECT domain_primary, conversations, stage, tone, pattern, approach, breakthroughs, significant, {_all('questions')} AS n_open_questions,
      coalesce({joined('qs[1:10]')}, '') AS open_questions, {_all('decisions')} AS n_decisions, coalesce({joined('ds[1:7]')}, '') AS decisions,
      {_all('concepts')} AS n_concepts, {joined('list_sort(cs)[1:15]')} AS concepts, {joined('ins[1:5]')} AS insights, {joined('list_sort(con)[1:10]')} AS connections,
      {joined('stage_counts')} AS stage_counts, {joined('sources')} AS sources
    FROM (SELECT domain_primary, conversations, stage, tone, pattern, approach, breakthroughs, significant, {_flat('questions')} AS qs, {_flat('decisions')} AS ds,
        {_flat('concepts')} AS cs, {_flat('insights_l')} AS ins, {_flat('connections_l')} AS con, sources,
        (SELECT list(z ORDER BY z) FROM (SELECT thinking_stage || ':' || count(*) AS z FROM s x WHERE x.domain_primary = b.domain_primary GROUP BY thinking_stage)) AS stage_counts
      FROM (SELECT domain_primary, (SELECT count(*) FROM s x WHERE x.domain_primary = newest.domain_primary) AS conversations, arg_min(thinking_stage, r) AS stage, arg_min(emotional_tone, r) AS tone,
          arg_min(cognitive_pattern, r) AS pattern, coalesce(nullif(arg_min(problem_solving_approach, r), ''), 'unknown') AS approach,
          (SELECT count(*) FROM s x WHERE x.domain_primary = newest.domain_primary AND importance = 'breakthrough') AS breakthroughs,
          (SELECT count(*) FROM s x WHERE x.domain_primary = newest.domain_primary AND importance = 'significant') AS significant,
          list(title || ' [' || left(conversation_id, 12) || ' · ' || {day('summarized_at')} || ']' ORDER BY r) AS sources FROM newest GROUP BY domain_primary) b) b""")
_sql("domain_brief", "s", _newest.format(n=15) + f"""
    SELECT domain_primary, conversations, stage, tone, {_all('questions')} AS n_open_questions, coalesce({joined('qs[1:10]')}, '') AS open_questions,
      coalesce({joined('ds[1:7]')}, '') AS decisions, {joined('ins[1:5]')} AS insights, left(us[1], 200) AS quote
    FROM (SELECT domain_primary, conversations, stage, tone, {_flat('questions')} AS qs, {_flat('decisions')} AS ds, {_flat('insights_l')} AS ins, {_flat('quotes')} AS us
      FROM (SELECT domain_primary, (SELECT count(*) FROM s x WHERE x.domain_primary = newest.domain_primary) AS conversations, arg_min(thinking_stage, r) AS stage, arg_min(emotional_tone, r) AS tone FROM newest GROUP BY domain_primary) b) b""")
_sql("domain_brief_items", "s", _newest.format(n=5) + f"""
    SELECT domain_primary, r AS position, left(title, 60) AS title, source, msg_count, importance, {cut('summary', 300)} AS summary,
      '[' || left(conversation_id, 12) || ' · ' || {day('summarized_at')} || ']' AS citation FROM newest""")
_heads = """, heads AS (SELECT domain_primary, count(*) AS n_questions, list(item ORDER BY ord)[1:5] AS qs FROM sitems GROUP BY domain_primary),
    per AS (SELECT domain_primary, count(*) AS conversations, count(*) FILTER (importance = 'breakthrough') AS breakthroughs,
      max(CASE importance WHEN 'breakthrough' THEN 3 WHEN 'significant' THEN 2 ELSE 1 END) AS rnk,
      arg_max(thinking_stage, (summarized_at, conversation_id)) AS stage FROM s GROUP BY domain_primary)"""
_sql("dormant", "sitems", _heads + f"""
    SELECT domain_primary, conversations, breakthroughs, stage, n_questions, {joined('qs')} AS questions FROM per JOIN heads USING (domain_primary)
    WHERE rnk >= 2 ORDER BY breakthroughs DESC, n_questions DESC, conversations DESC, domain_primary LIMIT 20""")
_sql("open_threads", "sitems", _heads + f"""
    SELECT domain_primary, conversations, breakthroughs, n_questions, {joined('qs')} AS questions FROM per JOIN heads USING (domain_primary)
    ORDER BY breakthroughs DESC, n_questions DESC, domain_primary LIMIT 20""")
_sql("domain_history", "s", """
    , pairs AS (SELECT domain_primary, unnest([{'a': 'stage', 'v': thinking_stage}, {'a': 'importance', 'v': importance}, {'a': 'source', 'v': source},
        {'a': 'pattern', 'v': cognitive_pattern}, {'a': 'approach', 'v': problem_solving_approach}, {'a': 'tone', 'v': emotional_tone}]
        || list_transform(concepts, lambda c: {'a': 'concept', 'v': c})) AS p FROM s),
    counted AS (SELECT domain_primary, p.a AS attribute, p.v AS value, count(*) AS n FROM pairs WHERE p.v <> '' GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY domain_primary, attribute ORDER BY n DESC, value) AS position FROM counted),
    tot AS (SELECT domain_primary, count(*) AS conversations FROM s GROUP BY 1)
    SELECT domain_primary, attribute, value, n, position, conversations, round(100.0 * n / CAST(conversations AS DOUBLE), 1) AS pct FROM placed JOIN tot USING (domain_primary)
    WHERE position <= CASE attribute WHEN 'concept' THEN 10 WHEN 'pattern' THEN 7 WHEN 'approach' THEN 7 WHEN 'tone' THEN 5 ELSE position END""")
_switches = """, switches AS (SELECT DISTINCT current, target FROM (SELECT lag(domain_primary) OVER (PARTITION BY source ORDER BY summarized_at, conversation_id) AS current,
    domain_primary AS target FROM s) WHERE current <> target)"""
_sql("domain_switches", "s", _switches + " SELECT current, target FROM switches")
_sql("switch_cost", "sitems", _switches + """
    , qn AS (SELECT domain_primary, count(*) AS questions FROM sitems GROUP BY 1), con AS (SELECT DISTINCT domain_primary, unnest(concepts) AS c FROM s),
    cn AS (SELECT domain_primary, count(*) AS concepts FROM con GROUP BY 1),
    fact AS (SELECT s1.*, coalesce(questions, 0) AS questions, coalesce(concepts, 0) AS concepts FROM (
      SELECT domain_primary, count(*) AS conversations, arg_max(thinking_stage, (summarized_at, conversation_id)) AS stage FROM s GROUP BY 1) s1
      LEFT JOIN qn USING (domain_primary) LEFT JOIN cn USING (domain_primary)),
    x AS (SELECT current, target, a.stage, a.questions, a.concepts AS current_concepts, b.conversations AS target_conversations, b.concepts AS target_concepts,
      (SELECT count(*) FROM con p JOIN con r ON p.c = r.c WHERE p.domain_primary = current AND r.domain_primary = target) AS shared
      FROM switches JOIN fact a ON a.domain_primary = current JOIN fact b ON b.domain_primary = target),
    y AS (SELECT *, greatest(0, least(1, round(least(questions / 10, 1) * CAST(0.35 AS DOUBLE) + CAST(CASE stage WHEN 'executing' THEN 0.8 WHEN 'refining' THEN 0.6 WHEN 'crystallizing' THEN 0.4
      WHEN 'exploring' THEN 0.2 ELSE 0.3 END AS DOUBLE) * CAST(0.35 AS DOUBLE) - least(shared / greatest(current_concepts, 1), 1) * CAST(0.3 AS DOUBLE), 3))) AS score FROM x)
    SELECT current, target, stage, questions, current_concepts, target_conversations, target_concepts, shared, score,
      CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.6 THEN 'moderate' ELSE 'high' END AS band FROM y""")


def _patterns(scope: str) -> str:
    return f"""
    , pairs AS (SELECT {scope} AS scope, importance, unnest([{{'a': 'pattern', 'v': cognitive_pattern}}, {{'a': 'approach', 'v': problem_solving_approach}},
        {{'a': 'tone', 'v': emotional_tone}}, {{'a': 'category', 'v': content_category}}]) AS p FROM s),
    counted AS (SELECT scope, p.a AS attribute, p.v AS value, count(*) AS n, count(*) FILTER (importance = 'breakthrough') AS breakthroughs FROM pairs WHERE p.v <> '' GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY scope, attribute ORDER BY n DESC, value) AS position,
      row_number() OVER (PARTITION BY scope, attribute ORDER BY breakthroughs DESC, n DESC, value) = 1 AND breakthroughs > 0 AS best FROM counted),
    tot AS (SELECT {scope} AS scope, count(*) AS c FROM s GROUP BY 1)
    SELECT scope, attribute, value, n, breakthroughs, position, best, round(100.0 * n / CAST(c AS DOUBLE), 1) AS pct FROM placed JOIN tot USING (scope)
    WHERE best OR position <= CASE attribute WHEN 'pattern' THEN 10 WHEN 'approach' THEN 10 ELSE 8 END"""


_sql("patterns", "s", _patterns("'(all)'"))
_sql("patterns_by_domain", "s", _patterns("domain_primary"))
_sql("coverage", "s", """
    SELECT *, CASE WHEN conversations > 5000 THEN 'good' ELSE 'partial' END AS coverage_status, CASE WHEN domains > 15 THEN 'good' ELSE 'partial' END AS breadth_status,
      CASE WHEN breakthroughs > 10 THEN 'good' ELSE 'partial' END AS depth_status, CASE WHEN domains_with_questions > 10 THEN 'attention' ELSE 'good' END AS threads_status
    FROM (SELECT count(*) AS conversations, count(DISTINCT domain_primary) AS domains, count(*) FILTER (importance = 'breakthrough') AS breakthroughs,
      CAST(sum(len(questions)) AS BIGINT) AS open_questions, CAST(sum(len(decisions)) AS BIGINT) AS decisions,
      count(DISTINCT domain_primary) FILTER (len(questions) > 0) AS domains_with_questions FROM s)""")
_sql("domain_coverage", "s", """
    SELECT domain_primary, count(*) AS n, arg_max(thinking_stage, (summarized_at, conversation_id)) AS stage, count(*) FILTER (importance = 'breakthrough') AS breakthroughs,
      bool_or(len(questions) > 0) AS has_open_questions FROM s GROUP BY domain_primary ORDER BY n DESC, domain_primary LIMIT 15""")
_sql("unfinished", "s", f"""
    SELECT conversation_id, title, source, domain_primary, thinking_stage, importance, msg_count, left(summary, 200) AS summary, CAST(len(questions) AS BIGINT) AS n_questions,
      {joined('questions[1:3]')} AS questions FROM s WHERE thinking_stage IN ('exploring', 'crystallizing') AND importance IN ('breakthrough', 'significant') AND len(questions) > 0
    ORDER BY importance, msg_count DESC, conversation_id LIMIT 25""")

_titles = """(SELECT list(conversation_title ORDER BY p, conversation_title)[1:10] FROM (SELECT conversation_title, min(position) AS p FROM {v} x WHERE x.domain = b.domain GROUP BY 1))"""
_sql("domain_state_raw", "dsearch", f"""
    SELECT domain, matches, questions, conversations, {joined(_titles.format(v='dsearch'))} AS titles FROM (SELECT domain, count(*) AS matches,
      count(*) FILTER (contains(content, '?')) AS questions, count(DISTINCT conversation_title) AS conversations FROM (
        SELECT DISTINCT domain, message_id, content, conversation_title FROM khits WHERE role = 'user'
          AND (rank = 0 OR domain NOT IN (SELECT domain FROM khits WHERE role = 'user' AND rank = 0))) GROUP BY domain) b""")
_sql("dormant_raw", "m", f"""
    SELECT conversation_title, {ts('last_active')} AS last_active, msgs, questions FROM (SELECT conversation_title, max(created) AS last_active, count(*) AS msgs,
      count(*) FILTER ({_ask}) AS questions FROM m GROUP BY 1 HAVING questions > 0 ORDER BY last_active, conversation_title LIMIT 20)""")
_brief = f", brief AS ({_top('fhits', 'domain', 50)})"
_sql("domain_brief_raw", "fhits", _brief + f"""
    SELECT domain, keyword, matches, conversations, questions, {joined(_titles.format(v='brief'))} AS titles FROM (SELECT domain, keyword, count(*) AS matches,
      count(DISTINCT conversation_title) AS conversations, count(*) FILTER (role = 'user' AND contains(content, '?')) AS questions FROM fhits GROUP BY ALL) b""")
_sql("domain_brief_raw_items", "fhits", _brief + " SELECT domain, position, conversation_title, source, role, left(content, 300) AS preview FROM brief WHERE position <= 10")
_sql("domain_history_raw", "fhits", f"SELECT domain, keyword, year, month, source, count(*) AS msgs, count(*) FILTER ({_ask}) AS questions FROM fhits GROUP BY ALL")
_sql("switch_cost_raw", "m", f"""
    , pairs AS (SELECT * FROM (VALUES {rows(q.PAIRS)}) t(current, target)), names AS (SELECT DISTINCT current AS name FROM pairs UNION SELECT target FROM pairs),
    h AS (SELECT name, m.* FROM m JOIN names ON {HIT2.format('name')}),
    f AS (SELECT name, count(*) AS msgs, count(*) FILTER ({_ask}) AS questions, max(created) AS last_active FROM h GROUP BY name),
    x AS (SELECT current, target, a.msgs, a.questions, a.last_active, b.msgs AS target_msgs, (SELECT count(DISTINCT conversation_title) FROM h WHERE name = current
      AND conversation_title IN (SELECT conversation_title FROM h WHERE name = target)) AS shared_titles
      FROM pairs JOIN f a ON a.name = current JOIN f b ON b.name = target),
    y AS (SELECT *, greatest(0, least(1, round(least(questions / 10, 1) * CAST(0.4 AS DOUBLE) + least(msgs / 100, CAST(0.5 AS DOUBLE)) * CAST(0.3 AS DOUBLE)
      - least(shared_titles / greatest(msgs / 10, 1), 1) * CAST(0.3 AS DOUBLE), 3))) AS score FROM x)
    SELECT current, target, msgs, questions, {ts('last_active')} AS last_active, target_msgs, shared_titles, score,
      CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.6 THEN 'moderate' ELSE 'high' END AS band FROM y""")


def _activity(view: str, scope: str) -> str:
    one = f"SELECT {scope} AS scope, 'total' AS section, '{{n}}' AS name, {{v}} AS value FROM {view} GROUP BY ALL"
    parts = [one.format(n=n, v=v) for n, v in [
        ("messages", "count(*)"), ("questions", f"count(*) FILTER ({_ask})"), ("sources", "count(DISTINCT source)"),
        ("conversations", "count(DISTINCT conversation_title)")]]
    parts.append(f"""SELECT * FROM (SELECT {scope} AS scope, 'month' AS section, period AS name, count(*) AS value FROM {view} GROUP BY 1, period
        QUALIFY row_number() OVER (PARTITION BY {scope} ORDER BY value DESC, period) <= 5)""")
    parts.append(f"SELECT {scope}, 'source', source, count(*) FROM {view} GROUP BY ALL")
    return " UNION ALL ".join(parts)


_sql("activity_raw", "m", _activity("m", "'(all)'"))
_sql("activity_raw_domains", "fhits", _activity("fhits", "domain"))
_sql("open_threads_raw", "m", f"""
    , r AS (SELECT * FROM m WHERE {_ask}),
    p AS (SELECT conversation_title, count(*) AS questions FROM r GROUP BY 1 ORDER BY max((created, message_id)) DESC LIMIT 20)
    SELECT conversation_title AS title, questions, position, left(content, 200) AS question, {ts('created')} AS created
    FROM ({_top('r', 'conversation_title', 5)}) JOIN p USING (conversation_title)""")
_sql("coverage_raw", "m mv", f"""
    SELECT count(*) AS messages, count(DISTINCT conversation_title) AS conversations, count(DISTINCT source) AS sources, {ts('min(created)')} AS first_msg, {ts('max(created)')} AS last_msg,
      count(*) FILTER ({_ask}) AS questions, (SELECT count(*) FROM mv) AS vectors, CASE WHEN (SELECT count(*) FROM mv) > 0 THEN 'good' ELSE 'missing' END AS vector_status FROM m""")
_sql("position_raw", "uhits", f"""
    SELECT topic, 'mention' AS kind, conversation_title, left(content, 300) AS preview, {ts('created')} AS "at", CAST(NULL AS DOUBLE) AS similarity
    FROM ({_top('(SELECT * FROM uhits QUALIFY row_number() OVER (PARTITION BY topic, conversation_id ORDER BY created DESC, message_id DESC) = 1)', 'topic', 10)})""")

_sql("project_mentions", "m repos", f"""
    , p AS (SELECT unnest(['repo-1', 'repo-7', 'python']) AS project),
    pc AS (SELECT project, arg_min(created_at, repo_name) AS project_created FROM p JOIN repos ON contains(lower(repo_name), project) GROUP BY 1)
    SELECT project, conversation_title, left(content, 250) AS preview, {ts('created')} AS created, conversation_id, {ts('project_created')} AS project_created,
      coalesce(created < project_created, FALSE) AS predates_project
    FROM ({_top("(SELECT p.project, m.* EXCLUDE (project) FROM m JOIN p ON " + HIT2.format('p.project') + " WHERE role = 'user')", 'project', 10)}) LEFT JOIN pc USING (project)""")
_sql("date_validity", "m repos", f"""
    , f AS (SELECT conversation_id, max(conversation_title) AS conversation_title, min(created) AS first_msg, count(*) AS msg_count,
      max(timestamp_is_fallback) AS has_fallback FROM m GROUP BY 1),
    pr AS (SELECT DISTINCT conversation_id, repo_name, created_at FROM m JOIN repos ON regexp_matches(content, '(?i)\\b' || repo_name || '\\b') WHERE role = 'user'),
    j AS (SELECT conversation_id, count(*) FILTER (first_msg < created_at) AS conflicts, count(*) FILTER (first_msg >= created_at) AS valid_references,
      max(created_at) FILTER (first_msg < created_at) AS earliest, max(floor((epoch(created_at) - epoch(first_msg)) / 86400)) FILTER (first_msg < created_at) AS before
      FROM pr JOIN f USING (conversation_id) GROUP BY 1)
    SELECT conversation_id, conversation_title, {ts('first_msg')} AS first_msg, msg_count, CAST(has_fallback AS BIGINT) AS has_fallback, coalesce(conflicts, 0) AS conflicts,
      coalesce(valid_references, 0) AS valid_references, {day('earliest')} AS earliest_valid_date, CAST(before AS BIGINT) AS max_days_before,
      CASE WHEN conflicts > 0 THEN 'likely incorrect' WHEN has_fallback = 1 THEN 'uncertain' ELSE 'likely valid' END AS verdict FROM f LEFT JOIN j USING (conversation_id)""")
_sql("repo_timeline", "repos commits", f"""
    , p AS (SELECT unnest(['repo-1', 'repo-7']) AS project),
    ch AS (SELECT * FROM repos JOIN p ON contains(lower(repo_name), project) QUALIFY row_number() OVER (PARTITION BY project ORDER BY created_at DESC, repo_name) <= 5),
    co AS (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY timestamp DESC, commit_id DESC) AS pos FROM commits QUALIFY pos <= 10)
    SELECT project, repo_name, {ts('created_at')} AS created_at, {ts('pushed_at')} AS pushed_at, description, language, is_private, stars, url, pos AS commit_position,
      {ts('timestamp')} AS committed_at, left(message, 60) AS message, author FROM ch LEFT JOIN co USING (repo_name)""")
_sql("repo_activity", "commits", """
    SELECT repo_name, strftime(timestamp, '%Y-%m') AS month, count(*) AS commits, repo_name AS project FROM commits GROUP BY repo_name, strftime(timestamp, '%Y-%m')
    QUALIFY row_number() OVER (PARTITION BY repo_name ORDER BY month DESC) <= 6""")
_sql("repo_stats", "repos commits", f"""
    SELECT count(*) AS repos, count(*) FILTER (is_private) AS private, count(*) FILTER (NOT is_private) AS public, {ts('min(created_at)')} AS first_created,
      {ts('max(pushed_at)')} AS last_pushed, (SELECT count(*) FROM commits) AS commits, (SELECT count(DISTINCT repo_name) FROM commits) AS repos_with_commits,
      (SELECT {ts('min(timestamp)')} FROM commits) AS first_commit, (SELECT {ts('max(timestamp)')} FROM commits) AS last_commit FROM repos""")
_sql("repo_languages", "repos", "SELECT language, count(*) AS n FROM repos WHERE language IS NOT NULL GROUP BY 1 ORDER BY n DESC, language LIMIT 10")
_sql("citation_chain", "l0 l1 l2 l3", f"""
    , c2 AS (SELECT l3.id AS l3_id, l2.* FROM (SELECT id, unnest(l2_ids) AS x FROM l3) l3 JOIN l2 ON l2.id = x),
    c1 AS (SELECT l3_id, l1.* FROM (SELECT l3_id, unnest(l1_ids) AS x FROM c2) JOIN l1 ON l1.id = x),
    c0 AS (SELECT l3_id, l0.* FROM (SELECT l3_id, l0_id AS x FROM c1 UNION ALL SELECT l3_id, unnest(l0_ids) FROM c2) JOIN l0 ON l0.id = x)
    SELECT id AS l3_id, 'L3' AS layer, id AS row_id, NULL AS preview, {ts('fused_at')} AS "at" FROM l3
    UNION ALL SELECT l3_id, 'L2', id, left(summary, 200), {ts('synthesized_at')} FROM c2
    UNION ALL SELECT l3_id, 'L1', id, NULL, {ts('extracted_at')} FROM c1
    UNION ALL SELECT l3_id, 'L0', id, left(content, 200), {ts('msg_timestamp')} FROM c0""")
_sql("alignment", "m", f"""
    , w AS (SELECT DISTINCT message_id AS decision_id, unnest(regexp_split_to_array(lower(content), '\\s+')) AS word FROM m WHERE {_ask}),
    dw AS (SELECT DISTINCT word FROM w WHERE length(word) > 4),
    f AS (SELECT word, item_id FROM dw JOIN benchmark ON contains(lower('Principle ' || item_id || ' ' || text), word)),
    p AS (SELECT DISTINCT decision_id, item_id FROM w JOIN f USING (word)),
    r AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY item_id) AS rank FROM p QUALIFY rank <= 3)
    SELECT decision_id, rank, 'Principle ' || item_id AS name, left(text, 200) AS definition FROM r JOIN benchmark USING (item_id)""")


def _rule(layer: str, view: str, rule: str, bad: str) -> str:
    return f"SELECT '{layer}' AS layer, id AS row_id, '{rule}' AS rule FROM {view} WHERE {bad}"


def _dupe(layer: str, view: str, keys: str) -> str:
    return f"SELECT '{layer}', min(id), 'unique {keys}' FROM {view} GROUP BY {keys} HAVING count(*) > 1"


_vis = f"visibility NOT IN {among(VISIBILITIES)}"
_sql("layer_violations", "l0 l1 l2 l3", " UNION ALL ".join([
    _rule("L0", "l0", "role", f"role NOT IN {among(ROLES)}"), _rule("L0", "l0", "temporal_precision", f"temporal_precision NOT IN {among(PRECISIONS)}"),
    _rule("L0", "l0", "visibility", _vis), _dupe("L0", "l0", "tenant_id,source,message_id"),
    _rule("L1", "l1", "extraction_type", f"extraction_type NOT IN {among(EXTRACTION_TYPES)}"), _rule("L1", "l1", "visibility", _vis),
    _dupe("L1", "l1", "l0_id,extraction_type,extractor_version"), _rule("L1", "l1", "l0_id missing", "l0_id NOT IN (SELECT id FROM l0)"),
    _rule("L2", "l2", "synthesis_type", f"synthesis_type NOT IN {among(SYNTHESIS_TYPES)}"), _rule("L2", "l2", "thinking_stage", f"thinking_stage NOT IN {among(STAGES)}"),
    _rule("L2", "l2", "importance", f"importance NOT IN {among(IMPORTANCE)}"), _rule("L2", "l2", "visibility", _vis),
    _rule("L2", "l2", "citations", "len(l0_ids) = 0 AND len(l1_ids) = 0"), _dupe("L2", "l2", "tenant_id,synthesis_type,synthesizer_version,conversation_id"),
    _rule("L3", "l3", "fusion_type", f"fusion_type NOT IN {among(FUSION_TYPES)}"), _rule("L3", "l3", "visibility", _vis), _rule("L3", "l3", "citations", "len(l2_ids) = 0"),
]))
_SQL["reply_tree"] = "WITH RECURSIVE " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in ["raw_turns", "m"]) + f"""
    , walk AS (SELECT conversation_id, message_id, parent_id, 0 AS depth, role, created FROM m x
        WHERE parent_id IS NULL OR NOT EXISTS (SELECT 1 FROM m y WHERE y.conversation_id = x.conversation_id AND y.message_id = x.parent_id)
      UNION ALL SELECT c.conversation_id, c.message_id, c.parent_id, w.depth + 1, c.role, c.created FROM walk w JOIN m c ON c.conversation_id = w.conversation_id AND c.parent_id = w.message_id)
    SELECT conversation_id, message_id, parent_id, CAST(depth AS BIGINT) AS depth, role, {ts('created')} AS ts FROM walk"""
_sql("dedupe_messages", "m", f"SELECT message_id, {ts('created')} AS created FROM m")

_doc = "filename, project, voice, energy, depth_score, harvest_score, decision_count, word_count"
_deep = "depth_score DESC, harvest_score DESC, filename"
_sql("docs_search", "dt", f"""
    SELECT topic, position, {_doc}, left(first_line, 100) AS first_line FROM ({_top("(SELECT * FROM dt JOIN (SELECT unnest(['the', 'doc 1', 'der']) AS topic) t ON contains(lower(content), topic) OR contains(lower(title), topic) OR contains(lower(filename), topic))", 'topic', 15, order=_deep)})""")
_sql("docs_breakthrough", "dt", f"SELECT filename, project, depth_score, harvest_score, decision_count, word_count, left(first_line, 120) AS first_line FROM dt WHERE energy = 'BREAKTHROUGH' ORDER BY {_deep} LIMIT 20")
_sql("docs_deep", "dt", "SELECT filename, project, voice, energy, depth_score, harvest_score, decision_count, seed_concepts, word_count FROM dt WHERE depth_score >= 70 ORDER BY depth_score DESC, filename LIMIT 20")
_sql("docs_project", "dt", "SELECT filename, voice, energy, depth_score, harvest_score, decision_count, todos_open, word_count, left(first_line, 100) AS first_line FROM dt WHERE project = 'src3' ORDER BY depth_score DESC, filename LIMIT 20")
_todo = "SELECT filename, project, todos_open, todos_done, CAST(CASE WHEN todos_open + todos_done > 0 THEN round_even(100.0 * todos_done / (todos_open + todos_done), 0) ELSE 0 END AS BIGINT) AS pct_done, draft_status, depth_score FROM dt WHERE {w} ORDER BY todos_open DESC, filename LIMIT 20"
_sql("docs_todos", "dt", _todo.format(w="todos_open > 5"))
_sql("docs_todos_project", "dt", _todo.format(w="project = 'src3' AND todos_open > 0"))
_sql("docs_stats", "dt", """
    SELECT count(*) AS files, CAST(sum(word_count) AS BIGINT) AS words, count(*) FILTER (voice = 'FIRST_PERSON') AS first_person, count(*) FILTER (energy = 'BREAKTHROUGH') AS breakthrough,
      count(*) FILTER (depth_score >= 70) AS deep, CAST(sum(decision_count) AS BIGINT) AS decisions, CAST(sum(todos_open) AS BIGINT) AS todos_open FROM dt""")

_sql("daily_facts", "m commits spend", f"""
    , a AS (SELECT d, count(*) AS n FROM m WHERE role = 'user' GROUP BY 1), b AS (SELECT d, count(*) AS n FROM (SELECT min(d) AS d FROM m GROUP BY conversation_id) GROUP BY 1),
    c AS (SELECT CAST(timestamp AS DATE) AS d, count(*) AS n FROM commits GROUP BY 1), e AS (SELECT date AS d, sum(cost_usd) AS cost, sum(tokens_total) AS tok FROM spend GROUP BY 1),
    k AS (SELECT d FROM a UNION SELECT d FROM b UNION SELECT d FROM c UNION SELECT d FROM e)
    SELECT {day('d')} AS date, year(d) AS year, quarter(d) AS quarter, month(d) AS month, strftime(d, '%A') AS day_of_week, isodow(d) >= 6 AS is_weekend,
      coalesce(a.n, 0) AS messages_sent, coalesce(b.n, 0) AS convos_started, CAST(0 AS BIGINT) AS videos_watched, coalesce(c.n, 0) AS commits_made,
      round(coalesce(cost, 0), 4) AS cost_total, CAST(coalesce(tok, 0) AS BIGINT) AS tokens_used, coalesce(a.n, 0) > 0 OR coalesce(c.n, 0) > 0 AS was_active
    FROM k LEFT JOIN a USING (d) LEFT JOIN b USING (d) LEFT JOIN c USING (d) LEFT JOIN e USING (d)""")
_sql("daily_focus", "m", f"""
    , w AS (SELECT d, word, count(*) AS n FROM (SELECT d, unnest(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM m WHERE role = 'user')
      WHERE length(word) >= 4 AND word NOT IN {among(STOP_WORDS)} GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY n DESC, word) AS p, sum(n) OVER (PARTITION BY d) AS total FROM w)
    SELECT {day('d')} AS date, max(word) FILTER (p = 1) AS top_keyword, array_to_string(list(word ORDER BY p), ' | ') AS keywords,
      round(max(n) FILTER (p = 1) / CAST(max(total) AS DOUBLE), 6) AS focus_score FROM r WHERE p <= 5 GROUP BY d""")
_sql("tech_stacks", "m", f"""
    , u AS (SELECT date_trunc('month', d) AS mo, tech, count(*) AS n FROM (SELECT DISTINCT message_id, d, unnest(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_]+')) AS tech FROM m)
      WHERE tech IN {among(TECHNOLOGIES)} GROUP BY ALL),
    a AS (SELECT mo, count(*) AS stack_count, arg_min(tech, (-n, tech)) AS dominant_stack, list(tech ORDER BY tech) AS techs FROM u GROUP BY mo),
    b AS (SELECT *, coalesce(lag(techs) OVER (ORDER BY mo), []) AS before FROM a)
    SELECT {day('mo')} AS month_start, stack_count, dominant_stack, array_to_string(list_filter(techs, lambda x: NOT list_contains(before, x)), ' | ') AS new_adoptions,
      array_to_string(list_filter(before, lambda x: NOT list_contains(techs, x)), ' | ') AS abandonments, {joined('techs')} AS all_techs FROM b""")
_sql("problems", "s", f"""
    SELECT {day("date_trunc('month', summarized_at)")} AS month_start, count(*) AS chain_count, array_to_string(list_sort(list(DISTINCT domain_primary)), ' | ') AS domains,
      array_to_string(list_sort(list(DISTINCT importance)), ' | ') AS difficulties, array_to_string(list_sort(list(DISTINCT cognitive_pattern)), ' | ') AS debugging_patterns,
      min(title) AS hardest_problem, max(title) AS aha_quotes FROM s GROUP BY date_trunc('month', summarized_at) ORDER BY 1 DESC LIMIT 12""")
_sql("spend", "spend", """
    SELECT CASE WHEN grouping(mo) = 1 THEN '(all)' ELSE mo END AS month, CASE WHEN grouping(source) = 1 THEN '(all)' ELSE source END AS source,
      round(sum(cost_usd), 4) AS cost_usd, CAST(sum(tokens_total) AS BIGINT) AS tokens_total FROM (SELECT strftime(date, '%Y-%m') AS mo, * FROM spend) GROUP BY ROLLUP (mo, source)""")
_sql("spend_daily", "spend", f"""
    SELECT {day('date')} AS date, source, round(sum(cost_usd), 4) AS cost_usd, CAST(sum(tokens_total) AS BIGINT) AS tokens_total FROM spend
    WHERE strftime(date, '%Y-%m') = '1998-05' GROUP BY spend.date, source""")
_sql("tool_popularity", "tel", """
    SELECT tool, count(*) AS calls, count(DISTINCT machine_id) AS users, round(avg(latency_ms), 6) AS avg_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms
    FROM tel WHERE event = 'tool_called' AND tool IS NOT NULL GROUP BY tool""")
_sql("funnel", "tel", "SELECT event, count(*) AS total, count(DISTINCT machine_id) AS unique_machines FROM tel WHERE event IN ('setup_started', 'setup_completed', 'setup_failed', 'first_query') GROUP BY event")
_sql("error_rates", "tel", f"SELECT tool, error_type, count(*) AS n, {ts('min(ts)')} AS first_seen, {ts('max(ts)')} AS last_seen FROM tel WHERE event = 'error' GROUP BY tool, error_type")
_sql("weekly_growth", "tel", f"""
    SELECT {day("date_trunc('week', ts)")} AS week, count(DISTINCT machine_id) AS active_machines, count(DISTINCT machine_id) FILTER (event = 'setup_completed') AS new_installs,
      count(*) FILTER (event = 'tool_called') AS total_tool_calls FROM tel GROUP BY date_trunc('week', ts)""")

_near = "query_id, rank, id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity"
_sql("vector_topk", "ranked", f"SELECT {_near} FROM ranked WHERE rank <= 10")
_sql("vector_topk_filtered", "dists", f"""
    SELECT {_near} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dists WHERE role = 'user' AND year >= 2021)
    WHERE rank > 3 AND rank <= 8 AND 1 / (1 + distance) >= 0.3""")
_sql("vector_ann", "ranked", "SELECT query_id, true AS found FROM ranked WHERE rank <= 10 GROUP BY query_id")
_sql("vector_stats", "mv", "SELECT year, count(*) AS n, CAST(max(len(embedding)) AS BIGINT) AS dim FROM mv GROUP BY year")
_sql("dim_check", "mv", """
    SELECT CAST(min(len(embedding)) AS BIGINT) AS min_dim, CAST(max(len(embedding)) AS BIGINT) AS max_dim, count(*) AS vectors, count(*) FILTER (len(embedding) <> 64) AS mismatched,
      count(*) FILTER (len(embedding) <> 64) = 0 AS ok FROM mv""")
_sql("embed_pending", "nm mv", """
    SELECT message_id, piece, conversation_id, conversation_title, substr(content, piece * 8000 + 1, 8000) AS content, role, year, month
    FROM (SELECT *, unnest(range(greatest(1, CAST(ceil(length(content) / 8000) AS BIGINT)))) AS piece FROM nm
      WHERE role = 'user' AND drop_reason IS NULL AND message_id NOT IN (SELECT message_id FROM mv) AND length(content) >= 10)""")
_sql("summary_texts", "s", """
    SELECT conversation_id, piece, substr(summary, piece * 2000 + 1, 2000) AS text
    FROM (SELECT *, unnest(range(greatest(1, CAST(ceil(length(summary) / 2000) AS BIGINT)))) AS piece FROM s WHERE length(summary) > 10)""")
_bm25 = """
    , qs AS (SELECT * FROM (VALUES {queries}) t(query_id, query)),
    asked AS (SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}_]+')) AS term FROM qs),
    words AS (SELECT conversation_id AS id, list_filter(regexp_split_to_array(lower(summary), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS w FROM s {where}),
    tot AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
    post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    idf AS (SELECT term, ln(1 + ((SELECT n FROM tot) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term),
    scored AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT mean FROM tot)))), 9) AS score
      FROM post JOIN asked USING (term) JOIN idf USING (term) GROUP BY ALL),
    texthits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)"""
_sql("bm25", "s", _bm25.format(queries=rows(q.TEXT_QUERIES), where="") + " SELECT query_id, rank, id, round(score, 6) AS score FROM texthits WHERE rank <= 10")
_sql("bm25_index", "s", _bm25.format(queries=rows(q.TEXT_QUERIES), where="") + " SELECT query_id, rank, id, round(score, 6) AS score FROM texthits WHERE rank <= 10")
_labelled = [(f"label-{i}", text) for i, (_, text) in enumerate(q.TEXT_QUERIES)]
_sql("hybrid", "shits", _bm25.format(queries=rows(_labelled), where="") + """
    , fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.conversation_id) AS id, a.rank AS text_rank, b.rank AS vector_rank,
      round(coalesce(1 / (CAST(60 AS DOUBLE) + a.rank), 0) + coalesce(1 / (CAST(60 AS DOUBLE) + b.rank), 0), 9) AS score
      FROM (SELECT * FROM texthits WHERE rank <= 30) a FULL JOIN (SELECT * FROM shits WHERE rank <= 30) b ON a.query_id = b.query_id AND a.id = b.conversation_id)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, text_rank, vector_rank, score FROM fused QUALIFY rank <= 10""")
_sql("search_summaries", "s", _bm25.format(queries=rows(q.TEXT_QUERIES), where="WHERE importance = 'significant'") + f"""
    SELECT query_id, rank, round(score, 6) AS score, conversation_id, left(title, 80) AS title, left(summary, 400) AS summary, domain_primary, thinking_stage,
      source, importance, {joined('concepts[1:8]')} AS concepts
    FROM texthits JOIN s ON s.conversation_id = id WHERE rank <= 10""")
_hashed = """
    , tx AS ({texts}),
    tw AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS w FROM tx),
    tb AS (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS bucket, count(*) AS n FROM tw GROUP BY ALL),
    te AS (SELECT id, bucket, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS v FROM tb)"""
_nearest = _hashed + """,
    qx AS (SELECT * FROM (VALUES {queries}) t(query_id, query)),
    qw AS (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS w FROM qx),
    qb AS (SELECT query_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS bucket, count(*) AS n FROM qw GROUP BY ALL),
    qe AS (SELECT query_id, bucket, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS FLOAT) AS DOUBLE) AS v FROM qb),
    tn AS (SELECT tx.id, coalesce(sum(v * v), 0) AS s FROM tx LEFT JOIN te ON te.id = tx.id GROUP BY tx.id),
    qn AS (SELECT qx.query_id, coalesce(sum(v * v), 0) AS s FROM qx LEFT JOIN qe USING (query_id) GROUP BY qx.query_id),
    dots AS (SELECT qe.query_id, te.id, sum(qe.v * te.v) AS p FROM qe JOIN te USING (bucket) GROUP BY ALL),
    apart AS (SELECT qn.query_id, tn.id, round(qn.s + tn.s - 2 * coalesce(p, 0), 9) AS distance FROM qn CROSS JOIN tn
      LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.id = tn.id),
    near AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, 1 / (1 + distance) AS similarity FROM apart)"""
_sql("hash_embed", "m", _hashed.format(texts="SELECT message_id AS id, content AS text FROM m") + " SELECT id AS message_id, bucket, round(v, 6) AS weight FROM te")
for _name, _view, _texts in [
    ("semantic_search", "m", "SELECT message_id AS id, content AS text FROM m"), ("docs_semantic", "dt", "SELECT filename AS id, content AS text FROM dt"),
    ("commits_semantic", "commits", "SELECT commit_id AS id, message AS text FROM commits"),
]:
    _sql(_name, _view, _nearest.format(texts=_texts, queries=rows(q.TEXT_QUERIES)) + " SELECT query_id, rank, id, round(similarity, 6) AS similarity FROM near WHERE rank <= 10")
_sql("position_raw_full", "m uhits", _nearest.format(
    texts="SELECT message_id AS id, content AS text FROM m WHERE role = 'user'", queries=rows([(t, t) for t in q.TOPICS])) + f"""
    SELECT topic, 'mention' AS kind, conversation_title, left(content, 300) AS preview, {ts('created')} AS "at", CAST(NULL AS DOUBLE) AS similarity
    FROM ({_top('(SELECT * FROM uhits QUALIFY row_number() OVER (PARTITION BY topic, conversation_id ORDER BY created DESC, message_id DESC) = 1)', 'topic', 10)})
    UNION ALL SELECT query_id, 'semantic', conversation_title, left(content, 250), NULL, round(similarity, 6) FROM near JOIN m ON message_id = id WHERE rank <= 10""")
_significant = _nearest.format(texts="SELECT conversation_id AS id, summary AS text FROM s WHERE importance = 'significant'", queries=rows(q.TEXT_QUERIES))
_sql("search_summaries_vector", "s", _significant + " SELECT query_id, rank, id AS conversation_id, round(similarity, 6) AS score FROM near WHERE rank <= 10")
_sql("search_summaries_hybrid", "s", _bm25.format(queries=rows(q.TEXT_QUERIES), where="WHERE importance = 'significant'") + _significant + """,
    f AS (SELECT query_id, id, coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0) AS score
      FROM (SELECT * FROM texthits WHERE rank <= 30) a FULL JOIN (SELECT * FROM near WHERE rank <= 30) b USING (query_id, id)),
    g AS (SELECT query_id, id, round(score, 9) AS score FROM f)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id AS conversation_id, round(score, 6) AS score FROM g QUALIFY rank <= 10""")
_sql("extract_items", "shits", """
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS position, left(item, 250) AS item, title, domain_primary, importance, conversation_id
    FROM (SELECT *, unnest(questions) AS item, unnest(range(len(questions))) AS pos FROM shits WHERE rank <= 10) QUALIFY position <= 8""")
_uni = [("label-0", "high"), ("label-1", "the"), ("label-2", "repo-7")]
_sql("unified", "ranked commits dt", f"""
    , qs AS (SELECT * FROM (VALUES {rows(_uni)}) t(query_id, query)),
    a AS (SELECT query_id, 'conversation' AS kind, conversation_title AS title, content, year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS date,
      round(1 / (1 + distance), 9) AS score, CAST(id AS VARCHAR) AS key FROM ranked WHERE rank <= 5),
    b AS (SELECT query_id, 'github' AS kind, repo_name || ': ' || left(message, 80) AS title, message AS content, {day('timestamp')} AS date, CAST(0.4 AS DOUBLE) AS score,
      CAST(commit_id AS VARCHAR) AS key FROM commits JOIN qs ON contains(lower(message), query) OR contains(lower(repo_name), query)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY timestamp DESC, commit_id DESC) <= 3),
    c AS (SELECT query_id, 'markdown' AS kind, coalesce(title, filename) AS title, left(content, 500) AS content, {day('modified_at')} AS date, CAST(0.45 AS DOUBLE) AS score,
      filename AS key FROM dt JOIN qs ON contains(lower(content), query) OR contains(lower(title), query) OR contains(lower(filename), query)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY depth_score DESC, filename) <= 3)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, key) AS rank, kind, title, {cut('content', 150)} AS preview, date, round(score, 6) AS score
    FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) QUALIFY rank <= 15""")


def _kind(kind: str, field: str, cap: int, width: int, dedupe: bool) -> str:
    once = "QUALIFY row_number() OVER (PARTITION BY query_id, lower(left(item, 80)) ORDER BY place, pos) = 1" if dedupe else ""
    listed_ = f"SELECT * FROM (SELECT *, unnest({field}) AS item, unnest(range(len({field}))) AS pos FROM top) {once}"
    return f"""SELECT query_id, '{kind}' AS kind, row_number() OVER (PARTITION BY query_id ORDER BY place, pos) AS position, left(item, {width}) AS text, title, citation
        FROM ({listed_}) QUALIFY position <= {cap}"""


_sql("position_summary", "shits", f"""
    , top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE importance WHEN 'breakthrough' THEN 0 WHEN 'significant' THEN 1 ELSE 2 END, rank) AS place,
      '[' || left(conversation_id, 12) || ' · ' || {day('summarized_at')} || ']' AS citation FROM shits WHERE rank <= 20)
    SELECT query_id, 'summary' AS kind, row_number() OVER (PARTITION BY query_id ORDER BY place) AS position, {cut('summary', 300)} AS text, title, citation FROM top
      WHERE summary <> '' QUALIFY position <= 5
    UNION ALL {_kind('decision', 'decisions', 10, 200, True)} UNION ALL {_kind('question', 'questions', 8, 200, True)} UNION ALL {_kind('quote', 'quotes', 5, 250, False)}""")
_sql("precedents", "shits", f"""
    SELECT query_id, rank, title, domain_primary, thinking_stage, source, importance, {cut('summary', 350)} AS summary, {joined('decisions[1:3]')} AS decisions, conversation_id
    FROM shits WHERE rank <= 10""")
_sql("stage_progress", "shits", f"""
    SELECT query_id, CAST(list_position({listed(STAGES)}, thinking_stage) AS BIGINT) AS stage_order, thinking_stage, rank, title, importance, domain_primary FROM shits WHERE rank <= 20""")
_sql("related_by_period", "ranked", """
    , r AS (SELECT *, year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS p FROM ranked WHERE rank <= 20),
    k AS (SELECT query_id, p, count(*) AS related FROM r GROUP BY query_id, p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p DESC) <= 4)
    SELECT query_id, p AS period, related, row_number() OVER (PARTITION BY query_id, p ORDER BY rank) AS position, conversation_title AS title, left(content, 150) AS preview,
      round(1 / (1 + distance), 6) AS similarity FROM r JOIN k USING (query_id, p) QUALIFY position <= 2""")


def _ingested(source: str, model: str, project: str, conv: str, title: str, mid: str, order: str, role: str, at: str, precision: str, content: str, where: str, part: str | None = None) -> str:
    part = part or conv
    return f"""SELECT {lit(source)} AS source, {model} AS model, {project} AS project, {conv} AS conversation_id, {title} AS conversation_title, {mid} AS message_id, i AS msg_index,
        cnt AS conversation_msg_count, CAST(i = 0 AS BIGINT) AS is_first, CAST(i = cnt - 1 AS BIGINT) AS is_last, {role} AS role, {ts(at)} AS msg_timestamp,
        {lit(precision)} AS temporal_precision, {content} AS content
      FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {part}) AS cnt FROM g WHERE {where})"""


_chat = "role IN ('user', 'assistant')"
_generic = _ingested("custom", "CASE WHEN c % 2 = 0 THEN 'm1' END", "CAST(NULL AS VARCHAR)", "'g' || c", "CASE WHEN c % 5 <> 0 THEN 'Topic ' || (c % 25) ELSE 'part-' || (c % 7) END",
    "'g' || c || '_' || i", "t", "CASE WHEN n % 10 = 0 THEN 'user' ELSE role END", "stamp", "exact", "clean",
    "n % 16 <> 0 AND n % 14 <> 0 AND (role <> 'system' OR n % 10 = 0) AND length(clean) > 0", "c")
_sql("ingest_generic", "g", _generic)
_sess_where = f"{_chat} AND length(clean) >= 5 AND lower(clean) NOT IN ('warmup', 'prompt is too long', 'request interrupted') AND NOT (role = 'user' AND length(text) < 15) AND NOT (role = 'assistant' AND length(text) < 10)"
_sessions = _ingested("claude-code", "'m2'", "'me-proj-' || (c % 6)", "'cc_local_' || CASE WHEN c % 3 <> 0 THEN 's' || c ELSE 'sess' || c END", "'me-proj-' || (c % 6)",
    "'u' || c || '-' || t", "t", "role", "stamp", "day", "clean", _sess_where, "c")
_sql("ingest_sessions", "g", _sessions)
_agent_views = """
    , mods AS (SELECT c, t, 'model' || (t % 2) AS model FROM g WHERE t % 3 = 0 AND c % 2 = 0),
    seen AS (SELECT g.*, (SELECT arg_max(x.model, (x.c, x.t)) FROM mods x WHERE x.c % 40 = g.c % 40 AND (x.c < g.c OR (x.c = g.c AND x.t <= g.t))) AS model,
      (SELECT max(x.c) FROM g x WHERE x.t = 0 AND x.c % 40 = g.c % 40 AND x.c <= g.c) AS sess FROM g) """
_agents = _ingested("clawdbot", "coalesce(model, 'unknown')", "CAST(NULL AS VARCHAR)", "CASE WHEN sess IS NULL THEN 'run' || (c % 40) ELSE 'agent' || sess END",
    "'Clawdbot ' || left('run' || (c % 40), 8)", "'a' || c || '-' || t", "c, t", "role", "stamp", "exact", "clean",
    f"{_chat} AND length(clean) > 0 AND c % 40 <> 39").replace(" FROM g WHERE", " FROM seen WHERE")
_sql("ingest_forward_fill", "g", _agent_views + _agents)
_transcript = _ingested("cursor", "CAST(NULL AS VARCHAR)", "'proj-' || (c % 6)", "'cursor_agent_tr' || c", "'Cursor Agent: proj-' || (c % 6)",
    "CASE WHEN c % 2 = 0 THEN 'tr' || c || '_' || (t // 1000) || '_' || t ELSE 'x' || c || '-' || t END", "t", "role", "stamp", "exact", "clean", f"{_chat} AND length(clean) >= 5", "c")
_sql("ingest_transcript", "g", _transcript)
_exp_at = "(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(c * 2880 + (t // 2) * 5 AS BIGINT)))"
_exp_parent = "CASE WHEN t = 0 THEN 'root' ELSE 'n' || CASE WHEN t % 3 = 2 THEN t - 2 ELSE t - 1 END END"


def _export(source: str, prefix: str, order: str) -> str:
    return _ingested(source, "'m3'", "CAST(NULL AS VARCHAR)", f"'{prefix}e' || nm", "'Topic ' || (c % 25)", "'n' || t", order, "role", "e_at", "exact", "clean",
                     f"{_chat} AND length(clean) >= 5", "nm").replace(" FROM g WHERE", f" FROM (SELECT *, {_exp_at} AS e_at, (u // 3) * 2 + CASE WHEN u % 3 = 0 THEN 0 ELSE 1 END AS depth FROM g) WHERE")


_sql("ingest_export", "g", _export("chatgpt", "chatgpt_", "e_at, t"))
_sql("ingest_export_arrays", "g", _export("chatgpt", "chatgpt_", "e_at, t"))
_sql("ingest_export_tree", "g", _export("chatgpt-export", "chatgpt_export_", "e_at, depth, t"))
_gtitle = "(SELECT rtrim(left(x.text, 80)) || CASE WHEN length(x.text) > 80 THEN '...' ELSE '' END FROM g x WHERE x.nm = y.nm AND x.role = 'user' ORDER BY x.t LIMIT 1)"
_gemini = _ingested("gemini-cli", "CAST(NULL AS VARCHAR)", "'gemini-' || left('hash' || nm, 12)", "'gemini_cli_s' || nm", f"coalesce({_gtitle}, 'Gemini CLI ' || left('s' || nm, 8))",
    "CASE WHEN t % 2 = 0 THEN 'i' || t ELSE 's' || nm || '_' || u END", "t", "role", "stamp", "exact", "clean", f"{_chat} AND length(clean) >= 3", "nm").replace(" FROM g WHERE", " FROM g WHERE") + " y"
_sql("ingest_gemini", "g", _gemini)
_kv_conv = "CASE WHEN c % 2 = 0 THEN 'cursor_tab' || nm ELSE 'cursor_composer_k' || nm END"
_kv_chats = _ingested("cursor", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", _kv_conv, "CASE WHEN c % 2 = 0 THEN 'Cursor Chat' ELSE 'Topic ' || nm END",
    f"{_kv_conv} || '_' || u", "t", "role", "stamp", "exact", "clean", f"{_chat} AND length(clean) >= CASE WHEN c % 2 = 0 THEN 1 ELSE 5 END", "nm")
_sql("ingest_kv_chats", "g", _kv_chats)
_sql("ingest_all", "g", _agent_views + f"""
    SELECT source, count(*) AS messages, count(DISTINCT conversation_id) AS conversations, max(msg_timestamp) AS last_message
    FROM ({_generic} UNION ALL {_sessions} UNION ALL {_transcript} UNION ALL {_gemini} UNION ALL {_agents}
      UNION ALL {_kv_chats} UNION ALL {_export("chatgpt", "chatgpt_", "e_at, t")} UNION ALL {_export("chatgpt-export", "chatgpt_export_", "e_at, depth, t")}) GROUP BY source""")
_sql("summaries_from_records", "", """
    SELECT conversation_id, source, title, msg_count, text AS summary, '{}' AS command_language, '[]' AS corrections_json, '[]' AS temporal_facts_json,
      CASE WHEN old THEN '[]' ELSE '[{"from":"c' || (doc_id % 17) || '","to":"c' || (doc_id % 5) || '","relation":"' || CASE WHEN doc_id % 7 = 0 THEN 'causes' ELSE 'implements' END
        || '","confidence":' || CASE WHEN doc_id % 9 = 0 THEN '0.3' ELSE '0.8' END || '}]' END AS edges_json,
      CASE WHEN old THEN '[]' ELSE '[{"kind":"' || CASE WHEN doc_id % 8 = 0 THEN 'poem' ELSE 'quote' END || '","content":"'
        || CASE WHEN doc_id % 6 = 0 THEN 'short' ELSE 'a text that is long enough' END || '"}]' END AS assets_json,
      array_to_string(cs, ' | ') AS concepts, d AS decisions, CASE WHEN old THEN '' ELSE q1 || ' | ' || q2 END AS open_questions,
      CASE WHEN old THEN 'significant' ELSE 'routine' END AS importance, 'domain-' || (doc_id % 8) AS domain_primary, CASE WHEN old THEN '' ELSE 'exploring' END AS thinking_stage,
      CASE WHEN old THEN '' ELSE 'when needed' END AS resurface_when, text || CASE WHEN len(cs) > 0 THEN '. Concepts: ' || array_to_string(cs, ', ') ELSE '' END || '. Decisions: ' || d
        || CASE WHEN old THEN '' ELSE '. Open questions: ' || q1 || '; ' || q2 || '. Resurface: when needed' END AS embedding_text, left(md5(text), 16) AS summary_hash
    FROM (SELECT *, 'conv_' || doc_id AS conversation_id, 'Doc ' || doc_id AS title, doc_id % 40 AS msg_count, doc_id % 3 = 0 AS old, 'd' || (doc_id % 11) AS d,
      'q' || (doc_id % 13) AS q1, 'q' || (doc_id % 7) AS q2, list_transform(range(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 7 END), lambda x: 'c' || (doc_id % 17)) AS cs FROM documents)""")
_sql("record_violations", "", """
    SELECT 'conv_' || doc_id AS conversation_id, rule FROM (SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 7 > 5 THEN 'concepts > 5' END, CASE WHEN doc_id % 7 = 0 THEN 'edge relation' END,
      CASE WHEN doc_id % 9 = 0 THEN 'edge confidence' END, CASE WHEN doc_id % 8 = 0 THEN 'asset kind' END, CASE WHEN doc_id % 6 = 0 THEN 'asset content' END], lambda x: x IS NOT NULL)) AS rule
      FROM documents WHERE doc_id % 3 <> 0)""")
_sql("concept_edges", "", """
    SELECT concept, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT 'c' || (doc_id % 17) AS concept, 1 AS o, 0 AS i FROM documents WHERE doc_id % 3 <> 0
      UNION ALL SELECT 'c' || (doc_id % 5), 0, 1 FROM documents WHERE doc_id % 3 <> 0) GROUP BY concept""")
_sql("stream_event_counts", "tel", f"""
    SELECT {ts('window_start')} AS window_start, event, count(*) AS n FROM (SELECT *, date_trunc('day', ts) AS window_start FROM tel) GROUP BY ALL""")
_sql("stream_tool_popularity", "tel", f"""
    SELECT {ts('window_start')} AS window_start, tool, count(*) AS calls, true AS users_within, true AS p95_within
    FROM (SELECT *, date_trunc('day', ts) AS window_start FROM tel WHERE event = 'tool_called' AND tool IS NOT NULL) GROUP BY ALL""")
_sql("ingest_incremental", "g", f"SELECT conversation_id, message_id, msg_index, conversation_msg_count, role, msg_timestamp, content FROM ({_generic})")
_sql("stream_ingest", "g", f"SELECT conversation_id, role, msg_timestamp, content FROM ({_generic})")
_sql("stream_vectors", "nm", "SELECT message_id, CAST(64 AS BIGINT) AS dim FROM nm WHERE role = 'user' AND drop_reason IS NULL AND length(content) >= 10")
_sql("stream_unique_messages", "", f"SELECT event_id AS message_id, {ts('ts')} AS msg_timestamp, event_type AS source FROM events")


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
