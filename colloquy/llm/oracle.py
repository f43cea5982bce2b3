"""DuckDB SQL for the queries of this package that SQL can express."""

ORACLE: dict[str, str] = {
    "op4_pivot_topk": """
        WITH v AS (
          SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
              FROM v AS q JOIN v ON v.r <> q.r AND len(v.e) = len(q.e) WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_near_dedup": r"""
        WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        n AS (SELECT text, min(doc_id) AS node, count(*) AS copies FROM t GROUP BY text),
        w AS (SELECT node, string_split(trim(regexp_replace(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w FROM n),
        s AS (SELECT node, array_to_string(w[i:i + 4], ' ') AS shingle FROM
                (SELECT node, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w) WHERE len(w) > 1 OR w[1] <> ''),
        m AS (SELECT node, shingle, count(*) AS often FROM s GROUP BY ALL),
        z AS (SELECT node, sum(often) AS size FROM m GROUP BY node),
        o AS (SELECT a.node AS a, b.node AS b, sum(least(a.often, b.often)) AS shared FROM m AS a JOIN m AS b ON a.shingle = b.shingle AND a.node < b.node GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN z AS x ON x.node = a JOIN z AS y ON y.node = b WHERE shared >= 0.8 * (x.size + y.size - shared)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT node, node AS class FROM n UNION SELECT e.b, r.class FROM r JOIN e ON e.a = r.node),
        c AS (SELECT node, min(class) AS class FROM r GROUP BY node),
        d AS (SELECT t.doc_id, c.class FROM t JOIN n ON n.text = t.text JOIN c ON c.node = n.node)
        SELECT doc_id, class AS class_id, count(*) OVER (PARTITION BY class) AS class_size, doc_id = class AS kept FROM d""",
    "op8_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        WINDOW same AS (PARTITION BY norm)""",
    "op11_filter_audit": r"""
        WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
        b AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT doc_id, part, concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
            CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
            CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END) AS fails FROM w),
        m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN b USING (doc_id) GROUP BY ALL),
        p AS (SELECT '' AS o UNION ALL SELECT o || x FROM p, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(x) WHERE position(x IN o) = 0),
        s AS (SELECT o, step, o[step] AS x, left(o, step - 1) AS before FROM p, range(1, 6) AS r(step) WHERE length(o) = 5),
        g AS (SELECT part, o AS filter_order, step, x,
            coalesce(sum(n) FILTER (translate(fails, before || x, '') = fails), 0) AS kept,
            coalesce(sum(n) FILTER (contains(fails, x) AND translate(fails, before, '') = fails), 0) AS removed,
            coalesce(sum(n) FILTER (contains(fails, x) AND translate(fails, before, '') <> fails), 0) AS redundant,
            coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails,
            coalesce(sum(good) FILTER (contains(fails, x) AND translate(fails, before, '') = fails), 0) AS good_lost,
            coalesce(sum(toxic) FILTER (contains(fails, x) AND translate(fails, before, '') = fails), 0) AS toxic_lost
          FROM m, s GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
          CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
          CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM g""",
    "op12_substring": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id,
              list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT r, id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM (SELECT r, id, w, unnest(range(1, len(w) - 48)) AS i FROM t)),
        h AS (SELECT r, i FROM (SELECT r, id, i, min(id) OVER (PARTITION BY s) AS least FROM s) WHERE least < id),
        c AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM h),
        k AS (SELECT r, p, w FROM (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS w FROM t) ANTI JOIN c USING (r, p)),
        g AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS kept, count(*) AS n FROM k GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM t LEFT JOIN g USING (r)""",
    "op13_merkle": r"""
        WITH RECURSIVE v AS (SELECT doc_id, lang, list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
              lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
              lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, 4294967295) AS crc,
            coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
              || coalesce(strlen(lang) || ':' || lang, '-') AS head, CAST(n_chars AS VARCHAR) AS n, CAST(n_chars + 1 AS VARCHAR) AS more,
            coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
        h AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n) || ':' || n, '-') || tail) AS leaf,
            CASE WHEN n IS NOT NULL AND xor(crc, 4294967295) % 7 = 0 THEN sha256(head || coalesce(strlen(more) || ':' || more, '-') || tail) END AS tampered FROM v),
        l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, row_number() OVER () AS r FROM h),
        t AS (SELECT lang, 0 AS level, list(leaf ORDER BY p) AS d FROM l GROUP BY lang
            UNION ALL SELECT lang, level + 1, list_transform(range(0, len(d), 2), lambda i: sha256(d[i + 1] || coalesce(d[i + 2], ''))) FROM t WHERE len(d) > 1),
        s AS (SELECT lang, level AS height, d[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM t WHERE len(d) = 1),
        u AS (SELECT 0 AS level, list(subroot ORDER BY k) AS d FROM s
            UNION ALL SELECT level + 1, list_transform(range(0, len(d), 2), lambda i: sha256(d[i + 1] || coalesce(d[i + 2], ''))) FROM u WHERE len(d) > 1),
        a AS (SELECT r, level AS step, p >> level AS q, d FROM l JOIN t ON t.lang IS NOT DISTINCT FROM l.lang WHERE len(d) > 1
            UNION ALL SELECT r, height + level, k >> level, d FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang, u WHERE len(d) > 1),
        b AS (SELECT r, step, q % 2 = 1 AS odd, d[xor(q, 1) + 1] AS sibling FROM a),
        c AS (SELECT r, string_agg(sibling, '' ORDER BY step) AS proof, list(CASE WHEN odd THEN 'R' ELSE 'L' END || coalesce(sibling, '') ORDER BY step) AS path FROM b GROUP BY r),
        z AS (SELECT doc_id, leaf, subroot, (SELECT d[1] FROM u WHERE len(d) = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
            list_reduce(coalesce(path, []), lambda x, y: sha256(CASE WHEN y[1] = 'R' THEN y[2:] || x ELSE x || y[2:] END), coalesce(tampered, leaf)) AS folded_root
          FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN c USING (r))
        SELECT *, folded_root = root AS verified FROM z""",
}


def _secret_spans() -> str:
    """Base spans by the three patterns, then hulls of high-entropy windows of long strings that are not allow-listed."""
    assign = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    patterns = [("assign", assign), ("access", "AKIA[A-Z0-9]{16,}"), ("hex", "[0-9a-f]{24,}"), ("candidate", "[A-Za-z0-9+/_=-]{20,}")]
    found = " UNION ALL ".join(
        f"SELECT r, '{kind}' AS kind, {i} AS o, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS b FROM d" for i, (kind, p) in enumerate(patterns))
    windows = " UNION ALL ".join(
        f"""SELECT r, start + i - 1 AS start, '{kind}' AS kind, {o} AS o, {width} AS width, {least} AS least, substr(m, i, {width}) AS w
            FROM (SELECT *, unnest(generate_series(1, length(m) - {width - 1})) AS i FROM c) WHERE regexp_full_match(substr(m, i, {width}), '[{chars}]*')"""
        for kind, o, width, least, chars in [("entropy_hex", 3, 20, 3.0, "0-9A-Fa-f"), ("entropy_base64", 4, 24, 3.9, "A-Za-z0-9+/_=-")])
    two = "substr({0}, 3) = left({0}, length({0}) - 2)"
    cut = "left(m, length(m) - 1)"
    repeated = f"CASE WHEN length(m) % 2 = 1 THEN {two.format(cut)} ELSE {two.format('m')} OR {cut} = repeat(left(m, 1), length(m) - 1) END"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        f AS ({found}),
        u AS (SELECT r, kind, o, unnest(m) AS m, unnest(b[1:len(m)]) AS b, unnest(range(len(m))) AS i FROM f),
        s AS (SELECT *, CAST(sum(length(b) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop FROM u),
        p AS (SELECT r, kind, o, m, stop - length(m) AS start, stop FROM s WHERE kind <> 'assign' OR length(regexp_extract(m, '{assign}', 2)) >= 6),
        base AS (SELECT r, kind, o, start, stop FROM p WHERE kind <> 'candidate'),
        c AS (SELECT row_number() OVER () AS n, * FROM p WHERE kind = 'candidate' AND NOT regexp_matches(m, '^[A-Za-z/_=-]+$') AND NOT regexp_matches(m, '^[0-9/_=-]+$')
          AND NOT regexp_matches(m, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$') AND NOT ({repeated})
          AND NOT regexp_matches(m, '(?i)example|sample|placeholder|dummy|xxxxxx|1234567890|abcdefghij')),
        w AS ({windows.replace("SELECT r,", "SELECT n, r,")}),
        g AS (SELECT n, r, start, kind, o, width, least, w, unnest(string_split(w, '')) AS ch FROM w),
        h AS (SELECT n, r, start, kind, o, width, least, ch, count(*) AS k FROM g GROUP BY ALL),
        e AS (SELECT n, r, kind, o, width, start FROM h GROUP BY n, r, kind, o, width, start, least HAVING log2(width) - sum(k * log2(k)) / width >= least),
        hull AS (SELECT r, kind, o, min(start) AS start, max(start) + width AS stop FROM e GROUP BY n, r, kind, o, width),
        first AS (SELECT * FROM hull x WHERE o = 3 AND NOT EXISTS (SELECT 1 FROM base y WHERE y.r = x.r AND y.start < x.stop AND x.start < y.stop)),
        one AS (SELECT r, kind, o, start, stop FROM base UNION ALL SELECT r, kind, o, start, stop FROM first),
        second AS (SELECT * FROM hull x WHERE o = 4 AND NOT EXISTS (SELECT 1 FROM one y WHERE y.r = x.r AND y.start < x.stop AND x.start < y.stop)),
        every AS (SELECT * FROM one UNION ALL SELECT r, kind, o, start, stop FROM second),
        l AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (o < 3), '') AS based,
            string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans FROM every GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
          sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN l USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {**ORACLE, "op1_secrets": _secret_spans()}
