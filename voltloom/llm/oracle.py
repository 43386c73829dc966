"""DuckDB SQL for the queries that SQL can express on whole tables."""

_TOPK = """
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS query_row, q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), d AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < d.keep, false) AS dropped FROM k LEFT JOIN d USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
"""

_PHRASES = r"""
WITH t AS (
  SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x, item_id FROM benchmark
), i AS (
  SELECT item_id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t
), v AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         array_to_string(w[k : k + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM i WHERE len(w) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), n AS (SELECT DISTINCT n FROM v), g AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, n WHERE len(w) >= n)
), m AS (SELECT g.doc_id, g.k, g.n, v.item_id FROM g JOIN v ON g.n = v.n AND g.phrase = v.phrase),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(c, ',' ORDER BY c) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS c FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(s.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""

_AUDIT = r"""
WITH RECURSIVE o(filter_order) AS (
  SELECT '' UNION ALL
  SELECT filter_order || f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(filter_order, f)
), d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e FROM documents
), m AS (
  SELECT part, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
         doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS bad,
         (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM d
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM m GROUP BY part, fails
), s AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f,
         coalesce(sum(n) FILTER (first = 0 OR first > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (first = step), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (first < step AND first > 0 AND contains(fails, substr(filter_order, step, 1))), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = substr(filter_order, step, 1)), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (first = step), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (first = step), 0)::BIGINT AS toxic_lost
  FROM (SELECT c.*, filter_order, CASE WHEN fails = '' THEN 0 ELSE list_min(list_transform(string_split(fails, ''), lambda x: instr(filter_order, x))) END AS first
        FROM c, o WHERE length(filter_order) = 5), (SELECT unnest(range(1, 6))::INTEGER AS step)
  GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM s
"""

_TRIE = """
WITH RECURSIVE crc AS (
  SELECT i, 0 AS k, i AS v FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8
), tab AS (SELECT list(v ORDER BY i) AS tab FROM crc WHERE k = 8),
t AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
         ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT t.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 6 AS h FROM t, tab
), r AS (
  SELECT a.conv_id, list_concat(coalesce(b.own, [])[1 : h], a.own[h + 1 :]) AS s FROM h a LEFT JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 100
), p AS (SELECT conv_id, s, len(s) AS n, unnest(range(0, len(s) + 1)) AS depth FROM r),
g AS (
  SELECT depth, s[1 : depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM p GROUP BY depth, s[1 : depth]
), k AS (SELECT prefix[1 : depth - 1] AS prefix, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1),
x AS (
  SELECT g.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN g.depth = 0 THEN 0 ELSE (g.n_convs - 1) * length(g.prefix[g.depth].text) END AS saves
  FROM g LEFT JOIN k ON k.prefix = g.prefix
), u AS (
  SELECT prefix[1 : d] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saves) AS saved
  FROM (SELECT x.*, unnest(range(0, depth + 1)) AS d FROM x) GROUP BY 1
)
SELECT x.conv_id, x.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children,
       u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, x.ends_sha256
FROM x JOIN u ON u.prefix = x.prefix LEFT JOIN x q ON x.depth > 0 AND q.prefix = x.prefix[1 : x.depth - 1]
"""

_MIX = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), z AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id) AS r
  FROM (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || size), 1, 15))::BIGINT AS h FROM d)
), w AS (
  SELECT s, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY s) - 1) % 3]::DOUBLE AS w FROM z GROUP BY s
), c AS (
  SELECT *, (SELECT sum(source_size)::DOUBLE * 1.5 FROM w) AS total,
         coalesce(sum(source_size * 2.0::DOUBLE) OVER q, 0) AS before,
         sum(w) OVER (ORDER BY source_size / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM w WINDOW q AS (ORDER BY source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT max((total - before) / after) FILTER ((total - before) / after * w <= source_size * 2.0) AS level FROM c),
g AS (
  SELECT s, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base
  FROM (SELECT *, least(source_size * 2.0::DOUBLE, coalesce(level, 1e300) * w) AS target FROM w, l)
), b AS (
  SELECT z.*, source_size, target, base, floor(target - base * source_size)::BIGINT AS rest, sum(size) OVER (PARTITION BY z.s ORDER BY r) - size AS under
  FROM z JOIN g USING (s)
), e AS (SELECT s, r AS spot, rest - under AS gap FROM b WHERE rest > 0 AND under <= rest AND rest < under + size),
f AS (
  SELECT b.s, arg_min(r, {'off': abs(size - gap), 'r': r}) FILTER (r >= spot AND size > 0 AND abs(size - gap) < gap) AS fill, any_value(spot) AS spot FROM b JOIN e USING (s) GROUP BY b.s
)
SELECT doc_id, size, source_size, target, ((base + CASE WHEN coalesce(r < spot, false) OR coalesce(r = fill, false) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM b LEFT JOIN f USING (s)
"""

SQL: dict[str, str] = {"op2_warc": _WARC, "op3_decontamination": _PHRASES, "op4_line_dedup": _LINES, "op7_topk": _TOPK, "op11_filter_audit": _AUDIT, "op12_prefix_trie": _TRIE, "op13_source_mix": _MIX}
