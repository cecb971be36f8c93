"""SQL (DuckDB) with the same results as the queries of this subpackage."""

from __future__ import annotations

OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *, row_number() OVER w AS place, lag(role) OVER w AS before FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, length(regexp_replace(text, '<(\\*[/+]?turn>)', '<\\\1', 'g'))
    + CASE WHEN before IS NULL THEN 7 + length(role) WHEN before = role THEN 7 ELSE 15 + length(role) END AS chars
  FROM placed
), chats AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS turns,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss, sum(chars) + 8 AS chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256,
  CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM chats
"""

OP6 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS place, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT place, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM texts
), filled AS (
  SELECT *, row_number() OVER w AS n, sum(length(line)) OVER w AS upto, array_agg(line) OVER (w ROWS BETWEEN CURRENT ROW
    AND 19 FOLLOWING) AS next FROM lines WHERE NOT regexp_full_match(line, '[\x20\x09\x0B-\x0D]*')
  WINDOW w AS (PARTITION BY place ORDER BY i)
), windows AS (
  SELECT a.place, a.doc_id, a.n, b.n AS last, array_to_string(a.next[:b.n - a.n + 1], chr(10)) AS run,
    b.upto - a.upto + length(a.line) AS chars
  FROM filled a JOIN filled b ON a.place = b.place AND b.n BETWEEN a.n AND a.n + 19
  WHERE chars >= 20 AND (chars - length(a.line) < 20 OR chars - length(b.line) < 20)
), repeated AS (
  SELECT place, n, last FROM windows QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, place, n) > 1
), gone AS (
  SELECT DISTINCT f.place, f.i FROM (SELECT place, unnest(range(n, last + 1)) AS n FROM repeated) JOIN filled f USING (place, n)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON g.place = l.place AND g.i = l.i GROUP BY l.place
"""

OP8 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), runs AS (
  SELECT place, doc_id, s, array_to_string(words[s:s + 49], ' ') AS run
  FROM texts, unnest(range(1, len(words) - 48)) AS u(s)
), repeated AS (
  SELECT place, s FROM (SELECT *, min(doc_id) OVER (PARTITION BY run) AS least FROM runs) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT place, unnest(range(s, s + 50)) AS i FROM repeated
), words AS (
  SELECT place, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts
), kept AS (
  SELECT w.place, count(g.i) AS n_removed, coalesce(string_agg(w.word, ' ' ORDER BY w.i) FILTER (g.i IS NULL), '') AS kept
  FROM words w LEFT JOIN gone g ON g.place = w.place AND g.i = w.i GROUP BY w.place
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (place)
"""

OP9 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

OP10 = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html, CASE WHEN contains(coalesce(url, ''), '://')
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), cut AS (
  SELECT page_id, html, lower(regexp_extract(rest, '^[^/?#]*', 0)) AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query
  FROM parts
), links AS (
  SELECT host || path || query AS a, host,
    unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0),
              '(?is)\bhref\s*=\s*["'']?([^"''>\s]+)', 1),
            regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0),
              '(?is)\burl\s*=\s*["'']?([^"''>\s]+)', 1)]) AS target
  FROM cut
), edges AS (
  SELECT a, regexp_replace(CASE WHEN contains(target, '://') THEN substr(target, strpos(target, '://') + 3)
    WHEN target LIKE '//%' THEN substr(target, 3) ELSE host || target END, '#.*$', '') AS b
  FROM links WHERE host <> '' AND (contains(target, '://') OR target LIKE '/%')
), both_ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach AS (
  SELECT a AS node, b AS other FROM both_ways
  UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), nodes AS (
  SELECT other, regexp_extract(other, '^[^/?#]*', 0) AS host, regexp_extract(other, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT DISTINCT other FROM reach)
), rules(verdict, host, path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
    ('allow', 'org', '/fr/')
), ruled AS (
  SELECT n.other, arg_max(r.verdict, length(r.host || r.path)) AS verdict FROM nodes n JOIN rules r
    ON (n.host = r.host OR n.host LIKE '%.' || r.host) AND starts_with(n.path, r.path) GROUP BY 1
), alias AS (
  SELECT node, CASE WHEN bool_or(verdict = 'block') AND NOT coalesce(bool_or(verdict = 'allow'), false)
    THEN 'block' ELSE 'allow' END AS verdict
  FROM reach LEFT JOIN ruled USING (other) GROUP BY node
), own AS (
  SELECT c.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
    arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM cut c JOIN rules r ON (c.host = r.host OR c.host LIKE '%.' || r.host) AND starts_with(c.path, r.path)
  GROUP BY 1
)
SELECT c.page_id, c.host, c.path, o.rule, coalesce(o.verdict, a.verdict, 'allow') AS verdict
FROM cut c LEFT JOIN own o USING (page_id) LEFT JOIN alias a ON a.node = c.host || c.path || c.query AND c.host <> ''
"""

_ROUND = """
), p{i} AS (
  SELECT v.place, c.n, list_sum(list_transform(range(1, 65), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j]))) AS d
  FROM kept v CROSS JOIN c{i} c
), a{i} AS (
  SELECT place, n, d FROM p{i} QUALIFY row_number() OVER (PARTITION BY place ORDER BY d, n) = 1
"""
_MEANS = """
), m{i} AS (
  SELECT n, list(CAST(floor(s / m) AS BIGINT) ORDER BY j) AS x FROM (
    SELECT a.n, u.j, sum(v.x[u.j])::DOUBLE AS s, count(*) AS m
    FROM a{i} a JOIN kept v USING (place), unnest(range(1, 65)) AS u(j) GROUP BY a.n, u.j) GROUP BY n
), c{k} AS (
  SELECT c.n, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (n)
"""

OP12 = (
    r"""
WITH kept AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS n, x FROM kept
  ORDER BY sha256('1:' || vec_id), x LIMIT 16
"""
    + "".join(_ROUND.format(i=i) + _MEANS.format(i=i, k=i + 1) for i in range(3))
    + _ROUND.format(i=3)
    + """
)
SELECT vec_id, CAST(n AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a3 JOIN kept USING (place) JOIN c3 c USING (n)
"""
)

OP13 = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT doc_id, part, (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * list_unique(words) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 'E' ELSE '' END) AS fails
  FROM texts
), rows AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), orders(filter_order) AS (
  SELECT '' UNION ALL
  SELECT filter_order || l FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) f(l) WHERE NOT contains(filter_order, l)
), steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, filter_order[:step - 1] AS before
  FROM orders, range(1, 6) AS r(step) WHERE length(filter_order) = 5
), marked AS (
  SELECT *, contains(fails, letter) AS hit, before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone
  FROM steps CROSS JOIN rows
), counted AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN hit OR gone THEN 0 ELSE n END) AS kept,
    sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM marked GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": OP2,
    "op6_line_dedup": OP6,
    "op8_substring_dedup": OP8,
    "op9_exact_dedup": OP9,
    "op10_url_filter": OP10,
    "op12_centroid_cluster": OP12,
    "op13_filter_audit": OP13,
}
