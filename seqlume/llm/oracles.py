"""SQL for DuckDB of the training-data queries that SQL can express."""

from __future__ import annotations

from .quality_rules import STOP_WORDS

_WS = r"[\x20\x09-\x0D]+"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(STOP_WORDS)))

#: The measures of the rule table and its thresholds, in the order of quality_rules.DEFAULT_RULES.
QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 2) AS win FROM w, LATERAL unnest(generate_series(1, len(ws) - 2)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_WS}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
  len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS n_stop,
  len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis, len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(word_chars / n_words BETWEEN 2 AND 15, true) AND coalesce(n_symbols / n_words <= 0.1, true)
  AND coalesce(n_stop / n_words >= 0.01, true) AND coalesce(n_dup_lines / n_lines <= 0.5, true) AND coalesce(n_repeat_words / n_words <= 0.5, true)
  AND coalesce(n_ellipsis / n_lines <= 0.3, true) AND coalesce(n_bullet / n_lines <= 0.9, true) AS kept
FROM m
"""

URL_FILTER = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(host, path, rule, verdict) AS (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'), ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
f AS (SELECT h.page_id, h.host, h.path, r.rule, r.verdict, row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rule) DESC, length(r.host) DESC) AS n
  FROM h LEFT JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""

_NORM = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

QUOTE_LINKS = rf"""
WITH m AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS position, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS lines FROM conversations),
l AS (SELECT conv_id, position, n, lines[n] AS raw, length(regexp_replace(regexp_extract(lines[n], '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS level,
  regexp_replace(lines[n], '^((?:[ \t]*>)+)[ \t]?', '') AS line FROM m, LATERAL unnest(generate_series(1, len(lines))) AS u(n)),
own AS (SELECT conv_id, position, trim(coalesce(string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY n), '')) AS text, max(level) AS quote_level FROM l GROUP BY 1, 2),
q AS (SELECT *, n - row_number() OVER (PARTITION BY conv_id, position, level ORDER BY n) AS passage FROM l WHERE level > 0),
b AS (SELECT conv_id, position, level, passage, string_agg(line, chr(10) ORDER BY n) AS body FROM q GROUP BY 1, 2, 3, 4),
ask AS (SELECT DISTINCT conv_id, position, level, passage, {_NORM.format("u.part")} AS unit FROM b, LATERAL unnest(list_concat(list_concat([body], regexp_split_to_array(body, '\n[ \t]*\n')), string_split(body, chr(10)))) AS u(part)),
known AS (SELECT DISTINCT conv_id, position, {_NORM.format("u.part")} AS unit FROM own, LATERAL unnest(list_concat(list_concat([text], regexp_split_to_array(text, '\n[ \t]*\n')), string_split(text, chr(10)))) AS u(part)),
hit AS (SELECT a.conv_id, a.position, a.level, k.position AS p, sum(length(a.unit)) AS chars FROM ask a JOIN known k ON a.conv_id = k.conv_id AND a.unit = k.unit AND a.unit <> '' AND k.position < a.position GROUP BY 1, 2, 3, 4),
best AS (SELECT conv_id, position, p AS linked_to FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, position ORDER BY level, chars DESC, p DESC) AS r FROM hit) WHERE r = 1),
found AS (SELECT a.conv_id, a.position, count(DISTINCT (a.level, a.passage)) AS n FROM ask a JOIN known k ON a.conv_id = k.conv_id AND a.unit = k.unit AND a.unit <> '' AND k.position < a.position GROUP BY 1, 2),
np AS (SELECT conv_id, position, count(*) AS n FROM b GROUP BY 1, 2)
SELECT m.conv_id, m.turn, m.role, m.position, coalesce(best.linked_to, CASE WHEN m.position > 0 THEN m.position - 1 END) AS reply_to, best.linked_to IS NOT NULL AS linked, CAST(own.quote_level AS INTEGER) AS quote_level,
  CAST(coalesce(np.n, 0) AS BIGINT) AS n_passages, CAST(coalesce(found.n, 0) AS BIGINT) AS n_linked, own.text
FROM m JOIN own USING (conv_id, position) LEFT JOIN best USING (conv_id, position) LEFT JOIN found USING (conv_id, position) LEFT JOIN np USING (conv_id, position)
"""

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_ASCII_LOWER}, '{_WS}'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS sh FROM w, LATERAL unnest(generate_series(1, CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(len(ws) - 4, 1) END)) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, e.y FROM r JOIN e ON e.x = r.u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT v, min(u) AS least FROM r GROUP BY 1) c ON c.v = w.doc_id
"""

SOURCE_DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_ASCII_LOWER} AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
o AS (SELECT r, lang, source, term, count(*) AS n FROM w GROUP BY 1, 2, 3, 4),
k AS (SELECT lang, term, sum(n) AS total FROM o GROUP BY 1, 2 HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS terms, sum(total) AS in_lang FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, term, sum(n) AS n FROM o GROUP BY 1, 2, 3),
c AS (SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n, k.total FROM g JOIN k ON k.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
m AS (SELECT lang, source, sum(n) AS in_group FROM c GROUP BY 1, 2),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + CAST(floor_div AS BIGINT) AS p, 1 + CAST(floor_all AS BIGINT) AS q FROM (SELECT c.*, (1000000000::HUGEINT * (c.n + 5)) // (m.in_group + 5 * v.terms) AS floor_div, (1000000000::HUGEINT * (c.total + 5)) // (v.in_lang + 5 * v.terms) AS floor_all
  FROM c JOIN m ON m.lang = c.lang AND m.source = c.source JOIN v ON v.lang = c.lang) c),
x AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source AS one, b.source AS two, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) f ON f.lang = a.lang AND f.one = a.source AND f.two = b.source),
y AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM x
  UNION ALL SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM y WHERE part = 'pair' OR rank <= 50
"""


def _centroid_rounds(rounds: int, clusters: int) -> str:
    """Common table expressions c0, a0, c1, ...: centroids (cluster, dim, x) and nearest centroids of each round."""
    parts = [f"""c0 AS (SELECT cluster, dim, v[dim] AS x FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v FROM z WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || vec_id), v LIMIT {clusters}) s, LATERAL unnest(generate_series(1, 64)) AS u(dim))"""]
    for i in range(rounds + 1):
        parts.append(f"l{i} AS (SELECT cluster, list(x ORDER BY dim) AS x FROM c{i} GROUP BY 1)")
        parts.append(f"a{i} AS (SELECT r, min(struct_pack(d := list_sum(list_transform(list_zip(z.v, l{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := cluster)) AS best FROM z, l{i} GROUP BY 1)")
        if i < rounds:
            mean = "(CAST(sum(v[dim]) AS BIGINT) - ((CAST(sum(v[dim]) AS BIGINT) % count(*)) + count(*)) % count(*)) // count(*)"
            parts.append(f"""m{i} AS (SELECT best.c AS cluster, dim, {mean} AS x FROM a{i} JOIN z USING (r), LATERAL unnest(generate_series(1, 64)) AS u(dim) GROUP BY 1, 2),
c{i + 1} AS (SELECT c.cluster, c.dim, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster AND m.dim = c.dim)""")
    return ",\n".join(parts)


CENTROIDS = f"""
WITH z AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
{_centroid_rounds(3, 16)},
f AS (SELECT r, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance FROM a3),
h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c3 GROUP BY 1)
SELECT z.vec_id, f.cluster, f.distance, CAST(sum(f.distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(f.distance) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM f JOIN z USING (r) JOIN h ON h.cluster = f.cluster
"""

ORACLE_SQL = {"op3_quality_rules": QUALITY_RULES, "op4_url_filter": URL_FILTER, "op6_quote_links": QUOTE_LINKS, "op9_jaccard_join": JACCARD_JOIN, "op11_source_divergence": SOURCE_DIVERGENCE, "op12_centroids": CENTROIDS}
