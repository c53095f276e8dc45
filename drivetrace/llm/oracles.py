"""SQL that gives the same rows as the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

_USABLE = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(embedding) = list_count(embedding)
    AND isfinite(list_max(embedding)) AND isfinite(list_min(embedding)) AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0))
"""

NEAREST = f"""WITH {_USABLE}
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0))
WHERE rank <= 20"""

_REACHED = """link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT DISTINCT a, a AS b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
root AS (SELECT a AS id, min(b) AS class FROM reach GROUP BY a),
links AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
"""

VECTOR_LINKS = f"""WITH RECURSIVE {_USABLE},
pair AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_REACHED}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(class, vec_id) AS component_id, coalesce(class, vec_id) = vec_id AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id IS NOT NULL) LEFT JOIN root ON root.id = vec_id LEFT JOIN links ON links.id = vec_id"""

TEXT_LINKS = rf"""WITH RECURSIVE word AS (SELECT doc_id, regexp_extract_all(text, '[^\t\n\x0b\f\r ]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM word WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
pair AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b WHERE 5 * p.n >= 4 * (sa.n + sb.n - p.n)),
{_REACHED}
SELECT doc_id, coalesce(class, doc_id) AS class_id, coalesce(n, 0) AS n_links, coalesce(class, doc_id) = doc_id AS kept
FROM documents LEFT JOIN root ON root.id = doc_id LEFT JOIN links ON links.id = doc_id"""

_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
CHAT = rf"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
turn AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length('<|im_start|><|im_end|>') + 2 + length(replace({_ESCAPED.format('role')}, chr(10), '\' || chr(10))) + length({_ESCAPED.format('text')})) OVER w AS upto
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  length(string_agg(CASE role WHEN 'assistant' THEN text ELSE '' END, '' ORDER BY i)) AS loss_chars,
  sha256(string_agg(CASE role WHEN 'assistant' THEN text ELSE '' END, '' ORDER BY i)) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR i = n THEN upto END) AS BIGINT) AS formatted_chars
FROM turn GROUP BY conv_id"""

REPEATED = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
place AS (SELECT doc_id, i, t[i + 1 : i + 50] AS s FROM (SELECT doc_id, t, unnest(range(0, octet_length(t) - 49)) AS i FROM d WHERE octet_length(t) >= 50)),
least AS (SELECT s, min(doc_id) AS first FROM place GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM place JOIN least USING (s) WHERE first < doc_id),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (
  SELECT *, count_if(p IS NULL OR i > p + 50) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM gone) GROUP BY doc_id, k),
edge AS (SELECT doc_id, a, z, coalesce(lag(z) OVER w, 0) AS before, lead(a) OVER w AS next FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
kept AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN next IS NULL THEN substr(h, 2 * z + 1) ELSE '' END, '' ORDER BY a) AS k
  FROM edge JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def _located(source: str, text: str, pattern: str, columns: str) -> str:
    """Matches of a pattern as start (from 0) and value, beside ``columns`` of ``source``."""
    return rf"""(SELECT {columns}, f[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda s: length(s)))
    + coalesce(list_sum(list_transform(f[1:i - 1], lambda s: length(s))), 0) AS BIGINT) AS a
  FROM (SELECT {columns}, f, g, unnest(range(1, len(f) + 1)) AS i
    FROM (SELECT {columns}, regexp_extract_all({text}, '{pattern}') AS f, string_split_regex({text}, '{pattern}') AS g FROM {source})))"""


_LUHN = """list_sum(list_transform(range(1, length(digits) + 1), lambda j: CASE WHEN j % 2 = 1
  THEN CAST(substr(reverse(digits), j, 1) AS INTEGER)
  ELSE (2 * CAST(substr(reverse(digits), j, 1) AS INTEGER)) % 10 + (2 * CAST(substr(reverse(digits), j, 1) AS INTEGER)) // 10 END)) % 10 = 0"""
_PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "TRUE", "lower(v)"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     "len(list_filter(string_split(v, '.'), lambda p: coalesce(try_cast(p AS HUGEINT) <= 255, FALSE))) = 4", "v"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length(digits) BETWEEN 12 AND 19 AND {_LUHN}", "digits"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15", "digits"),
)
_BASE = " UNION ALL ".join(
    f"""SELECT doc_id, a, {n} AS kind, a + length(v) AS z, '{name}:' || {normal} AS entity
  FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM {_located("d", "t", pattern, "doc_id")}) WHERE {holds}"""
    for n, (name, pattern, holds, normal) in enumerate(_PLAIN)
)
_BESIDE = r"\p{L}{3,}"
PRIVATE = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_BASE}),
island AS (SELECT doc_id, min(a) AS a, max(z) AS z FROM (
  SELECT *, count_if(a >= before) OVER (PARTITION BY doc_id ORDER BY a, kind, z) AS n FROM (
    SELECT *, coalesce(max(z) OVER (PARTITION BY doc_id ORDER BY a, kind, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM base))
  GROUP BY doc_id, n),
hidden AS (SELECT doc_id, string_agg(substr(t, before + 1, a - before) || repeat('#', z - a) || CASE WHEN last THEN substr(t, z + 1) ELSE '' END, '' ORDER BY a) AS t
  FROM (SELECT doc_id, t, a, z, coalesce(lag(z) OVER w, 0) AS before, lead(z) OVER w IS NULL AS last
    FROM island JOIN d USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)) GROUP BY doc_id),
word AS (SELECT doc_id, v, a, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS n FROM {_located("hidden", "t", _BESIDE, "doc_id")}),
place AS (SELECT b.doc_id, b.entity, b.kind, b.a, count(w.n) AS k FROM base b LEFT JOIN word w ON w.doc_id = b.doc_id AND w.a < b.a GROUP BY ALL),
near AS (SELECT w.doc_id, entity, lower(v) AS term, w.a, w.a + length(v) AS z FROM place p JOIN word w ON w.doc_id = p.doc_id AND w.n BETWEEN k - 7 AND k + 8),
both_ AS (SELECT entity, term, count(DISTINCT doc_id) AS n_both FROM near GROUP BY 1, 2),
entity_ AS (SELECT entity, count(DISTINCT doc_id) AS n_entity FROM base GROUP BY 1),
term_ AS (SELECT term, count(*) AS n_term FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(t), '\p{{L}}+')) AS term FROM d) GROUP BY 1),
told AS (SELECT entity, term, ln(CAST(n AS DOUBLE) * n_both / (CAST(n_term AS DOUBLE) * n_entity)) / ln(CAST(n AS DOUBLE) / n_entity) AS disclosure
  FROM both_ JOIN entity_ USING (entity) JOIN term_ USING (term), (SELECT count(*) AS n FROM d) WHERE n_entity < n),
spans AS (SELECT doc_id, a, kind, z FROM base
  UNION ALL SELECT doc_id, a, CASE WHEN max(disclosure) >= 0.9 THEN 5 ELSE 4 END, z
    FROM near JOIN told USING (entity, term) WHERE disclosure >= 0.5 - 1e-9 GROUP BY doc_id, a, z),
listed AS (SELECT doc_id, a, kind, z, list_extract(['email', 'ip', 'card', 'phone', 'general', 'remove'], kind + 1) || ':' || a || ':' || z AS s FROM spans)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card,
  count(*) FILTER (kind = 3) AS n_phone,
  sha256(coalesce(string_agg(s, ',' ORDER BY a, kind, z) FILTER (kind < 4), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY a, kind, z), '') AS spans
FROM d LEFT JOIN listed USING (doc_id) GROUP BY doc_id"""

LINES = """WITH line AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS l
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (SELECT *, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
often AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last > doc_id) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (coalesce(last <= doc_id, TRUE)), '')) AS kept_sha256
FROM keyed LEFT JOIN often USING (key) GROUP BY doc_id"""


def _clusters(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Every round of the assignments (a0, a1, ...) and centroids (c0, c1, ...) by name; doubles hold these whole numbers."""
    apart = "list_inner_product(e, e) - 2 * list_inner_product(e, c) + list_inner_product(c, c)"
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, CAST(list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS e
  FROM embeddings WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND isfinite(list_max(embedding)) AND isfinite(list_min(embedding))),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS k, e AS c
  FROM (SELECT sha256('{seed}:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {k}))"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, e, CAST(best.d AS BIGINT) AS d, best.k AS k
  FROM (SELECT vec_id, any_value(e) AS e, min(struct_pack(d := {apart}, k := k)) AS best FROM v, c{r} GROUP BY vec_id))"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
  SELECT k, list(CAST((s - (s % n + n) % n) // n AS DOUBLE) ORDER BY i) AS c
  FROM (SELECT k, i, sum(CAST(x AS BIGINT)) AS s, count(*) AS n FROM (SELECT k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}) GROUP BY k, i)
  GROUP BY k) m USING (k))"""
            )
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


CLUSTERS = _clusters()
