"""DuckDB SQL for the queries that SQL can state."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + ", '[^\\x20\\x09-\\x0D]+')"

OP3 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {WORDS} AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
hits AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM hits JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM words UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM comp LEFT JOIN sizes USING (doc_id)
"""

OP1 = f"""
WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS par
  FROM documents),
words AS (SELECT doc_id, par, {WORDS.replace("text", "line")} AS w FROM lines),
long AS (SELECT row_number() OVER (ORDER BY doc_id, par) AS id, doc_id, par, w FROM words WHERE len(w) >= 15),
sets AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) AS s FROM long),
sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
hits AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id),
links AS (SELECT x, y FROM hits JOIN sizes p ON p.id = x JOIN sizes q ON q.id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT DISTINCT x, x AS y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
comp AS (SELECT x AS id, min(y) AS first FROM reach GROUP BY x)
SELECT l.doc_id, l.par::INT AS par, len(l.w)::INT AS n_words, f.doc_id AS first_doc, f.par::INT AS first_par, l.id = f.id AS kept
FROM comp JOIN long l ON l.id = comp.id JOIN long f ON f.id = comp.first
"""

ORACLE = {"op1_substring_dedup": OP1, "op3_minhash_near_dedup": OP3}
