"""SQL of the corpus queries that SQL can express, as DuckDB runs it."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[\x20\x09-\x0D]+"

#: From ``nodes(id)`` and ``links(a, b)`` to ``comp(id, component_id)``.
_REACH = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS other FROM both_ways UNION
SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
comp AS (SELECT n.id, COALESCE(MIN(r.other), n.id) AS component_id FROM nodes n LEFT JOIN reach r ON r.id = n.id GROUP BY n.id)"""

ORACLES = {
    "op1_minhash_dedup": rf"""
WITH RECURSIVE cut AS (SELECT doc_id, regexp_split_to_array({_LOWER.format("text")}, '{_SPACE}') AS w
FROM documents WHERE text IS NOT NULL),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM cut),
pair AS (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS follower,
COUNT(*) OVER (PARTITION BY doc_id) AS n_words FROM word WHERE word <> ''),
shingle AS (SELECT DISTINCT doc_id, CASE WHEN n_words = 1 THEN word ELSE word || ' ' || follower END AS g
FROM pair WHERE n_words = 1 OR follower IS NOT NULL),
size AS (SELECT doc_id, COUNT(*) AS n FROM shingle GROUP BY doc_id),
overlap AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS k FROM shingle x
JOIN shingle y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM overlap JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
WHERE 100 * k >= 80 * (p.n + q.n - k)),
nodes AS (SELECT doc_id AS id FROM documents),
{_REACH}
SELECT d.doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d JOIN comp ON comp.id = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id
""",
    "op8_line_dedup": rf"""
WITH split AS (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (SELECT *, {_LOWER.format(rf"regexp_replace(line, '^{_SPACE}|{_SPACE}$', '', 'g')")} AS key FROM line),
shared AS (SELECT key, MIN(doc_id) AS least FROM keyed WHERE length(key) >= 10 GROUP BY key
HAVING COUNT(DISTINCT doc_id) > 1),
marked AS (SELECT doc_id, pos, line, least IS NOT NULL AND doc_id <> least AS gone FROM keyed LEFT JOIN shared USING (key)),
island AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, gone ORDER BY pos) AS g FROM marked),
run AS (SELECT doc_id, gone, MIN(pos) AS p, COUNT(*) AS n FROM island GROUP BY doc_id, gone, g),
runs AS (SELECT doc_id, (CASE WHEN arg_min(gone, p) THEN '0,' ELSE '' END) || string_agg(CAST(n AS VARCHAR), ',' ORDER BY p)
|| (CASE WHEN arg_max(gone, p) THEN ',0' ELSE '' END) AS keep_runs FROM run GROUP BY doc_id)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE gone) AS n_dropped,
sha256(COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256, ANY_VALUE(keep_runs) AS keep_runs
FROM marked JOIN runs USING (doc_id) GROUP BY doc_id
""",
    "op9_embedding_dedup": f"""
WITH RECURSIVE usable AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id < y.vec_id
AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
nodes AS (SELECT vec_id AS id FROM embeddings),
{_REACH},
degree AS (SELECT a AS id, COUNT(*) AS n FROM both_ways GROUP BY a)
SELECT comp.id AS vec_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_links, component_id, component_id = comp.id AS kept
FROM comp LEFT JOIN degree ON degree.id = comp.id
""",
}
