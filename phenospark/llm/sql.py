"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

USABLE = "embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP4 = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS t
  FROM embeddings WHERE {USABLE})
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.t, c.t) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.t, c.t) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
WHERE rank <= 20
"""

OP5 = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings WHERE {USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS MATERIALIZED (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
WHERE rank <= 10
"""

OP9 = """
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS h2
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i)),
f AS MATERIALIZED (SELECT h2, min(doc_id) AS first_doc FROM g GROUP BY h2),
gone AS MATERIALIZED (
  SELECT DISTINCT g.doc_id, g.i + j AS k
  FROM g JOIN f ON g.h2 = f.h2 AND f.first_doc < g.doc_id, LATERAL (SELECT unnest(range(13)) AS j)),
x AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS MATERIALIZED (
  SELECT x.doc_id, count(*) FILTER (gone.k IS NOT NULL) AS n_removed,
         string_agg(x.word, ' ' ORDER BY x.k) FILTER (gone.k IS NULL) AS t
  FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.k = x.k GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP7 = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+'),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS s
  FROM d, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 3))) AS i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(s, '' ORDER BY s)) AS name FROM g GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT u, v, x.name AS xn, y.name AS yn FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
  WHERE c >= 0.8 * (x.n + y.n - c)),
r(u, root) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.u WHERE r.root < l.v),
k AS (SELECT u, min(root) AS class_id FROM r GROUP BY u),
m AS (SELECT u, count(*) AS n_links, count(DISTINCT yn) FILTER (xn <> yn) AS n_set_links FROM l GROUP BY u)
SELECT d.doc_id, k.class_id, coalesce(n_links, 0) AS n_links, coalesce(n_set_links, 0) AS n_set_links
FROM d JOIN k ON k.u = d.doc_id LEFT JOIN m ON m.u = d.doc_id
"""

ORACLE = {"op4_maxscore": OP4, "op5_block_join": OP5, "op7_chosen_path": OP7, "op9_recompress": OP9}
