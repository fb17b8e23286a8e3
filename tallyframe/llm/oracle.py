"""DuckDB SQL with the same rows as the registered queries, where SQL can express the operator."""

from __future__ import annotations

# Distinct 5-word shingles; rows of one shingle set are a class, classes are linked through
# the shingles they share, and components are closed over the links between classes.
NGRAM_JACCARD_JOIN = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM texts),
grams AS (
  SELECT r, p, n, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS g
  FROM words WINDOW o AS (PARTITION BY r ORDER BY p)),
sets AS (
  SELECT r, count(*) AS n, string_agg(g, chr(10) ORDER BY g) AS names
  FROM (SELECT DISTINCT r, g FROM grams WHERE p <= greatest(n - 4, 1)) t GROUP BY r),
rows_of AS (
  SELECT t.r, t.doc_id, coalesce(s.n, 0) AS n,
    CASE WHEN s.r IS NULL THEN t.doc_id ELSE min(t.doc_id) OVER (PARTITION BY s.names) END AS class_id
  FROM texts t LEFT JOIN sets s ON s.r = t.r),
classes AS (SELECT class_id AS c, min(r) AS r, min(n) AS n FROM rows_of WHERE n > 0 GROUP BY class_id),
named AS MATERIALIZED (SELECT DISTINCT c, c.n, g FROM classes c JOIN grams g ON g.r = c.r WHERE p <= greatest(g.n - 4, 1)),
links AS MATERIALIZED (
  SELECT x.c AS a, y.c AS b FROM named x JOIN named y ON x.g = y.g AND x.c <> y.c
  GROUP BY x.c, y.c, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT c, c AS top FROM classes UNION SELECT l.b, m.top FROM reach m JOIN links l ON l.a = m.c AND m.top < l.b),
least AS (SELECT c, min(top) AS top FROM reach GROUP BY c)
SELECT doc_id, n AS n_shingles, coalesce(least.top, doc_id) AS component_id, class_id
FROM rows_of LEFT JOIN least ON least.c = class_id"""

EMBEDDING_NEARDUP = r"""
WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
sound AS MATERIALIZED (
  SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS norm FROM vectors
  WHERE len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(x, lambda v: v <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id AS v, vec_id AS top FROM vectors UNION SELECT l.b, m.top FROM reach m JOIN links l ON l.a = m.v AND m.top < l.b),
least AS (SELECT v, min(top) AS top FROM reach GROUP BY v),
degrees AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, top AS component_id, vec_id = top AS kept
FROM vectors JOIN least ON v = vec_id LEFT JOIN degrees ON a = vec_id"""

# Every window of 35 words by its text; a word goes if one of the windows that cover it stands anywhere else.
SUBSTRING_DEDUP = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM texts),
windows AS (
  SELECT r, p, n, w, md5(string_agg(w, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h FROM words),
again AS (SELECT h FROM windows WHERE p <= n - 34 GROUP BY h HAVING count(*) > 1),
marked AS (SELECT r, p, w, p <= n - 34 AND h IN (SELECT h FROM again) AS starts FROM windows),
covered AS (SELECT r, p, w, bool_or(starts) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM marked),
kept AS (SELECT r, count(*) FILTER (WHERE gone) AS k, coalesce(string_agg(w, ' ' ORDER BY p) FILTER (WHERE NOT gone), '') AS t FROM covered GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(k, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept ON kept.r = texts.r"""


# Every string of 400 bytes by its place; repeated ones merge into runs, and what lies between runs is kept.
SUFFIX_DEDUP = r"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS MATERIALIZED (SELECT r, p, md5(b[p:p + 399]) AS h FROM (SELECT r, b, unnest(range(1, n - 398)) AS p FROM texts WHERE n >= 400) t),
again AS (SELECT h FROM strings GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, p, p > 400 + lag(p) OVER (PARTITION BY r ORDER BY p) AS apart FROM strings WHERE h IN (SELECT h FROM again)),
runs AS (
  SELECT r, k, min(p) AS lo, max(p) + 399 AS hi FROM (
    SELECT r, p, count(*) FILTER (WHERE apart) OVER (PARTITION BY r ORDER BY p) AS k FROM starts) t GROUP BY r, k),
pieces AS (
  SELECT r, k, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY k), 0) + 1 AS a, lo - 1 AS z FROM runs
  UNION ALL SELECT r, 1 + max(k), max(hi) + 1, NULL FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(hex(b[a:coalesce(z, n)]), '' ORDER BY k) AS t FROM pieces JOIN texts USING (r) WHERE a <= coalesce(z, n) GROUP BY r),
gone AS (SELECT r, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_removed IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(t, ''))) END AS kept_sha256
FROM texts LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)"""


def _clustering(rounds: int = 10, k: int = 8) -> str:
    """One query: every round is an assignment a<r> and new centroids c<r>, written out in full."""
    parts = [
        """ints AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x AS m FROM ints WHERE vec_id IS NOT NULL
  ORDER BY sha256('3:' || vec_id), x LIMIT {k})""",
    ]
    far = "CAST(list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    for turn in range(rounds + 1):
        parts.append(f"d{turn} AS MATERIALIZED (SELECT r, c, {far} AS d FROM ints CROSS JOIN c{turn})")
        parts.append(f"a{turn} AS MATERIALIZED (SELECT r, min(row(d, c)) AS best FROM d{turn} GROUP BY r)")
        if turn < rounds:
            parts.append(
                f"""c{turn + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.m, o.m) AS m FROM c{turn} o LEFT JOIN (
    SELECT c, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY p) AS m FROM (
      SELECT best[2] AS c, p, sum(v) AS s, count(*) AS n FROM a{turn} JOIN (SELECT r, unnest(x) AS v, generate_subscripts(x, 1) AS p FROM ints) u USING (r)
      GROUP BY best[2], p) t GROUP BY c) n ON n.c = o.c)"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN ints USING (r) JOIN c{rounds} ON c{rounds}.c = best[2]"""
    )


SQL = {
    "op1_ngram_jaccard_join": NGRAM_JACCARD_JOIN,
    "op2_embedding_neardup": EMBEDDING_NEARDUP,
    "op10_substring_dedup": SUBSTRING_DEDUP,
    "op11_centroid_clustering": _clustering(),
    "op12_suffix_dedup": SUFFIX_DEDUP,
}
