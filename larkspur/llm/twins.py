"""DuckDB SQL for those queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

CHAT = r"""
WITH given AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id) AS turns,
        length(text) + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\]|SYS\]|ROLE[:\]])'))
        + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 15 WHEN 'system' THEN 13 ELSE 16 + coalesce(2 * strlen(role), 4) END AS shown
    FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)
), running AS (
    SELECT *, 3 + sum(shown) OVER (PARTITION BY conv_id ORDER BY nth) AS upto FROM sized
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(upto) FILTER (role = 'assistant' OR nth = turns) AS BIGINT) AS formatted_chars
FROM running GROUP BY conv_id
"""

NGRAM = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS own FROM words
), rows AS (
    SELECT doc_id, len(own) AS n, unnest(own) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT sets.doc_id, CAST(len(own) AS BIGINT) AS n_shingles, least_id AS component_id
FROM sets JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) r ON r.a = sets.doc_id
"""

WARC = """
WITH sized AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
    SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM sized LEFT JOIN firsts USING (payload_digest)
"""


def _rounds(rounds: int, k: int) -> str:
    """k-means over integer vectors: the tables c0, c1, ... of centroids and the last assignment."""
    steps = [f"""
kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INT) AS cluster, v FROM kept
    ORDER BY sha256('2:' || vec_id), v LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
    SELECT vec_id, v, min_by(cluster, d * {k} + cluster) AS cluster, min(d) AS distance
    FROM (SELECT vec_id, kept.v AS v, cluster, list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - c{i}.v[i]) * (kept.v[i] - c{i}.v[i]))) AS d FROM kept, c{i})
    GROUP BY vec_id, v)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
    SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
        SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
        FROM (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))""")
    return ",".join(steps)


CENTROIDS = f"""
WITH {_rounds(5, 40)}
SELECT vec_id, a5.cluster AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a5.cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.v, ',')) AS centroid_sha256
FROM a5 JOIN c5 USING (cluster)
"""
