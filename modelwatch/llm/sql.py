"""The corpus queries that SQL can express, as DuckDB statements over whole tables."""

from __future__ import annotations

LOWER = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORDS = "regexp_extract_all(" + LOWER + r", '[^\x20\x09-\x0D]+')"
ALNUM_WORDS = "regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {SPACE_WORDS.format(c='text')} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS r FROM both_ways UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON reach.r = x),
smallest AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN smallest USING (doc_id)"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS.format(c='text')} AS w FROM documents),
b AS (SELECT item_id, {ALNUM_WORDS.format(c='text')} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, size, item_id FROM doc_windows JOIN item_windows USING (size, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, strlen(h) AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first_page,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((('0x' || substr(sha1(h), 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '')
           AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM d"""

REPEATED_BYTES = """
WITH d AS (
  SELECT doc_id, raw, hex(raw) AS h, octet_length(raw) AS n FROM (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents)),
w AS (
  SELECT doc_id, s, md5(array_slice(raw, CAST(s + 1 AS BIGINT), CAST(s + 400 AS BIGINT))) AS k
  FROM (SELECT doc_id, raw, unnest(range(0, n - 399)) AS s FROM d WHERE n >= 400)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
i AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 THEN 0 ELSE 1 END AS first_one FROM r),
g AS (SELECT doc_id, s, sum(first_one) OVER (PARTITION BY doc_id ORDER BY s) AS grp FROM i),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS b FROM g GROUP BY doc_id, grp),
gaps AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
kept AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last_end,
         string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS pieces
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN pieces IS NULL THEN h ELSE pieces || substr(h, CAST(2 * last_end + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def _whole(scale: int, sized: str) -> str:
    """Vectors without null or non-finite components, as integers."""
    return f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND {sized}
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))]) = len(embedding))"""


def clusters(k: int = 8, rounds: int = 10) -> str:
    """K-means with every round written out; a vector's best (distance, centroid) is one number, distance * k + centroid."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, min(d * {k} + c) AS best
  FROM (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM flat JOIN c{i} USING (i) GROUP BY r, c) GROUP BY r),
c{i + 1} AS MATERIALIZED (
  SELECT c, i, coalesce(CAST(floor(s / n) AS BIGINT), y) AS y
  FROM c{i} LEFT JOIN (
    SELECT best % {k} AS c, i, CAST(sum(x) AS DOUBLE) AS s, count(*) AS n FROM flat JOIN a{i} USING (r) GROUP BY ALL) USING (c, i))""")
    return f"""
WITH {_whole(1024, "len(embedding) = 64")},
flat AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
seeds AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
  FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM v ORDER BY h, v LIMIT {k})),
c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM seeds),{",".join(steps)},
digests AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, best // {k} AS distance,
       CAST(sum(best // {k}) OVER (PARTITION BY best % {k}) AS BIGINT) AS cluster_inertia,
       CAST(sum(best // {k}) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN digests ON c = best % {k}"""


def vector_codes(entries: int = 64, rounds: int = 2) -> str:
    """Product codes with every round written out; parts are 0 to 15, each of four components."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, p, min(d * {entries} + e) AS best
  FROM (SELECT r, p, e, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM flat JOIN b{i} USING (p, i) GROUP BY r, p, e) GROUP BY r, p),
b{i + 1} AS MATERIALIZED (
  SELECT p, e, i, coalesce(CAST(floor(s / n) AS BIGINT), y) AS y
  FROM b{i} LEFT JOIN (
    SELECT p, best % {entries} AS e, i, CAST(sum(x) AS DOUBLE) AS s, count(*) AS n FROM flat JOIN a{i} USING (r, p) GROUP BY ALL
  ) USING (p, e, i))""")
    return f"""
WITH {_whole(256, "len(embedding) = 64")},
flat AS MATERIALIZED (
  SELECT r, x, (s - 1) // 4 AS p, (s - 1) % 4 AS i FROM (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS s FROM v)),
seeds AS (
  SELECT row_number() OVER (ORDER BY vec_id, v) - 1 AS e, v FROM (SELECT vec_id, v FROM v ORDER BY vec_id NULLS LAST, v LIMIT {entries})),
b0 AS MATERIALIZED (
  SELECT e, y, (s - 1) // 4 AS p, (s - 1) % 4 AS i FROM (SELECT e, unnest(v) AS y, generate_subscripts(v, 1) AS s FROM seeds)),{",".join(steps)},
codes AS (
  SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error
  FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN codes USING (r)"""


SQL = {
    "op2_minhash_near_dedup": NEAR_DUPLICATES,
    "op3_decontamination": CONTAMINATION,
    "op5_warc": ARCHIVES,
    "op10_suffix_dedup": REPEATED_BYTES,
    "op12_centroid_clustering": clusters(),
    "op13_vector_codes": vector_codes(),
}
