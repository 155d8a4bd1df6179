"""DuckDB statements of the corpus queries that SQL can express, written from their definitions."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
_ASCII_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED_WORDS = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_ASCII_WORDS}), []) AS w FROM documents),
i AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM (
    SELECT item_id, regexp_extract_all({_LOWER}, {_ASCII_WORDS}) AS w FROM benchmark)
  WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM (
    SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM i)),
doc_windows AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
    FROM d CROSS JOIN (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
hits AS (SELECT doc_id, s, k, item_id FROM doc_windows JOIN item_windows USING (k, win)),
words AS (
  SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

SUBSTRINGS = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, {_SPACED_WORDS}), []) AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS win FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
again AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM windows SEMI JOIN again USING (win)),
removed AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY p)) AS kept_sha256
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d)
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_SPACED_WORDS}), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS x FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS s FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common c JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c.n >= 85 * (p.n + q.n - c.n)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""

BYTE_STRINGS = """
WITH d AS (
  SELECT doc_id, x, octet_length(x) AS n FROM (
    SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents)),
windows AS (
  SELECT doc_id, s, x[s + 1:s + 50] AS win FROM (
    SELECT doc_id, x, unnest(range(0, n - 49)) AS s FROM d WHERE n >= 50)),
first AS (
  SELECT win, min(doc_id) AS first FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)),
starts AS (
  SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before
  FROM windows JOIN first USING (win) WHERE first < doc_id),
spans AS (
  SELECT doc_id, k, min(s) AS a, max(s) + 50 AS b FROM (
    SELECT *, sum(CASE WHEN s <= before + 50 THEN 0 ELSE 1 END) OVER (
      PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM starts)
  GROUP BY doc_id, k),
removed AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
edges AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL
  SELECT doc_id, coalesce(max(b), 0), max(n) FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (
  SELECT doc_id, sha256(unhex(string_agg(hex(x[a + 1:b]), '' ORDER BY a))) AS kept_sha256
  FROM edges JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM d LEFT JOIN removed USING (doc_id) JOIN kept USING (doc_id)"""

# base32 takes five bits of the digest at a time
RECORDS = """
WITH p AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages)),
digits AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)),
    '') AS payload_digest, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM digits"""

# crc32 is one step per bit; a window of 16 words recurs one period on in every run of 24 words or more
RUNS = f"""
WITH bits AS (
  SELECT doc_id, list_concat([0], flatten(list_transform(range(1, len(s) + 1),
    lambda i: [ascii(s[i]), -1, -1, -1, -1, -1, -1, -1, -1]))) AS b
  FROM (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents)),
sums AS (
  SELECT doc_id, xor(list_reduce(b, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
    WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295), 4294967295) AS h
  FROM bits),
given AS (
  SELECT doc_id, h, h // 10 AS g, len(w) AS n, w FROM (
    SELECT doc_id, coalesce(regexp_extract_all(text, {_SPACED_WORDS}), []) AS w FROM documents)
  JOIN sums USING (doc_id)),
cut AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM given WHERE h % 10 = 0 AND n > 0),
d AS (
  SELECT doc_id, n, w FROM given WHERE h % 10 <> 0 OR n = 0
  UNION ALL
  SELECT doc_id, n, list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i
    ELSE a + (i - a) % p END]) FROM cut),
windows AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1:i + 16], ' ') AS win FROM (
    SELECT doc_id, n, w, unnest(range(0, n - 15)) AS i FROM d WHERE n >= 24)),
periods AS (
  SELECT DISTINCT x.doc_id, y.i - x.i AS q FROM windows x JOIN windows y
  ON x.doc_id = y.doc_id AND x.win = y.win AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
equal AS (
  SELECT doc_id, q, i FROM (
    SELECT doc_id, q, n, w, unnest(range(0, n - q)) AS i FROM periods JOIN d USING (doc_id))
  WHERE w[i + 1] = w[i + q + 1]),
stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS size FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM equal)
  GROUP BY doc_id, q, k),
runs AS (
  SELECT doc_id, s, size, min(q) AS q FROM stretches WHERE size >= 24 AND size >= 3 * q
  GROUP BY doc_id, s, size),
listed AS (
  SELECT doc_id, count(*) AS n_runs,
    sha256(string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256
  FROM runs GROUP BY doc_id),
best AS (
  SELECT doc_id, s AS start, size AS length, q AS period FROM runs r
  WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE b.doc_id = r.doc_id AND (b.size * r.q > r.size * b.q
    OR (b.size * r.q = r.size * b.q AND (b.s < r.s OR (b.s = r.s AND b.q < r.q)))))),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + size)) AS i FROM runs),
kept AS (
  SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM d)
  ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period,
  1000 * length // period AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256,
  coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""
