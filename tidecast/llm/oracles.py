"""DuckDB SQL for the queries whose results it can express over whole tables."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

DECONTAMINATION = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
dwin AS (SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS t FROM (
  SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT r, s, k, item_id FROM dwin JOIN win USING (k, t)),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r),
own AS (SELECT r, count(*) AS n, sha256(string_agg(i, ',' ORDER BY i)) AS h
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items,
  coalesce(own.h, sha256('')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN own USING (r)"""

WINDOW_DEDUP = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
v AS (SELECT r, doc_id, s, array_to_string(w[s:s + 49], ' ') AS t
  FROM (SELECT *, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
f AS (SELECT t, min(doc_id) AS first FROM v GROUP BY t),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 50)) AS i FROM v JOIN f USING (t) WHERE first < doc_id),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS k
  FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)"""

JACCARD_JOIN = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWERED)} AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[s:s + least(len(w), 3) - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.t = b.t AND a.r <> b.r GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach ON reach.a = d.r JOIN d o ON o.r = reach.b GROUP BY d.r, d.doc_id, n.n"""
