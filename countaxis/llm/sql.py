"""DuckDB SQL for the queries that SQL can express, over whole tables."""

# fmt: off
UP, LO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP4_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LO}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS shingle
  FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 75 * (x.n + y.n - o.o)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""
OP5_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM h, unnest(range(0, len(h) // 2 - 99)) AS t(p)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
flag AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS f FROM dup),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(f) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM flag) GROUP BY doc_id, g),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
gone AS (SELECT c.doc_id, count(*) AS n, sum(b - a) AS removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last FROM cuts c JOIN h ON h.doc_id = c.doc_id GROUP BY c.doc_id)
SELECT h.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM h LEFT JOIN gone g ON g.doc_id = h.doc_id
"""
OP6_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LO}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {OP6_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s FROM i, unnest(range(1, greatest(len(w) - 8, 2))) AS t(p) WHERE len(w) > 0),
d AS (SELECT doc_id, {OP6_WORDS} AS w FROM documents),
spots AS (SELECT doc_id, k.m, p, array_to_string(w[p:p + k.m - 1], ' ') AS s FROM d, (SELECT DISTINCT m FROM win) k, unnest(range(1, greatest(len(w) - k.m + 2, 1))) AS t(p)),
hits AS (SELECT a.doc_id, a.p, a.m, win.item FROM spots a JOIN win ON win.m = a.m AND win.s = a.s),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM hits, unnest(range(p, p + m)) AS t(q) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1),
starts AS (SELECT DISTINCT h.doc_id, h.p, h.m, h.item, w.q FROM hits h JOIN (SELECT item, s, m, q FROM (SELECT item, least(len(w), 10) AS m, q, array_to_string(w[q:q + least(len(w), 10) - 1], ' ') AS s FROM i, unnest(range(1, greatest(len(w) - 8, 2))) AS t(q) WHERE len(w) > 0)) w ON w.item = h.item AND w.m = h.m
  JOIN spots a ON a.doc_id = h.doc_id AND a.p = h.p AND a.m = h.m AND a.s = w.s),
chain AS (SELECT doc_id, item, m, p - q AS diagonal, p - row_number() OVER (PARTITION BY doc_id, item, m, p - q ORDER BY p) AS run FROM starts),
longest AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, count(*) + any_value(m) - 1 AS n FROM chain GROUP BY doc_id, item, m, diagonal, run) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(y.n, 0) AS BIGINT) AS n_items, sha256(coalesce(y.ids, '')) AS items_sha256, coalesce(x.n, 0) > 0 AS contaminated, CAST(coalesce(z.n, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN words x ON x.doc_id = d.doc_id LEFT JOIN items y ON y.doc_id = d.doc_id LEFT JOIN longest z ON z.doc_id = d.doc_id
"""
OP3_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(list_zip(q.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM d
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: floor(256 * e)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: CAST(p[1] AS BIGINT) * CAST(p[2] AS BIGINT))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM d
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
