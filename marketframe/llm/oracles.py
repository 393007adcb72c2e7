"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, {_SPACED}) AS w FROM documents),
f AS (SELECT rid, len(w) AS l, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
s AS (SELECT DISTINCT rid, g FROM (SELECT rid, l, p, string_agg(t, ' ') OVER v AS g, count(*) OVER v AS n FROM f
  WINDOW v AS (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5 OR (l < 5 AND p = 1)),
n AS (SELECT rid, doc_id, coalesce(n, 0) AS n FROM d LEFT JOIN (SELECT rid, count(*) AS n FROM s GROUP BY 1) USING (rid)),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
e AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM p JOIN n a ON a.rid = p.x JOIN n b ON b.rid = p.y WHERE 100 * c >= 75 * (a.n + b.n - c) AND a.doc_id <> b.doc_id),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(y, doc_id)) AS kept FROM n LEFT JOIN c ON c.x = n.doc_id"""

DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, {_LETTERS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, {_LETTERS}) AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0))),
f AS (SELECT rid, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
l AS (SELECT rid, p AS i, list(t) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS z FROM f),
u AS (SELECT rid, i, k, array_to_string(z[1:k], ' ') AS g FROM l, (SELECT DISTINCT k FROM v) WHERE len(z) >= k),
m AS (SELECT rid, i, k, g FROM u SEMI JOIN v USING (k, g)),
h AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
t AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m JOIN v USING (k, g) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)"""

SUBSTRING_DEDUP = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
f AS (SELECT rid, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
u AS (SELECT rid, p AS i, md5(g) AS g FROM (SELECT rid, p, string_agg(t, ' ') OVER v AS g, count(*) OVER v AS n FROM f
  WINDOW v AS (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) WHERE n = 35),
m AS (SELECT rid, i FROM u SEMI JOIN (SELECT g FROM u GROUP BY 1 HAVING count(*) > 1) USING (g)),
x AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM m),
k AS (SELECT rid, string_agg(t, ' ' ORDER BY p) AS kept FROM f ANTI JOIN x USING (rid, p) GROUP BY 1),
c AS (SELECT rid, count(*) AS n FROM x GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid) LEFT JOIN c USING (rid)"""

_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

LEXICAL_SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, {_TERMS}) AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all({_LOW}, {_TERMS}) AS w FROM benchmark),
q AS (SELECT DISTINCT iid, item_id, unnest(w) AS t FROM i),
c AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
f AS (SELECT rid, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d),
p AS (SELECT rid, doc_id, n, t, count(*)::BIGINT AS tf FROM f SEMI JOIN q USING (t) GROUP BY ALL),
x AS (SELECT t, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY t, c.n),
s AS (SELECT iid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * p.n * c.n) // c.l))))::BIGINT AS score
  FROM q JOIN x USING (t) JOIN p USING (t), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50"""
