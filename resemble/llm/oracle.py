"""DuckDB twins of the subpackage's queries, where SQL can express them."""

ORACLE = {}

ORACLE["op2_chat_perspectives"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS s, replace(coalesce(text, ''), '<|im_', '<| im_') AS x FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, s AS perspective FROM t WHERE s <> 'system'),
r AS (SELECT t.*, perspective, CASE WHEN s = 'system' THEN s WHEN s = perspective THEN 'assistant' ELSE 'user' END AS role
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.c),
n AS (SELECT *, CASE WHEN role = 'user' THEN regexp_replace(s, '[^A-Za-z0-9_-]', '_', 'g') END AS name FROM r),
h AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM n),
g AS (SELECT *, head || x || '<|im_end|>' || chr(10) AS segment FROM h)
SELECT conv_id, perspective, turn, role, name, segment,
       CASE WHEN role = 'assistant' THEN length(head) ELSE 0 END::BIGINT AS mask_start,
       CASE WHEN role = 'assistant' THEN length(segment) - 1 ELSE 0 END::BIGINT AS mask_end FROM g
"""

ORACLE["op3_url_bloom_cascade"] = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
             ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
x AS (SELECT u.*, (SELECT max_by({'rule': r.h || r.p, 'verdict': r.verdict}, length(r.h || r.p)) FROM r
        WHERE (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)) AS m FROM u)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, CASE WHEN list_has_any(string_split_regex(host, '[.-]'),
    ['adult', 'bets', 'casino', 'pills', 'poker', 'porn', 'spam', 'xxx']) THEN 'block' ELSE 'allow' END) AS verdict FROM x
"""

ORACLE["op8_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE
        list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b),
c AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.c, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ORACLE["op10_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id,
             list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) <= 13 THEN [array_to_string(w, ' ')] ELSE
             list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) END) AS p,
             least(len(w), 13) AS k FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i,
             unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS p
       FROM d, ks WHERE len(w) >= k),
m AS (SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.p = bw.p AND dw.k = bw.k),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
      FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

# the pages' main text is their article; references cut short at a text's end are decoded as browsers do
ORACLE["op1_html_text_density"] = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'),
             '</?b>', '', 'g'), '&amp(<|$)', '&amp;\1', 'g') AS x FROM pages),
t AS (SELECT page_id, url, replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&copy;', '©'),
             '&middot;', '·'), '&amp;', '&') AS x FROM a),
n AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM t)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM n
"""

ORACLE["op6_bwt_substring_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS g
      FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
m AS (SELECT g, min(doc_id) AS lo FROM s GROUP BY g),
c AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM s JOIN m USING (g) WHERE lo < doc_id),
k AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS span FROM c),
sp AS (SELECT r, span, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY r, span),
q AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM sp),
g AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
             string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head FROM q JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""

# crc32 of the distinct words, byte by byte, with a table made by the checksum's rule
ORACLE["op11_importance_resampling"] = r"""
WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id,
        list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM benchmark),
dw AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
bw AS MATERIALIZED (SELECT w, count(*) AS n FROM b GROUP BY w),
v AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
byte(w, i, x) AS (SELECT w, unnest(range(1, strlen(w) + 1)), unnest(list_transform(range(1, strlen(w) + 1),
          lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)) FROM v),
seq AS (SELECT w, list(x ORDER BY i) AS xs FROM byte GROUP BY w),
h AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, xs),
          lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS k FROM seq, tab),
s AS (SELECT k, sum(n) AS n FROM dw JOIN h USING (w) GROUP BY k),
t AS (SELECT k, sum(n) AS n FROM bw JOIN h USING (w) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000)
          / ((s.n::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (k)),
m AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM dw JOIN h USING (w) JOIN g USING (k) GROUP BY r),
x AS (SELECT r, doc_id, len(w)::BIGINT AS n, coalesce(weight, 0) AS weight,
        ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS hash FROM d LEFT JOIN m USING (r)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((hash + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS k, count(*) OVER (PARTITION BY n >= 20) AS total FROM y)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN n >= 20 AND k <= total * 10 // 100 THEN k END AS "rank" FROM z
"""

ORACLE["op13_hard_negatives"] = r"""
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT a.id AS anchor_id, b.id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE alike
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS "rank",
       id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN p USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY "rank" <= 5
"""
