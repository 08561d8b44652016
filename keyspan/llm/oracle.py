"""SQL for the contract queries, where SQL expresses them."""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
pages_ AS (SELECT row_number() OVER () AS r, page_id, url FROM pages),
parts AS (SELECT r, page_id, coalesce({_LOWER.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")}, '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages_),
fits AS (SELECT r, h || p AS rule, v FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT r, rule, v FROM fits QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (r)
"""

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS k FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(len(w) - least(len(w), 13) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, dw.n AS n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

#: Sets by an inverted index, then the least id along links of any length.
OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s + 1 : s + n], ' ') AS k FROM (SELECT doc_id, w, least(len(w), 3) AS n, unnest(range(len(w) - least(len(w), 3) + 1)) AS s FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach(a, b) AS (SELECT x, y FROM links UNION SELECT a, y FROM reach JOIN links ON b = x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM d LEFT JOIN sizes USING (doc_id)
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 50], ' ') AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS f FROM win) WHERE f < doc_id),
gone AS (SELECT doc_id, list(DISTINCT pos) AS p FROM (SELECT doc_id, unnest(range(s, s + 50)) AS pos FROM late) GROUP BY doc_id),
left_ AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d) ANTI JOIN (SELECT doc_id, unnest(p) AS i FROM gone) USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN left_ USING (doc_id)
"""
