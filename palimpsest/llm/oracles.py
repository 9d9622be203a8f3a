"""DuckDB's SQL for the operators that it can express: brute force over all rows."""

ORACLES: dict[str, str] = {}

_HOST = "translate(regexp_extract(coalesce({0}, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce({0}, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"
_KEY = f"CASE WHEN contains({{0}}, '://') THEN {_HOST} || regexp_extract({{0}}, '^.*?://[^/?#]*([^#]*)', 1, 's') END"
_FITS = "(host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)"

# Rules by longest match; components by walking from every URL that names another one or is named.
ORACLES["op1_url_filters"] = rf"""WITH RECURSIVE u AS (SELECT page_id, url, html, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path, {_KEY.format("url")} AS key FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM u JOIN rules ON {_FITS} GROUP BY page_id),
tags AS (SELECT url, key, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)', '', 'gis'), '<(?:link|meta)\b[^<>]*>', 0, 'is')) AS tag FROM u WHERE regexp_matches(html, 'canonical|refresh', 'i')),
said AS (SELECT url, key, CASE WHEN regexp_matches(tag, '^<link\b[^>]*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b', 'is') THEN regexp_extract(tag, '\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1, 'is')
  WHEN regexp_matches(tag, '^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?\s*refresh\b', 'is') THEN regexp_extract(tag, '\burl\s*=\s*([''"]?[^''">]+)', 1, 'is') END AS x FROM tags),
plain AS (SELECT url, key, replace(trim(regexp_replace(x, '[''"]', '', 'g')), '&amp;', '&') AS t, regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') AS origin, {_PATH.format("url")} AS path FROM said WHERE x IS NOT NULL),
named AS (SELECT url, key, CASE WHEN regexp_matches(t, '^[a-z][a-z0-9+.-]*://', 'i') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '^(.*?:)//', 1, 's') || t WHEN starts_with(t, '/') THEN origin || t
  WHEN t <> '' AND NOT regexp_matches(t, '^[#?]') AND NOT regexp_matches(t, '^[a-z][a-z0-9+.-]*:', 'i') THEN origin || CASE WHEN contains(path, '/') THEN regexp_replace(path, '[^/]*$', '') ELSE '/' END || t END AS other FROM plain),
edges AS (SELECT url, key, other, {_KEY.format("other")} AS other_key FROM named WHERE key <> {_KEY.format("other")}),
ends AS (SELECT key, url FROM edges UNION SELECT other_key, other FROM edges),
ways AS (SELECT key AS a, other_key AS b FROM edges UNION SELECT other_key, key FROM edges),
r AS (SELECT DISTINCT key AS node, key AS c FROM ends UNION SELECT r.node, ways.b FROM r JOIN ways ON ways.a = r.c),
aliases AS (SELECT node, min(c) AS component FROM r GROUP BY node),
judged AS (SELECT key, url, arg_max(v, length(h || p)) AS verdict FROM (SELECT key, url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM ends) JOIN rules ON {_FITS} GROUP BY key, url),
bad AS (SELECT DISTINCT component FROM judged JOIN aliases ON node = key WHERE verdict = 'block')
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad.component IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, aliases.component AS component
FROM u LEFT JOIN m USING (page_id) LEFT JOIN aliases ON node = key LEFT JOIN bad ON bad.component = aliases.component"""

_VALID = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLES["op3_exact_top_k"] = f"""WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_VALID}),
p AS (SELECT q.row AS row, q.vec_id AS query_id, s.vec_id AS vec_id, CAST(list_dot_product(q.e, s.e) AS BIGINT) AS score FROM v q JOIN v s ON q.vec_id <> s.vec_id AND len(q.e) = len(s.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""

ORACLES["op4_substring_dedup"] = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
least AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, s + unnest(range(13)) AS i FROM win JOIN least USING (h) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

ORACLES["op6_ngram_jaccard_join"] = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""

ORACLES["op9_embedding_near_dedup"] = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND {_VALID} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM r GROUP BY vec_id"""
