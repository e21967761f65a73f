"""SQL that the queries of ``registry`` are held against."""

_LOG = """WITH log AS (SELECT event_type AS domain, event_id AS seq, CAST((event_id * 7919) % 1024 AS DOUBLE) / 1024.0 AS score, CASE WHEN user_id % 11 = 0 THEN 0 ELSE 5 END AS n_chunks, event_id % 3 AS attempt FROM events),
l AS (SELECT *, CAST(score AS DOUBLE) AS sc FROM log WHERE n_chunks > 0)"""

#: Two crawls of parts as lists; the leaves of an item; and what differs between leaves x and y at places in the list.
_LISTED = """WITH a AS (SELECT p_partkey // 50 AS page_id, p_partkey, p_retailprice AS price, 'b' AS t1 FROM part WHERE p_partkey % 13 <> 0),
b AS (SELECT p_partkey // 50 AS page_id, p_partkey, p_retailprice + CASE WHEN p_partkey % 7 = 0 THEN 1.0 ELSE 0.0 END AS price, CASE WHEN p_partkey % 5 = 0 THEN 'c' ELSE 'b' END AS t1 FROM part WHERE p_partkey % 11 <> 0)"""
_LEAVES = "LATERAL (VALUES ('k', CAST(p_partkey AS VARCHAR)), ('price', CAST(price AS VARCHAR)), ('tags.0', 'a'), ('tags.1', t1)) w(step, v)"
_CHANGES = """SELECT coalesce(x.page_id, y.page_id) AS page_id, '0.items.' || coalesce(x.at, y.at) AS path, CASE WHEN x.at IS NULL THEN 'added' WHEN y.at IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM x FULL JOIN y ON x.page_id = y.page_id AND x.at = y.at WHERE x.v IS DISTINCT FROM y.v"""

SQL: dict[str, str] = {
    "find_all_by_keys": "SELECT p_partkey // 50 AS page_id, p_partkey, p_name, p_retailprice FROM part",
    "find_any_keys": "SELECT p_partkey, p_brand FROM part",
    "find_by_key_pattern": "SELECT p_partkey FROM part",
    "find_by_type": "SELECT p_partkey, p_size FROM part WHERE p_size = 7",
    "find_all_predicate": "SELECT p_partkey FROM part WHERE p_retailprice > 950",
    "find_by_keys_first": "SELECT p_partkey // 50 AS page_id, min(p_partkey) AS p_partkey FROM part GROUP BY 1",
    "find_all_by_keys_dedupe": "SELECT s_suppkey // 10 AS page_id, s_suppkey, s_name FROM supplier",
    "find_text": "SELECT DISTINCT p_partkey // 50 AS page_id, p_brand AS text FROM part WHERE p_brand LIKE 'Brand#1%'",
    "chunk_keys": """
WITH r AS (SELECT s_suppkey // 10 AS page_id, 's' || (s_suppkey % 5) AS chunk_id, s_suppkey AS o, g FROM supplier, (VALUES (0), (1)) v(g)),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, chunk_id ORDER BY g, o) AS nth FROM r)
SELECT page_id, CASE WHEN nth = 1 THEN chunk_id ELSE chunk_id || '#' || nth END AS chunk_key, chunk_id, 'json' AS kind, 'dict' AS value_type FROM n""",
    "resolve_references": "SELECT o_custkey // 50 AS page_id, o_orderkey AS order_key, o_orderdate AS placed, o_totalprice AS total, c_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "text_rows": "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS digest, 'ok' AS status FROM documents WHERE text IS NOT NULL",
    "text_reference": "SELECT doc_id, md5(text) AS digest, CAST(NULL AS VARCHAR) AS missing FROM documents WHERE text IS NOT NULL",
    "nodes": """
SELECT 0 AS depth, 'dict' AS ntype, count(*) AS n, count(*) AS n_first, 0 AS n_scalar FROM part
UNION ALL SELECT 1, 'str', 3 * count(*), 3 * count(*), 3 * count(*) FROM part
UNION ALL SELECT 1, 'int', 2 * count(*), 2 * count(*), 2 * count(*) FROM part
UNION ALL SELECT 1, 'float', count(*), count(*), count(*) FROM part""",
    "page_stats": """
SELECT c_custkey // 50 AS page_id, count(*) AS chunk_count, count(*) FILTER (c_custkey % 7 NOT IN (0, 1)) AS json_chunk_count, count(*) FILTER (c_custkey % 7 IN (0, 1)) AS type_str,
  count(*) FILTER (c_custkey % 7 > 2) AS type_dict, count(*) FILTER (c_custkey % 7 = 2) AS type_list FROM customer GROUP BY 1""",
    "parse_confidence": "SELECT c_custkey // 50 AS page_id, count(*) AS n_judged, count(*) FILTER (c_custkey % 7 IN (0, 1)) AS n_raw, round(count(*) FILTER (c_custkey % 7 NOT IN (0, 1)) / count(*), 6) AS score FROM customer GROUP BY 1",
    "page_diff": """
SELECT p_partkey // 50 AS page_id, 'k' || p_partkey || '.p_retailprice' AS path,
  CASE WHEN p_partkey % 13 = 0 THEN 'added' WHEN p_partkey % 11 = 0 THEN 'removed' ELSE 'changed' END AS change
FROM part WHERE (p_partkey % 13 = 0) <> (p_partkey % 11 = 0) OR (p_partkey % 7 = 0 AND p_partkey % 13 <> 0 AND p_partkey % 11 <> 0)""",
    "throttle": f"""{_LOG},
r AS (SELECT *, avg(sc) OVER w AS rolling, count(*) OVER w AS n FROM l WINDOW w AS (PARTITION BY domain ORDER BY seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
t AS (SELECT *, n >= 3 AND rolling < 0.45 AS throttled FROM r),
b AS (SELECT *, coalesce(lag(throttled) OVER (PARTITION BY domain ORDER BY seq), false) AS before FROM t)
SELECT domain, seq, round(rolling, 6) AS rolling, throttled, CASE WHEN throttled AND NOT before THEN 'enter' WHEN before AND NOT throttled THEN 'leave' END AS step FROM b""",
    "drift": f"""{_LOG},
r AS (SELECT *, avg(sc) OVER w AS m, count(*) OVER w AS n FROM l WINDOW w AS (PARTITION BY domain ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT domain, seq, round(m, 6) AS mean_before FROM r WHERE n >= 5 AND m - sc >= 0.3""",
    "running_confidence": f"""{_LOG}
SELECT domain, seq, CAST(round(CAST(avg(sc) OVER (PARTITION BY domain ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(30, 15)), 4) AS DOUBLE) AS avg_confidence FROM l""",
    "crawl_stats": f"""{_LOG}
SELECT count(*) FILTER (n_chunks > 0) AS with_data, count(*) FILTER (n_chunks = 0) AS without_data, (SELECT round(avg(sc), 4) FROM l) AS avg_confidence FROM log""",
    "retries": f"{_LOG} SELECT domain, seq, CAST(attempt + 1 AS INTEGER) AS attempt FROM l WHERE sc < 0.5 AND attempt < 2",
    "crawl_dedupe": "SELECT min(event_id) AS seq FROM events GROUP BY user_id, event_type",
    "locale": """
SELECT page_id, nullif(regexp_extract(html, '<html[^>]+lang=["'']([a-zA-Z0-9_-]+)["'']', 1), '') AS locale,
  CASE WHEN regexp_extract(url, '^[a-z]+://[^/]*/([a-zA-Z]{2})(/|$)', 1) IN ('en', 'de', 'fr', 'es') THEN regexp_extract(url, '^[a-z]+://[^/]*/([a-zA-Z]{2})(/|$)', 1) END AS url_locale, 'unknown' AS router FROM pages""",
    "markers": """
WITH m AS (SELECT s_suppkey AS k, s_suppkey % 6 AS n, s_name FROM supplier)
SELECT k AS page_id, CASE n WHEN 0 THEN 'app' WHEN 1 THEN 'app' WHEN 2 THEN 'pages' WHEN 3 THEN 'static_export' WHEN 4 THEN 'static_export' ELSE 'unknown' END AS router,
  CASE n WHEN 0 THEN '13.0 - 13.3' WHEN 1 THEN '13.4 - 14.0' END AS version, CASE n WHEN 3 THEN 'webpack' END AS bundler, CASE n WHEN 5 THEN 'cloudflare' END AS challenge, CASE n WHEN 3 THEN '/docs' ELSE '' END AS base_path,
  'd' || k AS digest, '/api/s/' || k AS routes, md5(CAST(k AS VARCHAR)) AS actions, s_name AS title, CAST(k AS VARCHAR) AS site, CAST(k AS VARCHAR) AS sku, CASE n WHEN 2 THEN '{"a":1}' END AS props FROM m""",
    "redact": r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[\w.+-]+@[\w-]+\.\w+', '[REDACTED_EMAIL]', 'g'), '\+?\d[\d\-\s()]{7,}\d', '[REDACTED_PHONE]', 'g')) AS digest FROM documents",
    "domain": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM pages",
    "price": "SELECT p_partkey, round(p_retailprice, 2) AS amount, 'EUR' AS currency, round(p_retailprice, 2) AS plain, 'USD' AS plain_currency FROM part",
    "dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d0, CAST(o_orderdate AS DATE) AS d1, CAST(o_orderdate AS DATE) AS d2, CAST(o_orderdate AS DATE) AS d3, CAST(o_orderdate AS DATE) AS d4 FROM orders",
    "image_urls": "SELECT page_id, url, 640 AS width FROM pages",
    "cache_headers": """
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'HIT' ELSE 'STALE' END AS cache, CAST(s_suppkey AS INTEGER) AS s_maxage, 60 AS swr, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey AS INTEGER) END AS age,
  s_suppkey % 4 = 0 AS draft, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 2 END AS n_cookies FROM supplier""",
    "page_diff_lists": f"""{_LISTED},
l AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) - 1 AS i, * FROM a), r AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) - 1 AS i, * FROM b),
x AS (SELECT page_id, i || '.' || step AS at, v FROM (SELECT page_id, i, p_partkey, price, t1 FROM l), {_LEAVES}),
y AS (SELECT page_id, i || '.' || step AS at, v FROM (SELECT page_id, i, p_partkey, price, t1 FROM r), {_LEAVES})
{_CHANGES}""",
    "page_diff_keyed": f"""{_LISTED},
x AS (SELECT page_id, 'k=' || p_partkey AS i, step, v FROM a, {_LEAVES}),
y AS (SELECT page_id, 'k=' || p_partkey AS i, step, v FROM b, {_LEAVES})
SELECT coalesce(x.page_id, y.page_id) AS page_id, '0.items[' || coalesce(x.i, y.i) || '].' || coalesce(x.step, y.step) AS path, CASE WHEN x.i IS NULL THEN 'added' WHEN y.i IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM x FULL JOIN y ON x.page_id = y.page_id AND x.i = y.i AND x.step = y.step WHERE x.v IS DISTINCT FROM y.v""",
    "flat": f"""{_LISTED},
l AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) - 1 AS i, * FROM a)
SELECT page_id, '0.items.' || i || '.' || step AS path, CASE WHEN step IN ('tags.0', 'tags.1') THEN '"' || v || '"' ELSE v END AS value FROM (SELECT page_id, i, p_partkey, price, t1 FROM l), {_LEAVES}""",
    "crawl_hints": f"""{_LOG}
SELECT count(*) AS with_data, count(*) FILTER (seq % 10 = 0) AS stopped_early, count(*) FILTER (seq % 4 = 0) AS n_13, count(*) FILTER (seq % 4 = 1) AS n_15, count(*) FILTER (seq % 4 > 1) AS n_unknown FROM l""",
    "first_hints": f"""{_LOG} SELECT domain, CASE min(seq) % 4 WHEN 0 THEN '13.0' ELSE '15.0+' END AS hint FROM log WHERE seq % 4 < 2 GROUP BY domain""",
    "find_urls": """
SELECT s_suppkey AS page_id, CAST(ord AS INTEGER) AS ord, CASE ord WHEN 0 THEN '/s/' || s_suppkey WHEN 1 THEN 'https://x.example/' || s_suppkey ELSE '/t/' || s_suppkey || '?q=1' END AS url FROM supplier, range(3) t(ord)""",
    "find_urls_keys": """
SELECT s_suppkey AS page_id, u AS url FROM supplier, unnest(['/s/' || s_suppkey, 'https://x.example/' || s_suppkey, '/t/' || s_suppkey || '?q=1']) t(u) WHERE regexp_matches(u, '^/|/1')""",
    "follow_urls": """
SELECT s_suppkey, u AS link, 'https://s.example' || u AS target FROM supplier, unnest(['/s/' || s_suppkey, '/t/' || s_suppkey || '?q=1']) t(u)""",
    "similar_keys": "SELECT DISTINCT p_partkey // 50 AS page_id, w AS wanted, k AS key FROM part, (VALUES ('p_nane', 'p_name'), ('retailprice', 'p_retailprice')) v(w, k)",
    "find_pagination": """
SELECT c_custkey AS page_id, CASE c_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 3 END AS preference, CASE c_custkey % 6 WHEN 0 THEN 'b' WHEN 1 THEN 'c' WHEN 2 THEN 'e' ELSE 'n' END || c_custkey AS cursor
FROM customer WHERE c_custkey % 6 < 4""",
    "shapes": """SELECT p_partkey // 50 AS page_id, '0' AS chunk_key, '{"items": [{"k": "int", "price": "float", "tags": "list"}]}' AS shape FROM part WHERE p_partkey % 13 <> 0 GROUP BY 1""",
    "keys_of": """
SELECT doc_id AS page_id, '1,2,3,4,5,6,7' AS keys, 7 AS n, '3,4,6' AS json_keys, '1,2' AS text_keys, '1' AS html_keys FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL""",
    "resolved_some": """
SELECT doc_id AS page_id, w AS which, k AS chunk_key, t AS value_type FROM documents, (VALUES ('json', '3', 'dict'), ('json', '4', 'list'), ('json', '6', 'list'), ('text', '1', 'str'), ('text', '2', 'str'), ('html', '1', 'str')) v(w, k, t)
WHERE text IS NOT NULL AND lang IS NOT NULL""",
    "with_chunk": "SELECT doc_id AS page_id, true AS has_3, 'json' AS kind_3, doc_id, false AS has_9 FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL",
    "repair": "SELECT 'repaired' AS status, c_custkey, c_name, CASE c_custkey % 3 WHEN 0 THEN 'x,y' END AS list FROM customer",
    "not_repaired": "SELECT 'raw' AS status, 'str' AS value_type, count(*) AS n FROM customer",
    "streamed": """
SELECT s_suppkey AS page_id, '0' AS static_chunks, CASE WHEN s_suppkey % 4 <> 0 THEN '1,2,3' ELSE '' END AS dynamic_chunks, s_suppkey % 2 = 1 AS is_ppr FROM supplier""",
    "push_indexes": """
SELECT s_suppkey AS page_id, k AS chunk_id, i AS push_idx FROM supplier, (VALUES ('0', 0), ('1', 1), ('2', 1), ('3', 2)) v(k, i) WHERE s_suppkey % 4 <> 0 OR k = '0'""",
    "skeletons": "SELECT s_suppkey AS page_id, s_suppkey % 4 = 0 AS is_skeleton FROM supplier",
    "raw_streams": "SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 4 IN (0, 3) THEN 1 ELSE 0 END AS n, s_suppkey % 4 IN (0, 3) AS is_stream FROM supplier",
    "segments": "SELECT s_suppkey, s_suppkey % 5 = 0 AS is_slot, s_suppkey % 5 IN (1, 2) AS is_intercepting FROM supplier",
    "chunk_urls": """
SELECT s_suppkey, concat('/docs/_next/static/chunks/', s_suppkey, '.js,/_next/static/chunks/main.js') AS urls, concat('/docs/_next/static/chunks/', s_suppkey, '.js') AS docs, '/_next/static/chunks/main.js' AS main, CAST(s_suppkey AS VARCHAR) AS build_id FROM supplier""",
    "protection": "SELECT s_suppkey, s_suppkey % 4 < 2 AS protected FROM supplier",
    "response_headers": """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'Wed, 21 Oct 2026 07:28:00 GMT' END AS retry_after, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS retry_seconds,
  CASE WHEN s_suppkey % 3 = 1 THEN '7' ELSE CAST(s_suppkey AS VARCHAR) END AS remaining, CAST(s_suppkey AS VARCHAR) AS reset, 'DE' AS country, CAST(s_suppkey AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS region,
  CASE WHEN s_suppkey % 3 = 2 THEN '/else' ELSE '/to' END AS rewrite FROM supplier""",
    "clean_text": r"SELECT doc_id, md5(trim(regexp_replace(concat('a&b ', 'é', text, ' A'), '[\s\x0B\x1C-\x1F\x85\p{Z}]+', ' ', 'g'))) AS digest FROM documents WHERE text IS NOT NULL",
    "extract_as": """
SELECT p_partkey // 50 AS page_id, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name, arg_min(p_retailprice, p_partkey) AS p_retailprice, CAST(arg_min(p_size, p_partkey) AS INTEGER) AS p_size, CAST(NULL AS VARCHAR) AS tags FROM part GROUP BY 1""",
    "extract_as_missing": "SELECT DISTINCT c_custkey // 50 AS page_id, 'p_partkey,p_name,p_retailprice' AS missing FROM customer WHERE c_custkey % 7 > 2",
    "records": "SELECT p_partkey, p_type FROM part",
    "find_one": "SELECT p_partkey // 50 AS page_id, min(p_partkey) AS p_partkey, arg_min(p_size, p_partkey) AS p_size FROM part WHERE p_size > 25 GROUP BY 1",
    "pipeline_matches": "SELECT s_suppkey // 10 AS page_id, s_suppkey, s_name FROM supplier",
    "page_objects": """
WITH r AS (SELECT s_suppkey // 10 AS page_id, 's' || (s_suppkey % 5) AS chunk_id, s_suppkey, s_name, g FROM supplier, (VALUES (0), (1)) v(g)),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, chunk_id ORDER BY g, s_suppkey) AS nth FROM r)
SELECT page_id, CASE WHEN nth = 1 THEN chunk_id ELSE chunk_id || '#' || nth END AS chunk_key, s_suppkey, s_name FROM n""",
    "csv_records": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand, p_type FROM part",
    "stream_requests": r"""
WITH p AS (SELECT *, CASE page_id % 5 WHEN 0 THEN false WHEN 1 THEN true ELSE regexp_matches(url, '[02468]$') END AS stream FROM pages)
SELECT page_id, stream, CASE WHEN stream THEN '1' END AS rsc, CASE WHEN page_id % 2 = 0 THEN '/own' WHEN stream THEN coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') END AS next_url FROM p""",
    "action_meta": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS action_id, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey AS VARCHAR) END AS cursor, CASE WHEN s_suppkey % 3 <> 0 THEN 3 ELSE 0 END AS n FROM supplier",
    "version_registry": "SELECT s_suppkey AS page_id, CASE s_suppkey % 6 WHEN 0 THEN '13.0 - 13.3' WHEN 1 THEN '13.4 - 14.0' END AS version, 'any' AS own FROM supplier",
}
