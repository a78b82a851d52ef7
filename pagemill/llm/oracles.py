"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100
"""

OP2 = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), rows_ AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
         regexp_replace(coalesce(host, ''), '^[^@]*@|:[0-9]*$', '', 'g') AS name FROM s
), named AS (
  SELECT *, string_split(name, '.') AS parts, array_to_string(string_split(name, '.')[-2:], '.') AS two FROM rows_
), placed AS (
  SELECT *, regexp_matches(name, '^\[|^[0-9.]+$') AS numeric_,
         two IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'co.nz', 'com.br', 'co.in', 'com.cn', 'co.za') AS long_ FROM named
), leveled AS (
  SELECT page_id, host, path,
         CASE WHEN numeric_ THEN name WHEN long_ THEN array_to_string(parts[-3:], '.') ELSE two END AS domain,
         CASE WHEN numeric_ THEN '' WHEN long_ THEN two ELSE parts[-1] END AS suffix FROM placed
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), h AS (
  SELECT host, domain, suffix, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
  FROM leveled LEFT JOIN l ON page_id = doc_id GROUP BY ALL
), d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL
), x AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL
), t AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM x
), x1 AS (SELECT x.*, m FROM x, t
), xs AS (SELECT sum((bad - n * m) * (bad - n * m)) AS q, sum(n * m * (1 - m)) AS v, sum(n * m * (1 - m) * (n - 1)) AS w FROM x1
), xk AS (SELECT CASE WHEN w > 0 THEN CASE WHEN q > v THEN least(1000, greatest(2, 1 / ((q - v) / w) - 1)) ELSE 1000 END ELSE 2 END AS s FROM xs
), x2 AS (SELECT suffix, (m * s + bad) / (s + n) AS mean FROM x1, xk
), d1 AS (SELECT d.*, mean AS m FROM d JOIN x2 USING (suffix)
), ds AS (SELECT sum((bad - n * m) * (bad - n * m)) AS q, sum(n * m * (1 - m)) AS v, sum(n * m * (1 - m) * (n - 1)) AS w FROM d1
), dk AS (SELECT CASE WHEN w > 0 THEN CASE WHEN q > v THEN least(1000, greatest(2, 1 / ((q - v) / w) - 1)) ELSE 1000 END ELSE 2 END AS s FROM ds
), d2 AS (SELECT suffix, domain, (m * s + bad) / (s + n) AS mean FROM d1, dk
), h1 AS (SELECT h.*, mean AS m FROM h JOIN d2 USING (suffix, domain)
), hs AS (SELECT sum((bad - n * m) * (bad - n * m)) AS q, sum(n * m * (1 - m)) AS v, sum(n * m * (1 - m) * (n - 1)) AS w FROM h1
), hk AS (SELECT CASE WHEN w > 0 THEN CASE WHEN q > v THEN least(1000, greatest(2, 1 / ((q - v) / w) - 1)) ELSE 1000 END ELSE 2 END AS s FROM hs
), h2 AS (SELECT host, m * s + bad AS a, (1 - m) * s + n - bad AS b FROM h1, hk
), h3 AS (SELECT host, greatest(0, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS low FROM h2
), judged AS (
  SELECT page_id, r.host, path,
         CASE WHEN (r.host = 'example.com' OR r.host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
              WHEN (r.host = 'example.net' OR r.host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
              WHEN (r.host = 'com' OR r.host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
              WHEN (r.host = 'net' OR r.host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
              WHEN (r.host = 'org' OR r.host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule, low
  FROM rows_ r JOIN h3 USING (host)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, w[i : i + 9] AS p FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS x(i) WHERE len(w) > 0
), lengths AS (
  SELECT DISTINCT len(p) AS n FROM win
), grams AS (
  SELECT rid, i, n, w[i : i + n - 1] AS p FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS x(i)
), hit AS (
  SELECT rid, i, n, item FROM grams JOIN win USING (p)
), covered AS (
  SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM hit) AS h, unnest(range(i, i + n)) AS x(j) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""

OP4 = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, sha256(coalesce(text, '')) AS h FROM conversations
  UNION ALL
  SELECT -7, i, x, '\### Assistant: </turn> ok', x, '' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, x)
), e AS (
  SELECT *, 6 + 6 + 7
    + len(role) + len(role) - len(replace(role, '\', '')) + (len(regexp_replace(role, '<turn>|<says>', '<turn>!', 'g')) - len(role)) + (len(replace(role, '</turn>', '</turn>!')) - len(role))
    + len(text) + len(text) - len(replace(text, '\', '')) + (len(regexp_replace(text, '<turn>', '<turn>!', 'g')) - len(text)) + (len(replace(text, '<says>', '<says>!')) - len(text)) + (len(replace(text, '</turn>', '</turn>!')) - len(text)) AS formatted
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, h)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, h) FILTER (r = 'assistant'), '')) AS loss_sha256,
       CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES = {
    "op1_warc_normalise": OP1,
    "op2_url_reputation": OP2,
    "op3_positional_decontamination": OP3,
    "op4_chat_tokens": OP4,
}
