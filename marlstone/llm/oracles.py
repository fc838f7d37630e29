"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from marlstone.llm.url_filters import BUSINESS

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
h AS (SELECT doc_id, ls, list_transform(ls, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS hs FROM d),
m AS (SELECT doc_id, ls, list_transform(hs, lambda x, i: (coalesce(hs[i - 1], 0) * 31 + x) % 3 = 0) AS ms FROM h),
e AS (SELECT doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: i = len(ls) OR (i >= 2 AND i <= len(ls) - 2 AND ms[i] AND NOT ms[i - 1])) AS es FROM m),
c AS (SELECT doc_id, ls, es, unnest(range(0, len(es))) AS pos FROM e),
t AS (SELECT doc_id, pos, coalesce(es[pos], 0) AS s, es[pos + 1] AS f, array_to_string(ls[coalesce(es[pos], 0) + 1 : es[pos + 1]], chr(10)) AS t FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS k FROM t WHERE f - s >= 2
      UNION ALL SELECT *, 1 FROM t WHERE f - s < 2)
SELECT doc_id, CAST(sum(f - s) AS INTEGER) AS n_lines, CAST(count(*) AS INTEGER) AS n_chunks,
       CAST(coalesce(sum(f - s) FILTER (WHERE k > 1), 0) AS INTEGER) AS n_removed_lines,
       coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (WHERE k = 1), '') AS text
FROM r GROUP BY doc_id
"""

URL_FILTERS = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(action, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hit AS (
  SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(action, length(rh || rp)) AS action
  FROM u, rules WHERE ('.' || host) LIKE ('%.' || rh) AND starts_with(path, rp) GROUP BY page_id)
SELECT u.page_id, host, path, rule,
       coalesce(action, CASE WHEN regexp_matches(host || path, '^([^/]*[.-])?(WORDS)([.-][^/]*)?(/|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN hit USING (page_id)
""".replace("WORDS", "|".join(word for words in BUSINESS.values() for word in words.split()))

QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
p AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
q AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM q, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN n USING (doc_id)),
f AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
              + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT AS BIGINT) AS failures
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
o AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (SELECT o.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM o ANTI JOIN g USING (doc_id, i) GROUP BY o.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

TOPK_SEARCH = r"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP,
    "op4_url_filters": URL_FILTERS,
    "op5_topk_search": TOPK_SEARCH,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op7_quality_rules": QUALITY_RULES,
}
