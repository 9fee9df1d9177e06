"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from mediaweave.llm import quality as Ql

_WORD = r"[^\x20\x09-\x0D]+"
_LINE_FAILS = rf"""(
  NOT regexp_matches(x, '{Ql.LINE_END.replace("'", "''")}')
  OR regexp_matches(x, '{Ql.NAVIGATION}')
  OR (regexp_matches(x, '{Ql.SYMBOLS}')
      AND len(regexp_extract_all(x, '{Ql.SYMBOLS}')) * 5 >= len(regexp_extract_all(x, '{_WORD}')))
  OR (regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}') AND len(regexp_extract_all(x, '{_WORD}')) >= 4)
  OR regexp_matches(x, '{Ql.BOILERPLATE}'))"""

ORACLE: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l
  FROM documents),
g AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i+7], ' ')) AS n FROM g),
c AS (SELECT r, count(DISTINCT p) AS n_rep FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM h WHERE n > 1) GROUP BY r),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '{Ql.SYMBOLS}'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words,
         coalesce(list_sum(list_transform(list_filter(l, lambda x: {_LINE_FAILS}),
                                 lambda x: len(regexp_extract_all(x, '{_WORD}')))), 0)::BIGINT AS n_words_lost
  FROM d LEFT JOIN c USING (r))
SELECT *, (n_words < {Ql.MIN_WORDS} OR n_repeat_words * 100 > n_words * {Ql.MAX_REPEAT_PERCENT}) AS base_failed,
       NOT (n_words < {Ql.MIN_WORDS} OR n_repeat_words * 100 > n_words * {Ql.MAX_REPEAT_PERCENT})
         AND NOT (n_words_lost * 100 > n_words * {Ql.MAX_LOST_PERCENT}) AS kept
FROM m""",
    "op12_conversation_trie": r"""
WITH t AS (
  SELECT conv_id, turn, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS v FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list(v ORDER BY turn NULLS FIRST, v.r, v.x) AS own,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(
             string_split(conv_id::VARCHAR, ''), lambda b: [ord(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda k, b: CASE WHEN b >= 0 THEN xor(k, b) WHEN k % 2 = 1 THEN xor(k // 2, 3988292384) ELSE k // 2 END),
         4294967295) % 9 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, list_concat(coalesce(l.own[1:c.h], []), c.own[c.h + 1:]) AS s
  FROM c LEFT JOIN c AS l ON l.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM r),
n AS (
  SELECT s[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len(s)), '')) AS ends_sha256
  FROM p GROUP BY 1, 2),
m AS (
  SELECT n.*, u.conv_id AS parent_conv_id,
         (n.n_convs - 1) * coalesce(strlen(n.k[n.depth].x), 0) AS saved,
         (SELECT count(*) FROM n AS d WHERE d.depth = n.depth + 1 AND d.k[1:n.depth] = n.k) AS n_children
  FROM n LEFT JOIN n AS u ON u.depth = n.depth - 1 AND u.k = n.k[1:n.depth - 1]),
a AS (SELECT k[1:d] AS k, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
      FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth::BIGINT AS depth, m.parent_conv_id, m.n_convs, m.n_children, a.n_leaves::BIGINT AS n_leaves,
       a.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN a USING (k)""",
    "op13_ranked_search": r"""
WITH abc AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
      FROM documents, abc),
b AS (SELECT row_number() OVER () AS q, item_id,
             list_distinct(regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
      FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL), abc),
z AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
f AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
      FROM (SELECT t, count(*) AS df FROM p GROUP BY t), z),
m AS (SELECT r, doc_id, 10 + (90 * len(w) * n) // l AS m FROM d, z WHERE len(w) > 0),
s AS (SELECT q, item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score, any_value(doc_id) AS doc_id
      FROM (SELECT q, item_id, unnest(w) AS t FROM b) JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score,
             row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10""",
    "op3_decontamination": r"""
WITH abc AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents, abc),
b AS (SELECT item_id::VARCHAR AS item,
             regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark, abc),
n AS (SELECT item, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram, least(10, len(w)) AS k
      FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
      FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM n) WHERE len(w) >= k)),
m AS (SELECT g.r, g.i, g.k, n.item FROM g JOIN n USING (k, gram)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m)
      WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
    "op10_warc": r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, strlen(coalesce(html, '')) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, r) AS k,
             first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, r) AS first_page FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN k > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k > 1 AND payload_bytes >= 100 THEN first_page END AS refers_to
FROM f""",
}
