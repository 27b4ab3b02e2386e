"""DuckDB SQL for the queries that it can express."""

OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
shared AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND l.doc_id <> s.owner AS dropped
  FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


_BLANK = r"[ \t-\r]"
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PHRASES = (
    r"(?i)cookie(s)? policy|privacy policy|terms of (use|service)|enable javascript|all rights reserved|lorem ipsum|click here|read more"
    r"|sign (up|in)(?:$|[^\p{L}\p{N}_])|log ?in(?:$|[^\p{L}\p{N}_])|subscribe (to|now)|share (on|this)|follow us|skip to (main )?content"
    r"|back to top|previous post|next post|powered by"
)

OP7_SQL = rf"""
WITH T AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM T)),
places AS (
  SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM places GROUP BY doc_id),
L AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again,
         list_filter(regexp_split_to_array(line, '{_BLANK}+'), lambda x: x <> '') AS ws,
         length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
         len(list_filter(regexp_split_to_array(line, '{_SPACE}')[2:], lambda x: regexp_full_match(x, '[|»›•·>/]+'))) AS separators
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM T))),
M AS (
  SELECT *, len(ws) AS n, regexp_matches(line, '[.!?;:,…。！？，؟।]') AS sentence FROM L WHERE len(ws) > 0),
F AS (
  SELECT doc_id, again, length(regexp_replace(line, '{_BLANK}', '', 'g')) AS chars,
         again OR (symbols >= 3 AND symbols * 4 > n) OR (n >= 4 AND separators * 4 > n) OR (n <= 25 AND regexp_matches(line, '{_PHRASES}'))
         OR (n >= 5 AND regexp_matches(line, '\p{{Lu}}') AND NOT regexp_matches(line, '[\p{{Ll}}\p{{Lt}}]')) OR (n >= 10 AND len(list_distinct(ws)) * 10 < 3 * n)
         OR (NOT sentence AND (n >= 12 OR n <= 2))
         OR (sentence AND n <= 2 AND NOT contains(line, '.') AND NOT regexp_matches(line, '[.!?…。！？؟।]["''”’»)\]]*{_BLANK}*$')) AS fails
  FROM M),
G AS (
  SELECT doc_id, count(*) FILTER (WHERE again) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE fails), 0) AS lost FROM F GROUP BY doc_id),
B AS (
  SELECT T.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{_BLANK}', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::DOUBLE AS lost
  FROM T LEFT JOIN G ON T.doc_id = G.doc_id LEFT JOIN repeated ON T.doc_id = repeated.doc_id),
C AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN lost / word_chars ELSE 0 END AS loss FROM B)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND loss <= 0.4 AS kept, loss FROM C
"""
