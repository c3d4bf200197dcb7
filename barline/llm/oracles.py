"""DuckDB SQL that states what some of the queries return."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS words FROM documents),
w AS MATERIALIZED (
  SELECT r, i, hash(words[i:i+34]) AS h, words[i:i+34] AS win
  FROM d, LATERAL (SELECT unnest(range(1, len(words) - 33)) AS i) WHERE len(words) >= 35),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h, win) AS n FROM w) WHERE n > 1),
gone AS MATERIALIZED (SELECT DISTINCT r, i + k AS j FROM dup, LATERAL (SELECT unnest(range(0, 35)) AS k)),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY j) AS t
  FROM (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM d) x ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) g USING (r) LEFT JOIN kept USING (r)
"""

OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) x(n)),
s AS (
  SELECT *, 14 + length(role) + length(text)
    + length(role) - length(replace(replace(role, '\', ''), ':', '')) + length(text) - length(replace(text, '\', ''))
    + (length(role || chr(1) || text) - length(replace(role || chr(1) || text, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(role || chr(1) || text, '#{3,}'), lambda x: length(x) - 2)), 0) AS chars
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, false AS rewrites_history
FROM s GROUP BY conv_id
"""

# base32 of a SHA-1: each five hexadecimal digits are four base32 digits
OP3 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (k // 4)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS digest,
    min(page_id) OVER (PARTITION BY hex) AS first_id
  FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, CASE WHEN page_id = first_id THEN true END AS digest_ok
FROM d
"""

OP13 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
u AS (
  SELECT *, (len(parts) - (parts[len(parts)] = '')::INT)::BIGINT AS n,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 AS is_plain FROM u),
p AS (
  SELECT *, CASE WHEN a = n THEN text ELSE array_to_string(parts[1:a] || [''], chr(10)) END AS prefix,
    CASE WHEN b = n THEN text ELSE array_to_string(parts[1:b] || [''], chr(10)) END AS head FROM c),
o AS (
  SELECT *, substr(head, length(prefix) + 1) AS middle, substr(text, length(head) + 1) AS suffix,
    CASE WHEN is_plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM p)
SELECT doc_id, n, form, CASE WHEN NOT is_plain THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN NOT is_plain THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM o
"""
