"""SQL twins (DuckDB) of the conversation queries."""

from __future__ import annotations

WORDS = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"

# crc32 of an ASCII string, byte by byte over a table made from the polynomial
CRC_TABLE = """tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, i)) AS t)"""


def crc32(text: str) -> str:
    step = "lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: ascii(ch)), {step}, 4294967295), 4294967295)"


REPAIR = rf"""
WITH RECURSIVE {CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
      FROM conversations, tab),
bad AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
          CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
          unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
        FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS x,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM bad),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
        lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (i > 1 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
after AS (SELECT * FROM (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')) v(s, x, t)),
put AS (SELECT * FROM (VALUES ('', '', 0), ('s', 's', 0), ('u', 'u', 0), ('a', 'a', 0), ('', 'u', 1), ('s', 'u', 1), ('a', 'u', 1),
                              ('u', 'a', 1), ('', 'a', 2), ('s', 'a', 2)) v(s, m, n)),
moves AS (
  SELECT s, m AS t, 'D' AS op, '' AS x, n * 3 + 4 AS cost, repeat('I', n) || 'D' AS letters FROM put
  UNION ALL SELECT put.s, t, 'K', x, n * 3, repeat('I', n) || 'K' FROM put JOIN after ON after.s = m
  UNION ALL SELECT put.s, t, 'R', '', n * 3 + 3, repeat('I', n) || 'R' FROM put JOIN after ON after.s = m AND x IN ('u', 'a')),
st AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS s, '000000000' AS w FROM ids
  UNION ALL
  SELECT st.conv_id, st.i + 1, m.t, min(lpad((w[:9]::BIGINT + m.cost + CASE WHEN fault = 'truncated' AND op <> 'D' THEN 3 ELSE 0 END)::VARCHAR,
                                            9, '0') || w[10:] || letters)
  FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.i = st.i + 1
          JOIN moves m ON m.s = st.s AND (op = 'D' OR (fault IN ('', 'truncated') AND (op = 'R' OR m.x = f.x)))
  GROUP BY st.conv_id, st.i, m.t),
best AS (
  SELECT st.conv_id, min(lpad((w[:9]::BIGINT + 3 * put.n)::VARCHAR, 9, '0') || w[10:] || repeat('I', put.n)) AS w
  FROM st LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM st.conv_id JOIN put ON put.s = st.s AND put.m IN ('', 'a')
  WHERE st.i = coalesce(stats.n, 0) GROUP BY st.conv_id),
edits AS (SELECT conv_id, w[:9]::BIGINT AS cost, w[10:] AS audit, length(replace(w[10:], 'D', '')) AS size FROM best),
letters AS (SELECT *, unnest(range(1, length(audit) + 1)) AS q FROM edits),
done AS (SELECT *, audit[q:q] AS e, length(replace(audit[:q], 'I', '')) AS i, length(replace(audit[:q], 'D', '')) AS p FROM letters),
lines AS (
  SELECT d.conv_id, p, CASE WHEN e = 'K' THEN f.role WHEN (p + size) % 2 = 0 THEN 'assistant' ELSE 'user' END
         || ':' || CASE WHEN e = 'I' THEN '' ELSE f.text END AS line
  FROM done d LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i WHERE e <> 'D'),
digest AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS body FROM lines GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM edits e LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM e.conv_id
             LEFT JOIN digest ON digest.conv_id IS NOT DISTINCT FROM e.conv_id"""


TRIE = rf"""
WITH {CRC_TABLE},
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations),
ids AS (SELECT conv_id, coalesce({crc32("conv_id::VARCHAR")} % 4, 0) AS h FROM (SELECT DISTINCT conv_id FROM conversations), tab),
b0 AS (
  SELECT c.conv_id AS c, 0 AS own, p, role, text FROM ids c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND p <= h
  UNION ALL SELECT c.conv_id, 1, p, role, text FROM ids c JOIN o ON o.conv_id IS NOT DISTINCT FROM c.conv_id AND p > h),
b AS (SELECT c, row_number() OVER w AS d, {WORDS.format('text')} AS words,
        string_agg(sha256(length(role) || ':' || role || text), '') OVER (w ROWS UNBOUNDED PRECEDING) AS path
      FROM b0 WINDOW w AS (PARTITION BY c ORDER BY own, p)),
m AS (SELECT conv_id AS c, 0 AS d, 0 AS words, '' AS path FROM ids UNION ALL SELECT c, d, words, path FROM b),
size AS (SELECT c, max(d) AS n FROM m GROUP BY c),
n0 AS (SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs, min(words) AS words FROM m GROUP BY 1, 2),
kids AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n FROM n0 WHERE depth > 0 GROUP BY 1),
n1 AS (SELECT n0.*, coalesce(kids.n, 0) AS n_children FROM n0 LEFT JOIN kids USING (path)),
sums AS (SELECT m.path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n1.words)::BIGINT AS saved_tokens
         FROM n1 JOIN m ON m.c IS NOT DISTINCT FROM n1.conv_id AND m.d <= n1.depth GROUP BY 1),
ends AS (SELECT path, string_agg(m.c::VARCHAR, ',' ORDER BY m.c) AS list FROM m JOIN size ON m.c IS NOT DISTINCT FROM size.c AND d = n GROUP BY 1)
SELECT n1.conv_id, n1.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n1.n_convs, n1.n_children, n_leaves, saved_tokens,
       sha256(coalesce(list, '')) AS ends_sha256
FROM n1 JOIN sums USING (path) LEFT JOIN ends USING (path)
     LEFT JOIN n0 up ON n1.depth > 0 AND up.depth = n1.depth - 1 AND up.path = left(n1.path, 64 * (n1.depth - 1))"""
