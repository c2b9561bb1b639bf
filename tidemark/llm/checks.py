"""SQL that checks the operators on conversations and repeated passages."""

OP11 = r"""
WITH RECURSIVE k AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS cid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
f AS (
  SELECT k.*, xor(4294967295, list_reduce(flatten(list_transform(string_split(key, ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
              lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), CAST(4294967295 AS BIGINT))) % 20 AS fault
  FROM k),
g AS (
  SELECT cid, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, copy) AS place
  FROM f, unnest(range(0, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c(copy)),
o AS (
  SELECT cid, turn, role, text, place, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY place) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'fine' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY place) || left(role, 1) AS pair
  FROM g),
n AS (
  SELECT cid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM o GROUP BY cid),
ins(s, t, cost, said) AS (VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')),
edits(s, edit, initial, t, cost) AS (VALUES
  (0, 'D', NULL, 0, 2), (1, 'D', NULL, 1, 2), (2, 'D', NULL, 2, 2), (3, 'D', NULL, 3, 2), (0, 'R', NULL, 2, 1), (1, 'R', NULL, 2, 1), (2, 'R', NULL, 3, 1), (3, 'R', NULL, 2, 1),
  (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0)),
dp AS (
  SELECT DISTINCT cid, CAST(0 AS BIGINT) AS i, 0 AS s, {'cost': 0, 'said': ''} AS best FROM k
  UNION ALL
  SELECT dp.cid, dp.i + 1, edits.t, min({'cost': dp.best.cost + ins.cost + edits.cost + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 5 ELSE 0 END, 'said': dp.best.said || ins.said || edit})
  FROM dp JOIN o ON o.cid = dp.cid AND o.place = dp.i + 1 JOIN ins ON ins.s = dp.s
  JOIN edits ON edits.s = ins.t AND (edit = 'D' OR fault IN ('truncated', 'fine') AND (edit = 'R' OR edits.initial = o.initial))
  GROUP BY dp.cid, dp.i + 1, edits.t),
b AS (
  SELECT dp.cid, min({'cost': best.cost + [0, 10, 5, 0][s + 1], 'said': best.said || ['', 'II', 'I', ''][s + 1]}) AS best
  FROM dp LEFT JOIN n ON n.cid = dp.cid WHERE dp.i = coalesce(n.n, 0) GROUP BY dp.cid),
e AS (SELECT cid, unnest(string_split(best.said, '')) AS edit, generate_subscripts(string_split(best.said, ''), 1) AS p FROM b WHERE best.said <> ''),
w AS (SELECT cid, edit, p, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY cid ORDER BY p) AS i FROM e),
h AS (SELECT w.cid, w.edit, w.p, o.role, CASE WHEN w.edit = 'I' THEN '' ELSE o.text END AS text, o.initial FROM w LEFT JOIN o ON o.cid = w.cid AND o.place = w.i WHERE w.edit <> 'D'),
q AS (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY p) - CASE WHEN first_value(edit = 'K' AND initial = 's') OVER (PARTITION BY cid ORDER BY p) THEN 1 ELSE 0 END AS at
  FROM h),
z AS (SELECT cid, string_agg(CASE WHEN edit = 'K' THEN role WHEN "at" % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS whole FROM q GROUP BY cid),
c AS (SELECT DISTINCT cid, conv_id FROM k)
SELECT c.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
       CAST(best.cost AS BIGINT) AS cost, best.said AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM c JOIN b ON b.cid = c.cid LEFT JOIN n ON n.cid = c.cid LEFT JOIN z ON z.cid = c.cid
"""

OP12 = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, list_transform(range(1, len(words) - 48), lambda i: md5(array_to_string(words[i:i + 49], ' '))) AS windows FROM w),
s AS (SELECT doc_id, unnest(windows) AS win, generate_subscripts(windows, 1) AS a FROM p),
f AS (SELECT win, min(doc_id) AS low FROM s GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT s.doc_id, s.a + k AS pos FROM s JOIN f ON s.win = f.win AND f.low < s.doc_id, range(0, 50) AS r(k)),
l AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id),
e AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
j AS (SELECT e.doc_id, word, pos FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.pos = g.pos),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS stay FROM j GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, len(words) - coalesce(stay, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN t ON w.doc_id = t.doc_id
"""

OP13 = r"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
         xor(4294967295, list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
             lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), CAST(4294967295 AS BIGINT))) % 6 AS h
  FROM o),
t AS (
  SELECT c.conv_id, o.place, role, text FROM c JOIN o ON o.conv_id = c.base AND o.place <= c.h
  UNION ALL SELECT c.conv_id, c.h + o.place, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.place > c.h),
q AS (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY place) AS turns, list(length(text) ORDER BY place) AS chars FROM t GROUP BY conv_id),
a AS (SELECT c.conv_id, coalesce(turns, []) AS turns, coalesce(chars, []) AS chars FROM c LEFT JOIN q ON q.conv_id = c.conv_id),
m AS (SELECT conv_id, d, len(turns) AS n, turns[1:d] AS prefix, turns[1:d - 1] AS above, chars[d] AS chars FROM a, unnest(range(0, len(turns) + 1)) AS u(d)),
n AS (
  SELECT prefix, d, any_value(above) AS above, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM m GROUP BY prefix, d),
k AS (SELECT above, count(*) AS n_children FROM n WHERE d > 0 GROUP BY above),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.above = n.prefix),
s AS (SELECT x.prefix[1:e] AS top, sum((n_convs - 1) * coalesce(chars, 0)) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM x, unnest(range(0, x.d + 1)) AS u(e) GROUP BY 1)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN s ON s.top = x.prefix LEFT JOIN n p ON x.d > 0 AND p.prefix = x.above
"""
