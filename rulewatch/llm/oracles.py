"""DuckDB texts for the operators that SQL can express."""

# Every document counted by the filters it fails, then every order and step over those counts.
FILTER_AUDIT = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM texts),
failing AS (
  SELECT doc_id, part,
         CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
         + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
         + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS fails
  FROM words),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
counts AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, 1 << (ascii(filter_order[step]) - 65) AS own,
         list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS seen
  FROM orders, range(1, 6) r(step)),
sums AS (
  SELECT part, filter_order, step, own,
         CAST(sum(n) FILTER (WHERE fails & (own | coalesce(seen, 0)) = 0) AS BIGINT) AS kept,
         CAST(sum(n) FILTER (WHERE fails & own > 0 AND fails & coalesce(seen, 0) = 0) AS BIGINT) AS removed,
         CAST(sum(n) FILTER (WHERE fails & own > 0 AND fails & coalesce(seen, 0) > 0) AS BIGINT) AS redundant,
         CAST(sum(n) FILTER (WHERE fails = own) AS BIGINT) AS unique_fails,
         CAST(sum(g) FILTER (WHERE fails & own > 0 AND fails & coalesce(seen, 0) = 0) AS BIGINT) AS good_lost,
         CAST(sum(x) FILTER (WHERE fails & own > 0 AND fails & coalesce(seen, 0) = 0) AS BIGINT) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed,
       coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
       coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM sums"""


# Costs, audits and repaired rows are carried forward together, row by row, with the least kept for each state.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE
bits AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
                  lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
kinds AS (SELECT named.*, xor(4294967295, list_reduce(
            list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT))),
            lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM named, bits),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, range(2) again(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
faulty AS (
  SELECT *, coalesce(left(role, 1), '') AS initial,
         CASE WHEN regexp_matches(text, '^[\x20\x09-\x0D]*$') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault
  FROM placed),
rows_ AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         count(*) OVER (PARTITION BY conv_id) AS n FROM faulty),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY 1),
inserts AS (SELECT * FROM (VALUES (0, 0, '', []), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []),
  (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:']),
  (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])) x(s0, s1, put, added)),
takes AS (SELECT * FROM (VALUES ('D', 0, 0, NULL), ('D', 1, 1, NULL), ('D', 2, 2, NULL), ('D', 3, 3, NULL),
  ('K', 0, 1, 's'), ('K', 0, 2, 'u'), ('K', 1, 2, 'u'), ('K', 3, 2, 'u'), ('K', 2, 3, 'a'),
  ('R', 0, 2, NULL), ('R', 1, 2, NULL), ('R', 3, 2, NULL), ('R', 2, 3, NULL)) x(letter, s1, s2, needs)),
best AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, {'cost': 0, 'audit': '', 'text': CAST([] AS VARCHAR[])} AS b FROM rows_
  UNION ALL
  SELECT r.conv_id, r.i, t.s2, min({
           'cost': b.b.cost + 2 * length(put) + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END
                   + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END,
           'audit': b.b.audit || put || letter,
           'text': b.b.text || added || CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || r.text]
                   ELSE [CASE WHEN t.s2 = 2 THEN 'user:' ELSE 'assistant:' END || r.text] END})
  FROM best b JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1
  JOIN inserts p ON p.s0 = b.s
  JOIN takes t ON t.s1 = p.s1 AND (t.needs IS NULL OR t.needs = r.initial)
              AND (t.letter = 'D' OR r.fault IS NULL OR r.fault = 'truncated')
  GROUP BY ALL),
last AS (SELECT conv_id, max(i) AS i FROM rows_ GROUP BY 1),
done AS (
  SELECT b.conv_id, min({'cost': b.b.cost + 2 * length(put), 'audit': b.b.audit || put, 'text': b.b.text || added}) AS d
  FROM best b JOIN last l ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND l.i = b.i
  JOIN inserts p ON p.s0 = b.s AND p.s1 IN (0, 3) GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(d.cost, 0) AS BIGINT) AS cost,
       coalesce(d.audit, '') AS audit, sha256(coalesce(array_to_string(d.text, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id"""
