"""SQL of the queries that SQL can express, over the same tables."""

QUALITY_RULES = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), listed AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM d
), w AS (
    SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM listed
), windows AS (
    SELECT rid, pos, lead(w, 4) OVER o AS last, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS g
    FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)
), repeated AS (
    SELECT rid, pos FROM (
        SELECT rid, pos, count(*) OVER (PARTITION BY rid, g) AS c FROM windows WHERE last IS NOT NULL) WHERE c > 1
), covered AS (
    SELECT rid, count(DISTINCT pos + k) AS n FROM repeated, range(5) AS r(k) GROUP BY rid
), s AS (
    SELECT l.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
           CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
    FROM listed l LEFT JOIN covered c ON l.rid = c.rid
), b AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s
), steps AS (
    SELECT rid, lang, source, 'symbols' AS rate, 1000 * n_symbols // word_chars AS step FROM b WHERE n_words > 0
    UNION ALL SELECT rid, lang, source, 'lines', 1000 * n_dup_lines // n_lines FROM b WHERE n_words > 0
    UNION ALL SELECT rid, lang, source, 'length', 10 * word_chars // n_words FROM b WHERE n_words > 0
), coarse AS (
    SELECT *, greatest(length(bin(step)) - 11, 0) AS more FROM steps
), sketch AS (
    SELECT lang, source, rate, (step >> more) << more AS step, any_value(more) AS more, count(*) AS docs FROM coarse GROUP BY ALL
), levels AS (
    SELECT 1 AS level, lang, source, rate, step, docs, more FROM sketch
    UNION ALL SELECT 2, lang, NULL, rate, step, sum(docs), any_value(more) FROM sketch GROUP BY lang, rate, step
    UNION ALL SELECT 3, NULL, NULL, rate, step, sum(docs), any_value(more) FROM sketch GROUP BY rate, step
), ranked AS (
    SELECT *, sum(docs) OVER (PARTITION BY level, lang, source, rate ORDER BY step) AS upto,
           sum(docs) OVER (PARTITION BY level, lang, source, rate) AS n FROM levels
), middle AS (
    SELECT level, lang, source, rate, CAST(max(n) AS BIGINT) AS n, min(step) FILTER (4 * upto >= n) AS q1,
           min(step + (CAST(1 AS BIGINT) << more) - 1) FILTER (4 * upto >= 3 * n) AS q3
    FROM ranked GROUP BY level, lang, source, rate
), langs AS (
    SELECT l.lang, l.rate, (l.n * l.q1 + 50 * a.q1) // (l.n + 50) AS q1, (l.n * l.q3 + 50 * a.q3) // (l.n + 50) AS q3
    FROM middle l JOIN middle a ON l.rate = a.rate AND l.level = 2 AND a.level = 3
), drawn AS (
    SELECT s.lang, s.source, s.rate, (s.n * s.q1 + 50 * d.q1) // (s.n + 50) AS q1, (s.n * s.q3 + 50 * d.q3) // (s.n + 50) AS q3
    FROM middle s JOIN langs d ON s.level = 1 AND s.lang IS NOT DISTINCT FROM d.lang AND s.rate = d.rate
), fence AS (
    SELECT lang, source, max(q3 + 3 * greatest(q3 - q1, 10)) FILTER (rate = 'symbols') AS symbols_hi,
           max(q3 + 3 * greatest(q3 - q1, 150)) FILTER (rate = 'lines') AS lines_hi,
           max(q1 - 12 * greatest(q3 - q1, 5)) FILTER (rate = 'length') AS length_lo,
           max(q3 + 12 * greatest(q3 - q1, 5)) FILTER (rate = 'length') AS length_hi
    FROM drawn GROUP BY lang, source
), picked AS (
    SELECT b.*, f FROM b LEFT JOIN fence f ON f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(1000 * n_symbols // word_chars <= f.symbols_hi
           AND 1000 * n_dup_lines // n_lines <= f.lines_hi
           AND 10 * word_chars // n_words BETWEEN f.length_lo AND f.length_hi, false) AS kept
FROM picked
"""

CHAT = """
WITH t AS (
    SELECT conv_id, role, text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), p AS (
    SELECT *, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY place) AS turns,
           count(*) OVER (PARTITION BY conv_id) AS n
    FROM t
), heads AS (
    SELECT turns, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE place = n GROUP BY turns, n
), kept AS (
    SELECT h.conv_id, h.n, h.n_copies FROM heads h
    WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n AND p.place = h.n AND p.turns = h.turns)
)
SELECT t.conv_id, CAST(t.place AS BIGINT) AS place, CAST(k.n AS BIGINT) AS n_turns, CAST(k.n_copies AS BIGINT) AS n_copies,
       '<|im_start|>' || coalesce(t.role, 'unknown') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10) AS rendered
FROM t JOIN kept k ON t.conv_id = k.conv_id
"""

FILL_MIDDLE = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
    FROM documents
), drawn AS (
    SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
           CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM d
), cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
           coalesce(array_to_string(u[b + 1:n], ''), '') AS s
    FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
                        ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

URL_FILTER = r"""
WITH rules (host, path, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), rests AS (
    SELECT row_number() OVER () AS rid, page_id,
           CASE WHEN contains(url, '://') THEN regexp_extract(url[strpos(url, '://') + 3:], '^[^?#]*') ELSE '' END AS rest
    FROM pages
), urls AS (
    SELECT rid, page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                   'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '/(.|\n)*') AS path
    FROM rests
), fits AS (
    SELECT u.rid, r.host || r.path AS rule, r.verdict
    FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
    QUALIFY row_number() OVER (PARTITION BY u.rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) = 1
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON u.rid = f.rid
"""

#: The repair as dynamic programming over four states of the role pattern: 0 empty, 1 after system, 2 a user turn is open,
#: 3 after a pair. A way is a move from state to state by up to two inserted turns, then by a turn of role initial ``i``.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE bits AS (
    SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                ORDER BY k) AS crcs
    FROM range(256) r(k)
), drawn AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ord(x)::BIGINT)),
               lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS d
    FROM conversations, bits
), hurt AS (
    SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy,
           CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM drawn WHERE d <> 0
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k FROM hurt
), judged AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                   WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') THEN 'truncated'
                   ELSE 'fine' END AS fault,
           left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before
    FROM ordered
), ends AS (
    SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
), inserts (q, p, audit, cost) AS (
    VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 5), (1, 2, 'I', 5), (2, 3, 'I', 5), (3, 2, 'I', 5),
           (0, 3, 'II', 10), (1, 3, 'II', 10)
), moves (q, i, p) AS (
    VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), ways AS (
    SELECT n.q, m.p, n.audit || 'K' AS audit, n.cost, m.i, true AS spoken FROM inserts n JOIN moves m ON n.p = m.q
    UNION ALL SELECT n.q, m.p, n.audit || 'R', n.cost + 1, NULL, true FROM inserts n JOIN moves m ON n.p = m.q WHERE m.i <> 's'
    UNION ALL SELECT q, p, audit || 'D', cost + 2, NULL, false FROM inserts
), steps AS (
    SELECT conv_id, 0::BIGINT AS k, 0 AS q, 0 AS cost, '' AS audit FROM ends
    UNION ALL
    SELECT s.conv_id, j.k, w.p, s.cost + w.cost + CASE WHEN w.spoken AND j.fault = 'truncated' THEN 5 ELSE 0 END AS cost, s.audit || w.audit
    FROM steps s JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND j.k = s.k + 1
    JOIN ways w ON w.q = s.q AND (w.i IS NULL OR w.i = j.i) AND NOT (w.spoken AND j.fault IN ('blank', 'duplicate'))
    QUALIFY row_number() OVER (PARTITION BY s.conv_id, w.p
        ORDER BY s.cost + w.cost + CASE WHEN w.spoken AND j.fault = 'truncated' THEN 5 ELSE 0 END, s.audit || w.audit) = 1
), best AS (
    SELECT s.conv_id, s.cost + n.cost AS cost, s.audit || n.audit AS audit
    FROM steps s JOIN ends e ON s.conv_id IS NOT DISTINCT FROM e.conv_id AND s.k = e.n JOIN inserts n ON n.q = s.q AND n.p IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + n.cost, s.audit || n.audit) = 1
), edits AS (
    SELECT conv_id, spot, audit[spot] AS edit, len(regexp_replace(audit[1:spot], 'I', '', 'g')) AS k
    FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS spot FROM best)
), spoken AS (
    SELECT e.conv_id, e.spot, e.edit, j.role, CASE WHEN e.edit = 'I' THEN '' ELSE j.text END AS text,
           sum(CASE WHEN e.edit = 'K' AND j.i = 's' THEN 0 ELSE 1 END) OVER (PARTITION BY e.conv_id ORDER BY e.spot) AS place
    FROM edits e LEFT JOIN judged j ON e.conv_id IS NOT DISTINCT FROM j.conv_id AND e.k = j.k WHERE e.edit <> 'D'
), texts AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
                               chr(10) ORDER BY spot) AS whole
    FROM spoken GROUP BY conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN texts t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
"""
