"""SQL counterparts for DuckDB."""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP10_SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORDS}') AS ws
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORDS}') AS ws
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (
  SELECT DISTINCT k FROM item_windows
), doc_windows AS (
  SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, sizes WHERE len(ws) >= k)
), hits AS (
  SELECT doc_id, i, k, item_id FROM doc_windows JOIN item_windows USING (k, win)
), words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""

_STOPS = "', '".join(
    sorted(
        set(
            (
                "der die das und ist von zu in den mit nicht ein eine im auf für sich "
                "the of and to in is that for it as was with be by on are this "
                "de la que el en y a los se del las un por con una su para "
                "de la le et les des en un du une que est pour qui dans par sur"
            ).split()
        )
    )
)

OP4_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM t WHERE len(ws) >= 8)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(ws) AS n, length(array_to_string(ws, '')) AS chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS signs,
         len(ls) AS lines, len(ls) - len(list_distinct(ls)) AS dup, coalesce(repeated.n, 0) AS rep,
         len(list_filter(ws, lambda w: regexp_matches(w, '\p{{L}}'))) AS alpha,
         len(list_filter(ws, lambda w: length(w) > 2 AND w = upper(w) AND w <> lower(w))) AS loud,
         len(list_filter(ws, lambda w: length(w) <= 6 AND lower(regexp_replace(w, '[.,;:!?]', '', 'g')) IN ('{_STOPS}'))) AS stops,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS dots,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣]'))) AS bullets
  FROM t LEFT JOIN repeated USING (doc_id)
), judged AS (
  SELECT *, n < 20 OR 100 * rep > 30 * n AS base_failed FROM counts
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(signs AS BIGINT) AS n_symbols,
       CAST(dup AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND n BETWEEN 20 AND 1000000 AND chars / n BETWEEN 1.5 AND 20 AND signs / n <= 0.2
         AND loud / n <= 0.4 AND alpha / n >= 0.6 AND stops / n >= 0.03 AND dup / lines <= 0.5
         AND dots / lines <= 0.5 AND bullets / lines <= 0.9 AS kept
FROM judged
"""

OP12_SQL = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM t WINDOW same AS (PARTITION BY norm)
"""

# CRC-32 bit by bit; the keys are ASCII. The programme keeps, per place in the pattern, the
# least (cost, edits) as text, so that its order needs no ranks.
OP11_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])),
      lambda c, i: xor(c // 2, CASE WHEN c % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END))),
    CAST(4294967295 AS BIGINT)) % 20 AS which
  FROM keyed
), harmed AS (
  SELECT conv_id, turn, CASE WHEN which = 4 THEN 'user' ELSE role END AS role,
         CASE which WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, (SELECT unnest([0, 1]) AS copy) WHERE which <> 0 AND (copy = 0 OR which = 3)
), faults AS (
  SELECT *, left(role, 1) AS initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn
  FROM harmed
), numbered AS (
  SELECT *, CASE WHEN final = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 2 WHEN final NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) || initial AS pair
  FROM faults
), put_in AS (
  SELECT * FROM (VALUES
    (0, '', 0, ''), (0, 'I', 2, 'user:|'), (0, 'II', 3, 'user:|assistant:|'),
    (1, '', 1, ''), (1, 'I', 2, 'user:|'), (1, 'II', 3, 'user:|assistant:|'),
    (2, '', 2, ''), (2, 'I', 3, 'assistant:|'), (2, 'II', 2, 'assistant:|user:|'),
    (3, '', 3, ''), (3, 'I', 2, 'user:|'), (3, 'II', 3, 'user:|assistant:|')) AS v(src, ins, mid, added)
), edits AS (
  SELECT * FROM (VALUES
    (0, 'D', 0, '', 2, ''), (1, 'D', 1, '', 2, ''), (2, 'D', 2, '', 2, ''), (3, 'D', 3, '', 2, ''),
    (0, 'K', 1, 's', 0, ''), (0, 'K', 2, 'u', 0, ''), (1, 'K', 2, 'u', 0, ''), (2, 'K', 3, 'a', 0, ''), (3, 'K', 2, 'u', 0, ''),
    (0, 'R', 2, '', 1, 'user'), (1, 'R', 2, '', 1, 'user'), (2, 'R', 3, '', 1, 'assistant'), (3, 'R', 2, '', 1, 'user')
    ) AS v(mid, edit, dst, initial, price, named)
), moves AS (
  SELECT src, dst, ins || edit AS added_edits, added, edit, e.initial, 5 * length(ins) + price AS price, named
  FROM put_in p JOIN edits e ON e.mid = p.mid
), programme AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS rn, 0 AS place,
         {'cost': CAST(0 AS BIGINT), 'audit': '', 'body': CAST([] AS VARCHAR[])} AS best
  FROM conversations
  UNION ALL
  SELECT p.conv_id, r.rn, m.dst,
         min({'cost': p.best.cost + m.price + CASE WHEN m.edit <> 'D' AND r.fault = 3 THEN 5 ELSE 0 END,
              'audit': p.best.audit || m.added_edits,
              'body': list_concat(p.best.body, list_concat(
                CAST(CASE m.added WHEN '' THEN [] ELSE string_split(rtrim(m.added, '|'), '|') END AS VARCHAR[]),
                CAST(CASE m.edit WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [m.named || ':' || r.text] END AS VARCHAR[])))})
  FROM programme p JOIN numbered r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.rn = p.rn + 1
    JOIN moves m ON m.src = p.place AND (m.edit = 'D' OR (r.fault NOT IN (1, 2) AND (m.edit = 'R' OR m.initial = r.initial)))
  GROUP BY p.conv_id, r.rn, m.dst
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM numbered GROUP BY conv_id
), ended AS (
  SELECT p.conv_id, min({'cost': p.best.cost + 5 * length(i.ins), 'audit': p.best.audit || i.ins,
              'body': list_concat(p.best.body, CAST(CASE i.added WHEN '' THEN [] ELSE string_split(rtrim(i.added, '|'), '|') END AS VARCHAR[]))}) AS best
  FROM programme p JOIN put_in i ON i.src = p.place AND i.mid IN (0, 3)
    LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id
  WHERE p.rn = coalesce(c.n, 0) GROUP BY p.conv_id
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(e.best.cost AS BIGINT) AS cost, e.best.audit AS audit,
       sha256(array_to_string(e.best.body, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
