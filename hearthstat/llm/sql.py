"""SQL for DuckDB that gives the rows of two of the queries, by plainer ways than the operators'.

CRC-32 is spelled out over the bytes' hexadecimal digits, one byte after the other.
"""

from __future__ import annotations

# The table of CRC-32 (its reversed polynomial is the fixed value) and a text's checksum.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS entries FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM range(256) t(i)))"""


def _crc32(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen({text}) + 1),
      lambda i: CAST('0x' || substr(hex({text}), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT))),
      lambda c, b: xor(c // 256, crc.entries[CAST(xor(c, b) % 256 + 1 AS BIGINT)])), 4294967295)"""


def resampling_sql(buckets: int = 10_000, seed: int = 2024, percent: int = 10, min_words: int = 20) -> str:
    """Importance resampling by single words."""
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"unnest(regexp_extract_all({fold}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"
    return f"""WITH {_CRC_TABLE},
doc_words AS (SELECT k, {words} AS w FROM (SELECT row_number() OVER () AS k, text FROM documents)),
own AS (SELECT k, w, count(*) AS n FROM doc_words GROUP BY 1, 2),
aim AS (SELECT w, count(*) AS n FROM (SELECT {words} AS w FROM benchmark) GROUP BY 1),
hashed AS MATERIALIZED (SELECT w, {_crc32('w')} % {buckets} AS b FROM (SELECT w FROM own UNION SELECT w FROM aim), crc),
s AS (SELECT b, CAST(sum(n) AS DOUBLE) AS n FROM own JOIN hashed USING (w) GROUP BY 1),
t AS (SELECT b, CAST(sum(n) AS DOUBLE) AS n FROM aim JOIN hashed USING (w) GROUP BY 1),
gains AS (SELECT b, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + {buckets}))
    / ((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + {buckets})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b)),
weighed AS (SELECT k, CAST(sum(n) AS BIGINT) AS n, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight
  FROM own JOIN hashed USING (w) JOIN gains USING (b) GROUP BY 1),
scored AS (SELECT d.k, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM (SELECT row_number() OVER () AS k, doc_id FROM documents) d LEFT JOIN weighed USING (k)),
placed AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS all_n FROM scored WHERE n_features >= {min_words})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * all_n // 100 THEN place END AS rank, n_features AS n_words
FROM scored LEFT JOIN placed USING (k)"""


def repair_sql() -> str:
    """Conversation repair, by growing the least edit string of every state row by row."""
    space = r"\x20\x09-\x0D"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return rf"""WITH RECURSIVE {_CRC_TABLE},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {key} AS key FROM conversations),
dealt AS (SELECT *, {_crc32('key')} % 20 AS kind FROM keyed, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM dealt),
rows AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    regexp_extract(text, '([^{space}])[{space}]*$', 1) AS final, left(role, 1) AS i FROM hurt),
faults AS (SELECT *, CASE WHEN final = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i NOT IN ('su', 'ua', 'au') AS bad FROM rows),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (bad) AS illegal, max(pos) AS n
  FROM faults GROUP BY 1),
inserts AS (SELECT * FROM (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''),
    (0, 2, 'I', 'user:' || chr(10)), (1, 2, 'I', 'user:' || chr(10)), (3, 2, 'I', 'user:' || chr(10)), (2, 3, 'I', 'assistant:' || chr(10)),
    (0, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))) v(before, state, added, said)),
moves AS (SELECT * FROM (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')) v(state, after, i)),
steps AS (
  SELECT conv_id, pos, state, state AS after, 'D' AS edit, 2 AS price, '' AS line FROM faults, (SELECT DISTINCT state FROM inserts)
  UNION ALL SELECT conv_id, pos, state, after, 'K', CASE fault WHEN 't' THEN 5 ELSE 0 END, role || ':' || text || chr(10)
    FROM faults JOIN moves USING (i) WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT conv_id, pos, state, after, 'R', CASE fault WHEN 't' THEN 6 ELSE 1 END, CASE m.i WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text || chr(10)
    FROM faults, moves m WHERE fault NOT IN ('b', 'd') AND m.i <> 's'),
ways AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, struct_pack(cost := CAST(0 AS BIGINT), audit := '', said := '') AS best FROM sums
  UNION ALL
  SELECT w.conv_id, w.pos + 1, s.after, min(struct_pack(cost := w.best.cost + 5 * length(i.added) + s.price,
      audit := w.best.audit || i.added || s.edit, said := w.best.said || i.said || s.line))
  FROM ways w JOIN inserts i ON w.state = i.before JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.pos = w.pos + 1 AND s.state = i.state
  GROUP BY 1, 2, 3),
ends AS (SELECT ways.conv_id, min(struct_pack(cost := best.cost + 5 * length(added), audit := best.audit || added, said := best.said || inserts.said)) AS best
  FROM ways JOIN sums s ON s.conv_id IS NOT DISTINCT FROM ways.conv_id JOIN inserts ON ways.state = inserts.before
  WHERE pos = n AND (inserts.state = 3 OR inserts.state = 0 AND inserts.before = 0) GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(left(best.said, CAST(greatest(length(best.said) - 1, 0) AS BIGINT)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums ON c.conv_id IS NOT DISTINCT FROM sums.conv_id
LEFT JOIN ends ON c.conv_id IS NOT DISTINCT FROM ends.conv_id"""
