"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

WARC = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS h FROM p
)
SELECT page_id, payload_bytes,
  array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(h, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INT, 1)
    FOR k IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = min(page_id) OVER (PARTITION BY h) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> min(page_id) OVER (PARTITION BY h) THEN min(page_id) OVER (PARTITION BY h) END AS refers_to
FROM d
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *,
    regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|TEXT\]|TURN\])', '\1\\\2\3', 'g') AS erole,
    regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|TEXT\]|TURN\])', '\1\\\2\3', 'g') AS etext,
    CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) THEN 1 ELSE 0 END AS head
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (7 + sum(length(etext) + CASE WHEN head = 1 THEN 19 + length(erole) ELSE 6 END))::BIGINT AS formatted_chars,
  sum(head)::INT AS n_blocks
FROM s GROUP BY conv_id
"""

EMBEDDINGS = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0 AS ok
  FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS n, vec_id AS c FROM v
  UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.n
), comp AS (SELECT n, min(c) AS c FROM reach GROUP BY n)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept
FROM v JOIN comp ON comp.n = v.vec_id
"""

QUALITY = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT *, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d
), wins AS (
  SELECT doc_id, i, list_aggregate(ws[i:i + 7], 'string_agg', chr(31)) AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
), again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS w FROM again) GROUP BY doc_id
), c AS (
  SELECT l.doc_id, t, ws, len(lines)::BIGINT AS n_lines, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN covered ON covered.doc_id = l.doc_id
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 100 * n_symbols > 30 * n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines)
    OR 100 * len([i FOR i IN range(2, len(ws) + 1) IF ws[i] = ws[i - 1]]) > 30 * n_words
    OR 100 * length(regexp_replace(t, '[^!?]', '', 'g')) > 50 * n_words
    OR 100 * length(regexp_replace(t, '[^0-9]', '', 'g')) > 30 * word_chars
    OR 100 * length(regexp_replace(t, '\PL', '', 'g')) < 50 * word_chars) AS kept
FROM f
"""

MIXING = r"""
WITH u AS (
  SELECT doc_id, source, size, count(*) AS n, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents)
  GROUP BY doc_id, source, size
), s AS (
  SELECT source, sum(size * n)::BIGINT AS source_size FROM u GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM s
), w AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM r
), l AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, k) AS place,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size,
    least(cap, coalesce((SELECT min_by(level, place) FROM l WHERE level <= cap / weight), 0) * weight) AS target
  FROM w
), o AS (
  SELECT u.*, t.source_size, t.target,
    sum(size * n) OVER (PARTITION BY u.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS e,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS passes
  FROM u JOIN t ON t.source IS NOT DISTINCT FROM u.source
), i AS (
  SELECT *, size * n AS w, target - passes * source_size AS rest FROM o
), b AS (
  -- of each source, size and share of the open rest that may be a plain stretch: documents after it, words inside it
  SELECT source, w, share, any_value(rest) AS rest, any_value(target) AS target,
    count(*) FILTER (e > rest * share) AS n, coalesce(sum(w) FILTER (e <= rest * share), 0) AS inside
  FROM i, (VALUES (1.0::DOUBLE), (0.5::DOUBLE), (0.25::DOUBLE), (0.0::DOUBLE)) AS shares(share) WHERE w > 0 GROUP BY source, w, share
), c AS (
  SELECT source, share, any_value(rest) AS rest, any_value(target) AS target, sum(inside) AS inside,
    coalesce(list({'w': w::BIGINT, 'n': n::BIGINT, 'room': 0::DOUBLE, 'picks': []::STRUCT(w BIGINT, k BIGINT)[]} ORDER BY w DESC) FILTER (w <= 2 * rest), []) AS sizes
  FROM b GROUP BY source, share
), f AS (
  -- the longest documents first, as many of each size as fit
  SELECT *, list_reduce([{'w': 0::BIGINT, 'n': 0::BIGINT, 'room': (rest - inside)::DOUBLE, 'picks': []::STRUCT(w BIGINT, k BIGINT)[]}] || sizes,
    lambda a, x: CASE WHEN least(x.n, floor(a.room / x.w)::BIGINT) > 0
      THEN {'w': 0::BIGINT, 'n': 0::BIGINT, 'room': a.room - least(x.n, floor(a.room / x.w)::BIGINT) * x.w,
            'picks': a.picks || [{'w': x.w, 'k': least(x.n, floor(a.room / x.w)::BIGINT)}]}
      ELSE a END) AS got
  FROM c
), g AS (
  -- one more document may close the gap from above
  SELECT *, list_min([x.w FOR x IN sizes IF x.w > got.room AND x.w < 2 * got.room AND x.n > 0
    AND len([p FOR p IN got.picks IF p.w = x.w AND p.k >= x.n]) = 0]) AS closing FROM f
), h AS (
  SELECT source, rest * share AS cut, got.picks || CASE WHEN closing IS NULL THEN [] ELSE [{'w': closing, 'k': 1::BIGINT}] END AS picks,
    row_number() OVER (PARTITION BY source ORDER BY
      CASE WHEN coalesce(closing - got.room, got.room) <= target * 0.01 THEN 0 ELSE coalesce(closing - got.room, got.room) END, share DESC) AS place
  FROM g
), p AS (
  SELECT source, x.w AS w, sum(x.k) AS k FROM (SELECT source, unnest(picks) AS x FROM h WHERE place = 1) GROUP BY source, x.w
), z AS (
  SELECT i.*, coalesce(h.cut, i.rest) AS cut, coalesce(p.k, 0) AS k,
    row_number() OVER (PARTITION BY i.source, i.w, i.e <= coalesce(h.cut, i.rest) ORDER BY i.e) AS nth
  FROM i LEFT JOIN h ON h.source IS NOT DISTINCT FROM i.source AND h.place = 1
    LEFT JOIN p ON p.source IS NOT DISTINCT FROM i.source AND p.w = i.w
)
SELECT doc_id, size, source_size, target, (size * (passes + CASE WHEN e <= cut OR nth <= k THEN 1 ELSE 0 END))::BIGINT AS taken
FROM (SELECT *, unnest(range(0, n)) FROM z)
"""

VARIANTS = r"""
WITH RECURSIVE poly AS (
  -- the table of the reflected polynomial 0xEDB88320, one entry for each byte
  SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
), d AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+') AS ws
  FROM documents
), r AS (
  SELECT head, w, count(*) AS n FROM (SELECT head, unnest(ws) AS w FROM d) WHERE length(w) >= 5 GROUP BY head, w
), h AS (
  SELECT w, n, xor(4294967295, list_reduce([4294967295] || [('0x' || hex(encode(head || w))[2 * i + 1 : 2 * i + 2])::BIGINT FOR i IN range(octet_length(encode(head || w)))],
    lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]))) AS crc
  FROM r, poly
), k AS (
  SELECT CASE WHEN crc % 97 = 0 THEN left(w, (crc % length(w))::INT) || substr(w, (crc % length(w))::INT + 2) ELSE w END AS word, n FROM h
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM k WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cut c JOIN v ON v.word = c.rest
  UNION SELECT v.word, c.word, c.n FROM cut c JOIN v ON v.word = c.rest
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word
), walk AS (
  SELECT word, word AS at FROM f
  UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN walk ON walk.word = f.word JOIN f AS z ON z.word = walk.at AND z.form IS NULL
"""

SHARD = r"""
WITH poly AS (
  SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
), s AS (
  SELECT doc_id, coalesce(md5(text), '') AS h, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size,
    xor(4294967295, list_reduce([4294967295] || [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')],
      lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]))) AS text_crc32
  FROM documents, poly
), o AS (
  -- the order by digest and id, with running bytes
  SELECT *, sum(size) OVER w AS e, row_number() OVER w - 1 AS r, sum(size) OVER () AS total
  FROM s WINDOW w AS (ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)
), c AS (
  SELECT *, least(floor(((2 * e - size) * 24)::DOUBLE / (2 * total)::DOUBLE), 23)::INT AS cut FROM o
), ends AS (
  SELECT cut, unnest(list_distinct([min(h), max(h)])) AS h FROM c GROUP BY cut
), moved AS (
  -- groups of equal texts across a cut move whole unless they are large
  SELECT h, least(floor(((min(e - size) + max(e)) * 24)::DOUBLE / (2 * any_value(total))::DOUBLE), 23)::INT AS whole
  FROM c WHERE h IN (SELECT h FROM ends GROUP BY h HAVING count(*) > 1)
  GROUP BY h HAVING (max(e) - min(e - size)) * 24 <= any_value(total) * 0.02::DOUBLE
), p AS (
  SELECT c.*, coalesce(whole, cut)::INT AS shard FROM c LEFT JOIN moved ON moved.h = c.h
)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, (r - min(r) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM p
"""

SQL = {
    "op1_warc": WARC,
    "op2_chat": CHAT,
    "op4_embeddings": EMBEDDINGS,
    "op6_quality": QUALITY,
    "op9_mixing": MIXING,
    "op10_shard": SHARD,
    "op12_variants": VARIANTS,
}
