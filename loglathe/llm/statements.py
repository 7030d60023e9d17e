"""DuckDB statements of the operators that SQL can express."""

from __future__ import annotations

from loglathe.llm.quality import BUCKETS, DEVIATIONS, MIDDLE, PER_UNIT

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
  ) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = d.doc_id
"""

TOP_K = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scores
)
SELECT * FROM ranked WHERE rank <= 5
"""

# CRC-32 by its definition: bits of each of the 256 remainders, then byte by byte over each distinct word
_CRC = """crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, list_transform(range(8), lambda i: 0::BIGINT)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), coded AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(strlen(word)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS u
  FROM (SELECT DISTINCT unnest(w) AS word FROM words), crc
)"""

QUALITY = rf"""
WITH words AS (SELECT doc_id, text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
{_CRC}, spread AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
), ordered AS (
  SELECT doc_id, i, word, u, lead(u) OVER (PARTITION BY doc_id ORDER BY i) AS next,
    word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY i) || ' ' || lead(word, 2) OVER (PARTITION BY doc_id ORDER BY i) AS tri
  FROM spread JOIN coded USING (word)
), twice AS (
  SELECT doc_id, tri FROM ordered WHERE tri IS NOT NULL GROUP BY ALL HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM ordered JOIN twice USING (doc_id, tri), range(3) r(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), terms AS (
  SELECT doc_id, u % {BUCKETS} AS t FROM ordered
  UNION ALL SELECT doc_id, (u * 31 + next) % {BUCKETS} + {BUCKETS} FROM ordered WHERE next IS NOT NULL
), trusted AS (
  SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
), raw AS (SELECT t, count(*) AS n FROM terms GROUP BY t),
target AS (SELECT t, count(*) AS n FROM terms WHERE doc_id IN (FROM trusted) GROUP BY t),
sums AS (
  SELECT t >= {BUCKETS} AS two, sum(raw.n) + {BUCKETS} AS r, sum(coalesce(target.n, 0)) + {BUCKETS} AS g
  FROM raw LEFT JOIN target USING (t) GROUP BY ALL
), weights AS (
  SELECT t, least(greatest(floor((ln((coalesce(target.n, 0) + 1) / g) - ln((raw.n + 1) / r)) * {PER_UNIT} + 0.5), -{MIDDLE}), {MIDDLE} - 1) / {PER_UNIT} AS x
  FROM raw LEFT JOIN target USING (t) JOIN sums ON two = (t >= {BUCKETS})
), ratios AS (
  SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(x, 0) AS ratio
  FROM base LEFT JOIN (SELECT doc_id, avg(x) AS x FROM terms JOIN weights USING (t) GROUP BY doc_id) USING (doc_id)
), lowest AS (
  SELECT avg(ratio) - {DEVIATIONS} * stddev_pop(ratio) AS z FROM ratios WHERE NOT base_failed AND doc_id IN (FROM trusted)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(ratio >= z, true) AS kept
FROM ratios, lowest
"""

#: 3988292384 is the reversed polynomial of CRC-32.
PREFIX_TRIE = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i:
    list_reduce(list_concat([i], range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
  ) AS t
), whole AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (
  SELECT conv_id, turns, conv_id - conv_id % 5 AS base, xor(list_reduce(
    list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 9 AS h
  FROM whole, crc_table
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS p
  FROM hashed c LEFT JOIN whole b ON b.conv_id = c.base
), nodes AS (
  SELECT p[1:d] AS node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CASE WHEN len(p) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
  FROM (SELECT conv_id, p, unnest(range(len(p) + 1)) AS d FROM rebuilt) GROUP BY ALL
), known AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]
), childless AS (
  SELECT k.*, coalesce(c.n, 0) AS n_children FROM known k LEFT JOIN (
    SELECT node[1:depth - 1] AS up, depth - 1 AS d, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
  ) c ON c.d = k.depth AND c.up = k.node
), above AS (
  SELECT node[1:d] AS top, d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
    sum(CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(node[depth].t) ELSE 0 END) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM childless) GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM childless JOIN above ON d = depth AND top = node
"""

SQL = {
    "op1_near_dedup": NEAR_DUPLICATES,
    "op8_quality": QUALITY,
    "op9_top_k": TOP_K,
    "op12_prefix_trie": PREFIX_TRIE,
}
