"""SQL beside the training-data queries that SQL can express, for DuckDB over the driver tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32 of the decimal id, bit by bit; modulo 6 the length of the head.
CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""

PREFIX_TRIE = f"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, length(text) AS chars, sha256(strlen(role)::VARCHAR || ':' || role || text) AS digest,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role)::VARCHAR || ':' || role || text)) AS j FROM given),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (SELECT c.conv_id, 0 AS part, t.j, t.digest, t.chars FROM convs c JOIN turns t ON t.conv_id = c.base AND t.j <= c.h
    UNION ALL SELECT c.conv_id, 1, t.j, t.digest, t.chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.j > c.h),
seqs AS (SELECT conv_id, list(digest ORDER BY part, j) AS digests, list(chars ORDER BY part, j) AS sizes FROM rebuilt GROUP BY conv_id
    UNION ALL SELECT conv_id, [], [] FROM convs WHERE conv_id NOT IN (SELECT conv_id FROM rebuilt)),
prefixes AS (SELECT conv_id, d AS depth, sha256(array_to_string(digests[1:d], ',')) AS key, len(digests) AS total, sizes[d] AS chars,
    CASE WHEN d > 0 THEN sha256(array_to_string(digests[1:d - 1], ',')) END AS up
    FROM (SELECT conv_id, digests, sizes, unnest(range(0, len(digests) + 1)) AS d FROM seqs)),
grouped AS (SELECT depth, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(chars), 0) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = total), '')) AS ends_sha256
    FROM prefixes GROUP BY depth, key),
children AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM grouped WHERE depth > 0 GROUP BY ALL),
nodes AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM grouped g LEFT JOIN children USING (depth, key)),
below AS (SELECT p.depth, p.key, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
    FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.key)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves::BIGINT AS n_leaves,
    saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (depth, key) LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.key = n.up
"""

COLLOCATIONS = f"""
WITH pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents)),
lines AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words)) AS n FROM lines GROUP BY lang),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(words) - m + 2), lambda s: array_to_string(words[s:s + m - 1], ' '))) AS phrase
    FROM lines, (SELECT unnest([1, 2, 3]) AS m) WHERE len(words) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE m > 1 AND f >= 10),
cuts AS (SELECT lang, m, phrase, a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (SELECT c.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head AND x.m = c.k JOIN f y ON y.lang = c.lang AND y.phrase = c.tail AND y.m = c.m - c.k),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(words[s:s + 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT *, unnest([1, 2]) AS s FROM cand WHERE m = 3) GROUP BY 1, 2),
kept AS (SELECT c.* FROM lowest c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

CONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
parted AS (SELECT row, doc_id, list_filter(regexp_split_to_array(text, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM docs),
dw AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM parted),
items AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM (SELECT DISTINCT item_id, text FROM benchmark)),
windows AS (SELECT DISTINCT item, array_to_string(words[s:s + 9], ' ') AS phrase
    FROM (SELECT item, words, unnest(range(1, len(words) - 8)) AS s FROM items WHERE len(words) >= 10)),
runs AS (SELECT row, p, string_agg(word, ' ') OVER w AS phrase, count(*) OVER w AS n FROM dw
    WINDOW w AS (PARTITION BY row ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
short AS (SELECT item, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM items WHERE len(words) BETWEEN 1 AND 9),
found AS (SELECT row, p, 10 AS n, item FROM runs JOIN windows USING (phrase) WHERE n = 10
    UNION ALL SELECT row, p - j + 1, s.n, item FROM dw JOIN short s USING (word) GROUP BY row, p - j + 1, s.n, item HAVING count(*) = s.n),
hits AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(range(p, p + n)) AS q FROM found) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM found WHERE item IS NOT NULL) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM parted LEFT JOIN hits USING (row) LEFT JOIN named USING (row)
"""
