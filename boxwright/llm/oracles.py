"""SQL of the operators on words and turns, and the checksum that it needs."""

from __future__ import annotations

from boxwright.llm import prefix_trie, spelling

#: One row, `tab`: the checksum's table, by its rule (reflected polynomial 0xEDB88320).
CRC_TABLE = """crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i))"""


def crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8; `tab` must be in reach."""
    pairs = f"list_transform(range(0, strlen({text})), lambda j: CAST('0x' || substr(hex({text}), 2 * j + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {pairs}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


OP11 = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= {spelling.MIN_CHARS} GROUP BY ALL),
sums AS (SELECT run, c, {crc32("concat(doc_id, ':', run)")} AS h FROM each, crc),
made AS (SELECT CASE WHEN h % {spelling.DELETE_EVERY} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM sums),
v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM made WHERE length(word) >= {spelling.MIN_CHARS} GROUP BY word HAVING sum(c) >= {spelling.MIN_COUNT}),
spots AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
cuts AS MATERIALIZED (SELECT DISTINCT word, word[:i - 1] || word[i + 1:] AS k FROM spots),
holes AS MATERIALIZED (SELECT word, i, word[:i - 1] || '*' || word[i + 1:] AS k FROM spots),
pairs AS (SELECT a.word AS a, b.word AS b FROM holes a JOIN holes b USING (k) WHERE a.word <> b.word
  UNION SELECT c.word, v.word FROM cuts c JOIN v ON c.k = v.word UNION SELECT v.word, c.word FROM cuts c JOIN v ON c.k = v.word),
best AS (SELECT p.a AS word, count(*) AS n_near, arg_min(struct_pack(b := p.b, n := v.n), struct_pack(less := -v.n, b := p.b)) AS best FROM pairs p JOIN v ON v.word = p.b GROUP BY p.a),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.best.n >= {spelling.RATIO} * v.n THEN best.best.b END AS form, CASE WHEN best.best.n >= {spelling.RATIO} * v.n THEN best.best.n END AS form_n FROM v LEFT JOIN best USING (word)),
way AS (SELECT word, form AS root, 1 AS steps FROM f WHERE form IS NOT NULL UNION ALL SELECT way.word, f.form, steps + 1 FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, steps) AS root FROM way GROUP BY word)
SELECT f.word, f.form, coalesce(ends.root, f.word) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f LEFT JOIN ends USING (word)"""


OP12 = f"""
WITH {CRC_TABLE},
o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(concat(length(role), ':', role, text))) AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, {crc32("CAST(conv_id AS VARCHAR)")} % {prefix_trie.HEAD + 1} AS h FROM (SELECT DISTINCT conv_id FROM o), crc),
b AS (SELECT c.conv_id, p, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % {prefix_trie.FAMILY} WHERE p <= h
  UNION ALL SELECT c.conv_id, p + {prefix_trie.HEAD}, role, text FROM c JOIN o ON o.conv_id = c.conv_id WHERE p > h),
s AS (SELECT c.conv_id, coalesce(list(concat(length(role), ':', role, text) ORDER BY p) FILTER (p IS NOT NULL), []) AS t,
  coalesce(list(strlen(text) ORDER BY p) FILTER (p IS NOT NULL), []) AS z FROM c LEFT JOIN b USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, t, z, unnest(range(0, len(t) + 1)) AS d FROM s),
n AS MATERIALIZED (SELECT d, t[:d] AS pre, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(min(z[d]), 0) AS size,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(t) = d), '')) AS ends FROM m GROUP BY d, t[:d]),
k AS (SELECT d - 1 AS d, pre[:d - 1] AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, pre)),
u AS (SELECT up AS d, pre[:up] AS pre, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM w) GROUP BY ALL)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(w.n_convs AS BIGINT) AS n_convs, CAST(w.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN u ON u.d = w.d AND u.pre = w.pre LEFT JOIN n p ON p.d = w.d - 1 AND p.pre = w.pre[:w.d - 1]"""
