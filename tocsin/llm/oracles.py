"""DuckDB SQL of the queries that SQL can express, written from their contracts."""

OP1 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 9) AS p FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, total * 2 AS cap FROM s),
q AS (SELECT *, ((SELECT sum(total) FROM w) * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0))
           / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS rate FROM w
      WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(rate, cap / weight) AS rate FROM q WHERE cap / weight > rate),
t AS (SELECT source, total, least(cap::DOUBLE, coalesce((SELECT rate FROM l) * weight, cap::DOUBLE)) AS target FROM q),
g AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END AS every FROM t),
n AS (SELECT *, target - every * total AS need FROM g),
h AS (SELECT source, p, sum(size) AS k, sum(sum(size)) OVER (PARTITION BY source ORDER BY p) AS upto FROM d GROUP BY source, p),
e AS (SELECT n.source, arg_min(h.p, h.p) AS below, arg_min(h.k, h.p) AS last, arg_min(h.upto - h.k, h.p) AS before, any_value(n.need) AS need
      FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source AND h.upto >= n.need GROUP BY n.source)
SELECT d.doc_id, d.size::BIGINT AS size, n.total AS source_size, n.target,
       (d.size * (n.every + CASE WHEN d.p < e.below OR (d.p = e.below AND e.need > e.before AND (e.need - e.before) * 2 >= e.last)
                                 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""

OP10 = r"""
WITH d AS (SELECT doc_id, source, lang, md5(text) AS same, coalesce(length(regexp_replace(regexp_replace(text,
           '[\x{30}-\x{39}\x{41}-\x{5A}\x{61}-\x{7A}\x{80}-\x{10FFFF}]+', 'a', 'g'), '[\x00-\x20\x7F]+', '', 'g')), 0) AS two FROM documents),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY same) AS first FROM d)
SELECT source, lang, 'words/1' AS version, 0::BIGINT AS n_docs, 0::BIGINT AS n_tokens FROM d GROUP BY source, lang
UNION ALL
SELECT source, lang, 'words/2', count(*) FILTER (WHERE same IS NULL OR doc_id IS NULL OR doc_id = first)::BIGINT,
       coalesce(sum(two) FILTER (WHERE same IS NULL OR doc_id IS NULL OR doc_id = first), 0)::BIGINT FROM f GROUP BY source, lang
"""

OP5 = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p, len(w) AS n FROM d),
g AS (SELECT doc_id, p, n, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS x FROM v
      WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT DISTINCT doc_id, x FROM g WHERE p = 1 OR p <= n - 4),
t AS MATERIALIZED (SELECT doc_id, x, count(*) OVER (PARTITION BY doc_id) AS n FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * c >= 75 * (na + nb - c)),
r AS (SELECT DISTINCT a AS node, a AS far FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.far),
m AS (SELECT node, min(far) AS low FROM r GROUP BY node),
c AS (SELECT doc_id, any_value(n) AS n FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, least(coalesce(m.low, d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.node = d.doc_id
"""

OP7 = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, least(10, len(w)) AS size, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p, w FROM i WHERE len(w) > 0),
x AS MATERIALIZED (SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS q FROM k),
v AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p, len(w) AS n FROM d),
z AS (SELECT doc_id, p, n, list(x) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM v),
e AS (SELECT doc_id, p, size, array_to_string(ten[1:size], ' ') AS q FROM z, (SELECT DISTINCT size FROM x) WHERE p + size - 1 <= n),
h AS MATERIALIZED (SELECT e.doc_id, e.p, e.size, x.item_id FROM e JOIN x ON x.size = e.size AND x.q = e.q),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(p, p + size - 1)) AS at FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(s.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""

OP9 = r"""
WITH d AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
v AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p, len(w) AS n FROM d),
g AS (SELECT doc_id, p, n, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS x FROM v
      WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
q AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x) AS k FROM g WHERE p <= n - 4),
r AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 4)) AS at FROM q WHERE k > 1) GROUP BY doc_id),
m AS MATERIALIZED (SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS bad FROM f GROUP BY source),
y AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM h),
z AS (SELECT m, least(greatest(m * (1 - m) / greatest(v, 1e-12) - 1, 1), 1e4) AS k FROM y),
b AS (SELECT source, (bad + m * k) / (n + k) AS rate FROM h, z)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed, NOT f.base_failed AND b.rate <= 0.5 AS kept
FROM f JOIN b ON f.source IS NOT DISTINCT FROM b.source
"""

#: crc32 of a list of bytes: a table of 256 sums, then one step a byte.
CRC = """
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS i)))"""


def _crc(bytes_: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295)"


OP12 = r"""
WITH""" + CRC + r""",
t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
      FROM documents),
k AS (SELECT doc_id, run, count(*) AS times FROM t GROUP BY doc_id, run),
h AS (SELECT *, """ + _crc(r"""flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))""") + r""" AS h FROM k, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h),
v AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
x AS (SELECT word, n, unnest(range(length(word)))::INT AS i FROM v),
y AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS less FROM x),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM y a JOIN y b ON a.i = b.i AND a.less = b.less AND length(a.word) = length(b.word) AND a.word <> b.word
      UNION SELECT y.word, v.word, v.n FROM y JOIN v ON y.less = v.word UNION SELECT v.word, y.word, y.n FROM y JOIN v ON y.less = v.word),
b AS (SELECT word, count(*) AS n_near, list(struct_pack(a := -near_n, b := near) ORDER BY -near_n, near)[1] AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.a >= 2 * v.n THEN best.b END AS form,
      CASE WHEN -best.a >= 2 * v.n THEN (-best.a)::BIGINT END AS form_n FROM v LEFT JOIN b USING (word))
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN (WITH RECURSIVE q AS (SELECT word, word AS root, 0 AS d FROM f
      UNION ALL SELECT q.word, f.form, d + 1 FROM q JOIN f ON q.root = f.word WHERE f.form IS NOT NULL) SELECT word, arg_max(root, d) AS root FROM q GROUP BY word) z
      USING (word)
"""

OP13 = r"""
WITH""" + CRC + r""",
a AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(role || chr(0) || text)) AS p, role, text FROM a),
g AS MATERIALIZED (SELECT c, c - c % 100 AS family, """ + _crc("list_transform(string_split(c::VARCHAR, ''), lambda x: unicode(x)::BIGINT)") + r""" % 6 AS h
      FROM (SELECT DISTINCT c FROM a), crc),
b AS (SELECT g.c, 0 AS own, o.p, role, text FROM g JOIN o ON o.c = g.family AND o.p <= h UNION ALL SELECT g.c, 1, o.p, role, text FROM g JOIN o ON o.c = g.c AND o.p > h),
t AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, md5(role) || md5(text) AS x, length(text) AS size FROM b),
q AS MATERIALIZED (SELECT c, d, size, md5(string_agg(x, ',') OVER (PARTITION BY c ORDER BY d)) AS node,
      coalesce(md5(string_agg(x, ',') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '') AS up FROM t
      UNION ALL SELECT c, 0, 0, '', NULL FROM g),
l AS (SELECT c, max(d) AS turns FROM q GROUP BY c),
n AS MATERIALIZED (SELECT node, any_value(d) AS d, any_value(up) AS up, min(q.c) AS c, count(*) AS n, any_value(size) AS size,
      coalesce(string_agg(q.c::VARCHAR, ',' ORDER BY q.c) FILTER (WHERE d = turns), '') AS ends FROM q JOIN l ON l.c = q.c GROUP BY node),
k AS MATERIALIZED (SELECT up AS node, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT q.node, count(*) FILTER (WHERE kids IS NULL) AS leaves, sum((n.n - 1) * n.size) AS saved
      FROM n LEFT JOIN k ON k.node = n.node JOIN q ON q.c = n.c AND q.d <= n.d GROUP BY q.node)
SELECT n.c::BIGINT AS conv_id, n.d::BIGINT AS depth, u.c::BIGINT AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(kids, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n LEFT JOIN n u ON u.node = n.up LEFT JOIN k ON k.node = n.node JOIN s ON s.node = n.node
"""

ORACLES = {"op1_mixing": OP1, "op5_near": OP5, "op7_leaks": OP7, "op9_rules": OP9, "op10_token_counts": OP10, "op12_variants": OP12, "op13_trie": OP13}
