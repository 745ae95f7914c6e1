"""DuckDB SQL for the queries of this package that SQL can express."""

#: Words of a text, null and empty texts included.
_WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a WHERE r.c < l.b),
c AS (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
"""

OP4 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM w, unnest(range(1, len(w) - 11)) AS t(i)),
r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS m FROM x) WHERE m < doc_id),
c AS (SELECT DISTINCT doc_id, i + k AS j FROM r, unnest(range(13)) AS t(k)),
l AS (SELECT doc_id, list(j) AS l FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w) AS n_words, coalesce(len(l), 0) AS n_removed,
        CASE WHEN l IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(l, i)) END AS kept FROM w LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""

OP3 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
c AS (SELECT *, 2 * source_size AS stop,
        coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
        sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
      FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST)),
x AS (SELECT *, (1.5 * (SELECT sum(size) FROM d) - below) / free AS level FROM c),
v AS (SELECT arg_min(level, 1.0 * stop / w) FILTER (1.0 * stop / w >= level) AS level FROM x),
t AS (SELECT source, source_size, stop, least(stop::DOUBLE, level * w) AS target FROM c, v),
q AS (SELECT *, least(round(target), stop)::BIGINT AS quota FROM t),
a AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM d)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
  (greatest(0, least(a + size, quota) - a) + greatest(0, least(a + size, quota - source_size) - a))::BIGINT AS taken
FROM a JOIN q ON a.source IS NOT DISTINCT FROM q.source
"""

OP6 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w, coalesce(text, '') AS t,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM x) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, unnest(range(3)) AS u(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_capitals, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_dup_lines > 40 * n_lines OR 100 * n_symbols > 20 * n_words
    OR 100 * n_capitals > 40 * word_chars OR 10 * word_chars < 20 * n_words OR 10 * word_chars > 150 * n_words
    OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) < 60 * n_words OR 100 * len(list_distinct(w)) < 5 * n_words) AS kept
FROM b
"""

OP12 = """
WITH t AS (SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(x ORDER BY k) AS l FROM t GROUP BY conv_id),
h AS (SELECT conv_id, l, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
        lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda x: x::UBIGINT)),
          lambda c, d: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)), 4294967295::UBIGINT)::BIGINT % 6 AS h FROM l),
s AS (SELECT h.conv_id, list_concat(CASE WHEN h.h > 0 THEN coalesce(b.l[1:h.h], []) ELSE [] END, h.l[h.h + 1:]) AS s
      FROM h LEFT JOIN l AS b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, d, CASE WHEN d = 0 THEN [] ELSE s[1:d] END AS p, len(s) = d AS e FROM s, unnest(range(len(s) + 1)) AS u(d)),
n AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (e) AS ends FROM m GROUP BY d, p),
k AS (SELECT n.*, q.conv_id AS parent FROM n LEFT JOIN n AS q ON q.d = n.d - 1 AND q.p = CASE WHEN n.d < 2 THEN [] ELSE n.p[1:n.d - 1] END),
c AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM k WHERE d > 0 GROUP BY ALL),
o AS (SELECT k.*, coalesce(n_children, 0) AS n_children, CASE WHEN k.d = 0 THEN 0 ELSE (n_convs - 1) * length(p[k.d].t) END AS own
      FROM k LEFT JOIN c ON c.parent = k.conv_id AND c.d = k.d),
f AS (SELECT CASE WHEN j = 0 THEN [] ELSE p[1:j] END AS p, j AS d, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves
      FROM o, unnest(range(d + 1)) AS u(j) GROUP BY ALL)
SELECT o.conv_id, o.d AS depth, o.parent AS parent_conv_id, n_convs, n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens,
  sha256(coalesce(ends, '')) AS ends_sha256
FROM o JOIN f ON o.d = f.d AND o.p = f.p
"""

OP13 = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS s FROM r AS a JOIN r AS b ON a.vec_id % 100 = 0),
p AS (SELECT a, b, s FROM s WHERE same AND a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS k
      FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s)
SELECT a AS anchor_id, p AS positive_id, k::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 5
"""

ORACLES = {
    "op12_prefix_trie": OP12,
    "op13_hard_negatives": OP13,
    "op3_mixed_sources": OP3,
    "op6_quality_rules": OP6,
    "op4_repeated_passages": OP4,
    "op7_near_duplicates": OP7,
}
