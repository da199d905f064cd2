"""The DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    # Bounds are reached in the order of size over weight: the first source that stays below its bound, with all after it, shares
    # what the sources before it leave.
    "op3_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
     t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
     n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM t),
     w AS (SELECT *, CAST([5, 2, 1][number % 3 + 1] AS DOUBLE) AS weight, (SELECT sum(source_size) FROM t) AS total FROM n),
     l AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY source_size / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
     s AS (SELECT *, first_value(CASE WHEN level * weight <= 3 * source_size THEN level END IGNORE NULLS)
                     OVER (ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS share FROM l),
     g AS (SELECT source, source_size, coalesce(least(share * weight, CAST(3 * source_size AS DOUBLE)), CAST(3 * source_size AS DOUBLE)) AS target FROM s),
     r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM g)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) / 281474976710656.0
                                            < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""",
    "op6_decontamination": rf"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
     g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS gram
           FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
     d AS (SELECT doc_id, row_number() OVER () AS row_id, {_WORDS} AS w FROM documents),
     h AS (SELECT DISTINCT row_id, item_id, i, r.n FROM
             (SELECT row_id, n, i, list_slice(w, i, i + n - 1) AS gram FROM
               (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g))) r
           JOIN g ON r.gram = g.gram AND r.n = g.n),
     p AS (SELECT row_id, count(DISTINCT i + k) AS n_hit FROM (SELECT row_id, i, unnest(range(0, n)) AS k FROM h) GROUP BY row_id),
     s AS (SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row_id, item_id FROM h) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (row_id) LEFT JOIN s USING (row_id)""",
    "op11_hard_negatives": r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_dot_product(a.c, b.c) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.c) = len(b.c)),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS place
           FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 5""",
    # The CRC-32 is worked out bit by bit. Costs, edits and repaired lines are carried together from the last row back, one
    # column per state (0 nothing yet, 1 after system, 2 after user, 3 after assistant).
    "op12_conversations": r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
     c AS (SELECT *, xor(list_reduce(list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT)),
                  lambda h, b: list_reduce([CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0], lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(h, b)),
                  CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM k),
     d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
           FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE kind <> 0)),
     o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
     f AS (SELECT *, substr(role, 1, 1) AS s, lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS s_next,
                  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                       WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault FROM o),
     n AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (s_next IS NOT NULL AND s || s_next NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS size FROM f GROUP BY conv_id),
     r AS (SELECT conv_id, size + 1 AS i, {'c': 0, 'a': '', 't': ''} AS v0, {'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS v1,
                  {'c': 3, 'a': 'I', 't': chr(10) || 'assistant:'} AS v2, {'c': 0, 'a': '', 't': ''} AS v3 FROM n
           UNION ALL
           SELECT conv_id, i, least(b0, {'c': 3 + u.c, 'a': 'I' || u.a, 't': chr(10) || 'user:' || u.t}), least(b1, {'c': 3 + u.c, 'a': 'I' || u.a, 't': chr(10) || 'user:' || u.t}), u, w FROM
           (SELECT *, least(b2, {'c': 3 + b3.c, 'a': 'I' || b3.a, 't': chr(10) || 'assistant:' || b3.t}) AS u, least(b3, {'c': 3 + b2.c, 'a': 'I' || b2.a, 't': chr(10) || 'user:' || b2.t}) AS w FROM
           (SELECT conv_id, i, least(x0, CASE WHEN free AND s = 's' THEN {'c': more + v1.c, 'a': 'K' || v1.a, 't': line || v1.t} WHEN free AND s = 'u' THEN keep_u ELSE x0 END, CASE WHEN free THEN to_u ELSE x0 END) AS b0,
                   least(x1, CASE WHEN free AND s = 'u' THEN keep_u ELSE x1 END, CASE WHEN free THEN to_u ELSE x1 END) AS b1,
                   least(x2, CASE WHEN free AND s = 'a' THEN {'c': more + v3.c, 'a': 'K' || v3.a, 't': line || v3.t} ELSE x2 END,
                         CASE WHEN free THEN {'c': 3 + more + v3.c, 'a': 'R' || v3.a, 't': chr(10) || 'assistant:' || text || v3.t} ELSE x2 END) AS b2,
                   least(x3, CASE WHEN free AND s = 'u' THEN keep_u ELSE x3 END, CASE WHEN free THEN to_u ELSE x3 END) AS b3 FROM
           (SELECT r.conv_id, f.i, f.s, f.text, chr(10) || f.role || ':' || f.text AS line, f.fault IS NULL OR f.fault = 'truncated' AS free, CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END AS more, v1, v3,
                   {'c': 4 + v0.c, 'a': 'D' || v0.a, 't': v0.t} AS x0, {'c': 4 + v1.c, 'a': 'D' || v1.a, 't': v1.t} AS x1, {'c': 4 + v2.c, 'a': 'D' || v2.a, 't': v2.t} AS x2, {'c': 4 + v3.c, 'a': 'D' || v3.a, 't': v3.t} AS x3,
                   {'c': CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END + v2.c, 'a': 'K' || v2.a, 't': chr(10) || f.role || ':' || f.text || v2.t} AS keep_u,
                   {'c': 3 + CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END + v2.c, 'a': 'R' || v2.a, 't': chr(10) || 'user:' || f.text || v2.t} AS to_u
            FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = r.i - 1))))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(v0.c, 0) AS BIGINT) AS cost, coalesce(v0.a, '') AS audit, sha256(substr(coalesce(v0.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN n ON e.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN (SELECT * FROM r WHERE i = 1) z ON e.conv_id IS NOT DISTINCT FROM z.conv_id""",
}
