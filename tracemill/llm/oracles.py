"""SQL for the corpus operators that SQL can express."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), x -> x <> '')"

EXACT = r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size,
             min_by(doc_id, (-points, doc_id)) AS keep_id FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM n JOIN g USING (text_sha256)
"""


PASSAGES = r"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, doc_id,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents),
w AS MATERIALIZED (
    SELECT rid, s, md5(array_to_string(ws[s : s + 34], ' ')) AS h
    FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS s FROM d WHERE len(ws) >= 35)),
r AS (SELECT rid, s FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
c AS (SELECT DISTINCT rid, s + k AS p FROM r, range(35) t(k)),
g AS (SELECT rid, list(p) AS gone FROM c GROUP BY rid),
k AS (
    SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept
    FROM (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) x
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.rid = x.rid AND c.p = x.p)
    GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (rid) LEFT JOIN k USING (rid)
"""

NEGATIVES = r"""
WITH r AS MATERIALIZED (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
    SELECT anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
           CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def llm_oracles() -> dict[str, str]:
    return {"op8_exact_copies": EXACT, "op11_repeated_passages": PASSAGES, "op13_hard_negatives": NEGATIVES}
