"""The registered queries of this subpackage."""

from __future__ import annotations

from . import ann_search, best_fit_packing, exact_topk, hard_negatives, minhash_dedup, mixing, quality_cnn, secret_scan, shards, suffix_dedup, token_counts, toxicity, whitening


def queries() -> dict:
    return {
        "op1_minhash_dedup": minhash_dedup.op1,
        "op2_suffix_dedup": suffix_dedup.op2,
        "op3_best_fit_packing": best_fit_packing.op3,
        "op4_mixing": mixing.op4,
        "op5_secret_scan": secret_scan.op5,
        "op6_toxicity": toxicity.op6,
        "op7_exact_topk": exact_topk.op7,
        "op8_ann_search": ann_search.op8,
        "op9_quality_classifier": quality_cnn.op9,
        "op10_sharding": shards.op10,
        "op11_hard_negatives": hard_negatives.op11,
        "op12_token_counts": token_counts.op12,
        "op13_whitening": whitening.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_topk": OP7, "op11_hard_negatives": OP11}


OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

OP11 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.r AS c, c.vec_id, a.label = c.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id IS DISTINCT FROM a.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS FIRST) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.r, p.c ORDER BY s.score DESC, s.vec_id NULLS FIRST) AS rank
      FROM p JOIN s ON p.r = s.r AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
