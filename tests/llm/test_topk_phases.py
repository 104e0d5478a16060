"""The phases of exact top-k: what they skip, and what they may not lose."""

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import exact_topk


def brute(x, ids, queries, k):
    out = []
    for i in queries:
        s = x @ x[ids.index(i)]
        order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-s[j], ids[j]))[:k]
        out += [(i, n + 1, ids[j], int(s[j])) for n, j in enumerate(order)]
    return out


def test_clustered_vectors_let_blocks_be_skipped(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 16))
    middle *= 4 / np.linalg.norm(middle, axis=1, keepdims=True)
    x = np.concatenate([m + rng.normal(size=(100, 16)) * 0.05 for m in middle])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    watch = {}
    got = exact_topk.exact_topk(df, F.col("vec_id") % 20 == 0, query_block=10, block=50, nearest=2, watch=watch).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute(np.floor(64 * x), list(range(len(x))), range(0, len(x), 20), 20)
    for phase, part in (("gather", 0.2), ("collect", 0.5)):
        read, all_ = watch[phase]
        assert 0 < read < part * all_


def test_bounds_hold_for_every_vector():
    rng = np.random.default_rng(4)
    x, q = np.floor(rng.normal(size=(200, 10)) * 64), np.floor(rng.normal(size=(30, 10)) * 64)
    pivots = x[:7]
    spans = exact_topk._spans(10, 4)
    at = rng.integers(0, 7, 200)
    far = np.array([[np.linalg.norm((x - pivots[at])[at == p][:, a:b], axis=1).max() for a, b in spans] for p in range(7)])
    for (a, b), bound in zip(spans, exact_topk.list_bounds(q, pivots, far), strict=True):
        assert all((q[:, a:b] @ x[i, a:b] <= bound[:, at[i]]).all() for i in range(200))


def test_all_scores_equal_or_negative(spark):
    rows = [(i, [-1.0 * (i % 2), 0.5]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_topk.exact_topk(df, F.col("vec_id") % 20 == 0, k=5, query_block=2, block=8, nearest=1).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute(np.floor(64 * np.array([v for _, v in rows])), list(range(60)), (0, 20, 40), 5)
