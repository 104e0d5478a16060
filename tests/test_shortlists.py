"""Vector shortlists against brute force, and candidates that only vectors find."""

import numpy as np
import pytest

from factloom.operators import retrieval as R
from factloom.plans import retrieval_queries as Q


def test_vector_shortlists_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(7, 5)).round(2), rng.normal(size=(60, 5)).round(2)
    y[9], y[10], y[11] = y[8], y[8], 0
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "item int, qv array<double>")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)] + [(98, None), (97, [1.0])], "doc long, v array<double>")
    got = {}
    for r in R.vector_shortlists(q, c, ("item", "qv"), ("doc", "v"), 6, 16).collect():
        got.setdefault(r["item"], []).append((-round(r["similarity"], 9), r["doc"]))
    cos = {i: sorted((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), j) for j, b in enumerate(y) if b.any())[:6] for i, a in enumerate(x)}
    assert {i: sorted(v) for i, v in got.items()} == cos


def test_a_document_near_by_vector_alone_is_a_candidate(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(0, "alpha beta")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = [(0, "nothing here", "src3"), *((i, "alpha beta gamma", "src3") for i in range(1, 250)), (250, "quite different words", "src0")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, [1.0, 0.0]), (250, [1.0, 0.1]), (999, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    got = {r["doc_id"]: r for r in Q._candidates(spark, d).collect()}
    assert set(got) == {0, 250, *range(1, 201)}
    assert got[250]["lexical"] == 0 and got[250]["similarity"] == pytest.approx(0.9975, abs=1e-3)
    assert got[3]["lexical"] == 1 and got[3]["similarity"] == pytest.approx(0.5) and got[1]["similarity"] is None
