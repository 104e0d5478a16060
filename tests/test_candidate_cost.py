"""What hybrid candidates cost: texts stay in their tasks, and of all vector blocks' best only the whole's meet their vectors."""

import numpy as np

from factloom.operators import retrieval as R
from factloom.plans import retrieval_queries as Q


def test_texts_of_candidates_are_not_shuffled(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(0, "alpha beta"), (1, "gamma")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = [(i, "alpha beta" if i % 3 else "gamma delta", f"src{i % 4}") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(8).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, [1.0, i / 7]) for i in range(5)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    out = Q._candidates(spark, d)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [doc_id" in plan and "SortMergeJoin [doc_id" not in plan
    got = {(r["item_id"], r["doc_id"]): r for r in out.collect()}
    wanted = {(0, i) for i in range(30) if i % 3} | {(1, i) for i in range(30) if not i % 3} | {(c, i) for c in (0, 1) for i in range(5)}
    assert set(got) == wanted
    assert {k for k, r in got.items() if r["similarity"] is not None} == {(c, i) for c in (0, 1) for i in range(5)}
    assert all(r["lexical"] == (r["item_id"] == (0 if i % 3 else 1)) for (_, i), r in got.items())


def test_only_the_best_of_all_blocks_meet_their_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(3, 4)), rng.normal(size=(400, 4))
    y[300:] = y[299]  # equal ones part by key alone
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item int, qv array<double>")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "doc long, v array<double>")
    seen, keep = [], R.best_per
    monkeypatch.setattr(R, "best_per", lambda df, *a: (seen.append(df.count()), keep(df, *a))[1])
    got = {}
    for r in R.vector_shortlists(q, c, ("item", "qv"), ("doc", "v"), 5, 20).collect():
        got.setdefault(r["item"], []).append((-round(r["similarity"], 9), r["doc"]))
    cos = {i: sorted((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), j) for j, b in enumerate(y))[:5] for i, a in enumerate(x)}
    assert {i: sorted(v) for i, v in got.items()} == cos
    near = sum(sum(-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9) <= cos[i][4][0] for b in y) for i, a in enumerate(x))
    assert seen == [near]
