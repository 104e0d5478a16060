"""Queries read whole texts, not prefixes."""

from factloom.plans import retrieval_queries as Q


def test_texts_that_differ_late_are_different(spark, tmp_path):
    d, long = str(tmp_path), " ".join(["x" * 40] * 10)
    docs = [(i, f"{long} {end}", "en", f"s{i}", 500) for i, end in enumerate(("one", "two"))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, "a" * 70)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert sorted(r["doc_id"] for r in Q.diverse_sources(spark, d).collect()) == [0, 1]
    assert Q.stable_ids(spark, d).first()["slug"] == "a" * 70
