"""The driver plans the search for dependencies step by step."""

from factloom.plans import retrieval_queries as Q


def test_no_plan_holds_the_whole_search(spark, tmp_path):
    d = str(tmp_path)
    docs = [(i, " ".join(f"w{j + (i // 2) * 500}" for j in range(120)) + f" end {i % 2}", f"s{i}") for i in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    edges = Q.dependency_edges(spark, d)
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange") < 20
    assert {(r["parent"], r["child"]) for r in edges.collect()} == {(str(i), str(i + 1)) for i in range(0, 8, 2)}
