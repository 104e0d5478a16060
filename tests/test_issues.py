"""Issues of several rows as one set, in which empty arrays take no place."""

from factloom.operators import scoring as S
from pyspark.sql import functions as F


def test_issues_of_rows_are_one_set_and_empty_arrays_are_left_out(spark):
    rows = [(1, []), (1, ["a", "b"]), (1, ["b", "c"]), (1, None), (2, []), (2, None)]
    df = spark.createDataFrame(rows, "k int, issues array<string>").groupBy("k").agg(S.all_issues("issues").alias("x"))
    assert {r["k"]: sorted(r["x"]) for r in df.collect()} == {1: ["a", "b", "c"], 2: []}
    assert "size(issues" in df._jdf.queryExecution().optimizedPlan().toString()
