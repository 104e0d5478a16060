"""Clusters of both sides in one table."""

from factloom.operators import evaluation as E


def test_one_table_gives_the_same_and_joins_nothing(spark):
    rows = [(1, "a", 1, 1), (1, "b", 1, 1), (1, "b", 1, 1), (1, "c", 2, 1), (2, "a", 1, 2), (2, "d", 1, 2), (2, "e", 1, 3), (2, "f", None, 3)]
    m = spark.createDataFrame(rows, "k int, m string, e int, p int")
    side = lambda c: m.where(f"{c} is not null").selectExpr("k", f"{c} AS cluster", "m AS member").distinct()
    got = E.cluster_f1_of(m, "k", "m", "e", "p")
    assert got.first() == E.cluster_f1(side("e"), side("p"), "k").first()
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
