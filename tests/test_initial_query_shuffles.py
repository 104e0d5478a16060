"""Initial queries meet their runs once."""

from factloom.operators import policy as PO


def test_queries_are_shuffled_once(spark):
    rows = [(r, c, i, f"q{r % 3} {c} {i}", 0.5, n) for r in range(4) for n, (c, i) in enumerate([(1, "primary"), (1, "contradiction"), (2, "primary"), (None, "attribution"), (3, "primary")])]
    q = spark.createDataFrame(rows, "run_id int, claim_ref int, intent string, query string, priority double, query_no int").repartition(3)
    claims = spark.createDataFrame([(r, c) for r in range(4) for c in (1, 2)], "run_id int, claim_ref int")
    runs = spark.createDataFrame([(r, "QUICK", r % 2 == 0) for r in range(4)], "run_id int, depth string, attribution_required boolean")
    out = PO.initial_queries(q, claims, runs)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(run_id") <= 4
    got = {(r["run_id"], r["query_no"]) for r in out.where("mandatory").collect()}
    assert got == {(r, n) for r in range(4) for n in (0, 1, 2)} | {(0, 3), (2, 3)}
