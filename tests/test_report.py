"""The report of one run, with its children in order."""

from factloom.operators import runs as RU


def test_report_has_one_run_with_its_children(spark):
    runs = spark.createDataFrame([("r", "DONE"), ("s", "DONE")], "id string, status string")
    claims = spark.createDataFrame([("r", "c1", 0.2, 1, "low"), ("r", "c2", 0.9, 3, "high"), ("r", "c3", 0.9, 2, "high, older"), ("s", "c1", 1.0, 1, "another run's")], "run_id string, claim_id string, importance_weight double, created_at int, text string")
    evidence = spark.createDataFrame([("r", "c2", 5, "e2", "p2", 1.0), ("r", "c2", 4, "e1", "p1", -1.0), ("s", "c2", 1, "e9", "p9", 0.0)], "run_id string, claim_id string, created_at int, evidence_id string, passage_id string, stance_value double")
    calculations = spark.createDataFrame([("r", 2, "k2", "ratio", "1", "failed"), ("r", 1, "k1", "ratio", "2", "passed"), ("s", 1, "k3", "ratio", "2", "failed")], "run_id string, created_at int, calculation_id string, formula_name string, result string, audit_status string")
    citations = spark.createDataFrame([("s", 1, "x1", "p1", "passed")], "run_id string, created_at int, citation_id string, passage_id string, audit_status string")
    rows = RU.report("r", runs, claims, evidence, calculations, citations).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["run_id"], r["status"], r["failed_audits"], r["citations"]) == ("r", "DONE", 1, None)
    assert [c["claim_id"] for c in r["claims"]] == ["c3", "c2", "c1"]  # by importance, then by time
    assert [[e["evidence_id"] for e in c["evidence"] or []] for c in r["claims"]] == [[], ["e1", "e2"], []]
    assert [c["calculation_id"] for c in r["calculations"]] == ["k1", "k2"]
    assert r["limitations"] == ["1 calculation audit(s) require review; inspect audit_status and inputs."]
    other = RU.report("s", runs, claims, evidence, calculations, citations).collect()[0]
    assert [c["text"] for c in other["claims"]] == ["another run's"] and [c["citation_id"] for c in other["citations"]] == ["x1"]
    assert RU.report("none", runs, claims, evidence, calculations, citations).count() == 0
