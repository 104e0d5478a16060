import hashlib
import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import authority as AU
from factloom.operators import expectations as XP
from factloom.operators import policy as PO
from factloom.operators import provenance as P
from factloom.operators import retrieval as R
from factloom.operators import runs as RU
from factloom.operators import scoring as S
from factloom.sources import corpus as C
from factloom.streaming import events as EV


def test_corpus_sources(spark, tmp_path):
    doc = {"id": "d1", "title": "T", "content_markdown": "# T", "document_date": "2024-01-02"}
    (tmp_path / "c.json").write_text(json.dumps({"corpus_version": "v1", "documents": [doc]}))
    r = C.read_corpus(spark, str(tmp_path / "c.json")).first()
    assert (r["corpus_version"], r["visibility"], str(r["document_date"])) == ("v1", "public", "2024-01-02")
    (tmp_path / "My File.md").write_text("intro\n# Head line\n")
    r = C.read_markdown(spark, str(tmp_path / "My File.md")).first()
    assert (r["id"], r["title"]) == ("my-file", "Head line")


def test_writes_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for _ in range(2):
        C.replace_partitions(df, str(tmp_path / "t"), ["k"])
    C.replace_partitions(df.where("k = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "t"), ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 9), ("b", 2)]
    assert C.cached(df, str(tmp_path / "cache")).count() == C.cached(df, str(tmp_path / "cache")).count() == 2


def test_upsert_and_export(spark):
    old, new = spark.createDataFrame([("a", 1, "x")], "k string, at int, v string"), spark.createDataFrame([("a", 2, "y"), ("b", 1, "z")], "k string, at int, v string")
    assert sorted((r["k"], r["v"]) for r in C.upsert(old, new, ["k"], "at").collect()) == [("a", "y"), ("b", "z")]
    assert [r["k"] for r in C.new_only(old, new, ["k"]).collect()] == ["b"]
    e = C.json_export(new.where("k = 'b'"), "k").first()
    assert e["body"] == '{"at":1,"k":"b","v":"z"}' and e["sha256"] == hashlib.sha256(e["body"].encode()).hexdigest()


def test_judgments_and_context(spark):
    chunks = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.5), ("q", "c", 0.7)], "q string, chunk string, combined double")
    j = spark.createDataFrame([("q", "a", 1, "supports", 0.9), ("q", "a", 2, "irrelevant", 1.0), ("q", "b", 1, "background", 0.2)], "q string, chunk string, position int, stance string, confidence double")
    judged = R.with_judgments(chunks, j, ["q", "chunk"])
    assert [r["chunk"] for r in R.select_context(judged, ["q"], "chunk").orderBy("rank").collect()] == ["a", "b"]
    assert judged.agg(R.has_direct_evidence(F.col("stance"), F.col("confidence"), F.col("combined"))).first()[0]
    s = spark.createDataFrame([(1, ["a"]), (2, ["x"]), (3, [])], "i int, citation_ids array<string>")
    assert [r["passed"] for r in R.citation_audit(s, F.array(F.lit("a"), F.lit("b"))).orderBy("i").collect()] == [True, False, False]


def test_citations_and_cycles(spark):
    s = spark.createDataFrame([("r", "a", "http://A.org:80/x/", [], "Alpha Times"), ("r", "b", "http://b.org", ["http://a.org/x"], "see alpha times now")], "run string, ref string, url string, links array<string>, body string")
    e = P.citation_edges(s, ["run"], "ref", "url", "links").first()
    assert (e["parent"], e["child"], e["confidence"]) == ("a", "b", 0.99)
    n = P.named_edges(s, ["run"], "ref", "body", F.when(F.col("ref") == "a", F.array(F.lit("Alpha Times"))).otherwise(F.array().cast("array<string>"))).collect()
    assert [(r["parent"], r["child"]) for r in n] == [("a", "b")]
    c = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("v", None)], "claim_ref string, parent_ref string")
    assert sorted(r[0] for r in P.has_cycle(c).collect()) == ["x", "y", "z"]


def test_rejection_gates(spark):
    df = spark.createDataFrame([(0.4, 0.9, True, True, None, "neutral", False, False), (0.9, 0.9, False, True, None, "partially_contradicts", True, True), (0.9, 0.9, True, True, None, "neutral", False, False)], "r double, c double, e boolean, p boolean, l boolean, s string, g boolean, x boolean")
    got = [r[0] for r in df.select(S.rejection_reasons(*[F.col(c) for c in "rceplsgx"])).collect()]
    assert got == [["relevance_below_minimum"], [], ["neutral_without_explicit_evidence"]]


def test_lifecycle(spark):
    e = spark.createDataFrame([("r", 1, "QUEUED"), ("r", 2, "SCORING"), ("r", 3, "VALIDATING"), ("r", 4, "COMPLETED"), ("r", 5, "FAILED")], "run_id string, sequence int, stage string")
    assert [(r["sequence"], r["reason"]) for r in RU.transition_violations(e).orderBy("sequence").collect()] == [(3, "BACKWARD"), (5, "TERMINAL")]
    p = e.withColumn("payload", F.lit('{"completed_steps": 4}')).withColumn("message", F.lit(None).cast("string"))
    assert {r["completed_steps"] for r in RU.public_events(p).collect()} == {4}
    assert RU.public_events(p.withColumn("payload", F.lit("{broken"))).where("stage = 'SCORING'").first()["completed_steps"] == 6
    assert spark.range(1).select(RU.is_private_payload(F.lit('{"a": {"Chain-of-Thought": 1}}'))).first()[0]
    assert RU.latest_terminal(e.withColumn("created_at", F.lit(1))).first()["stage"] == "FAILED"


def test_streams_in_batch(spark):
    a = spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, sequence int")
    assert EV.after_cursor(a, spark.createDataFrame([("r", 1)], "run_id string, cursor int"), "run_id", "sequence").count() == 1
    assert EV.with_durable_fallback(a, spark.createDataFrame([("r", 3), ("q", 1)], "run_id string, sequence int"), "run_id").count() == 3


def test_expectations(spark):
    df = spark.createDataFrame([(1, 0.5, 3, 2), (2, 1.5, None, None), (3, None, 1, 4)], "id int, u double, a int, b int")
    got = sorted((r["id"], r["rule"]) for r in XP.violations(df, ["id"], unit=XP.unit("u"), offsets=XP.offsets("a", "b")).collect())
    assert got == [(1, "offsets"), (2, "unit")]
    assert {r["rule"]: r["n"] for r in XP.counts(df, unit=XP.unit("u")).collect()} == {"unit": 1}


def test_discovery_gate_and_reserve(spark):
    runs = spark.createDataFrame([("r", "QUICK", False)], "run_id string, depth string, attribution_required boolean")
    cand = spark.createDataFrame([("r", f"u{i}", None, f"d{i % 3}", ["o1"], "brave_discovery") for i in range(4)], "run_id string, url string, canonical_url string, domain string, objective_refs array<string>, source_origin string")
    obj = spark.createDataFrame([("r", "o1", "c1", "primary")], "run_id string, objective_ref string, claim_ref string, intent string")
    claims = spark.createDataFrame([("r", "c1")], "run_id string, claim_ref string")
    g = PO.discovery_gate(cand, obj, claims, runs).first()
    assert (g["candidates"], g["domains"], g["passed"]) == (4, 3, False) and "MISSING_CONTRADICTION_COVERAGE" in g["reasons"]


def test_plan_contract(spark):
    obj = spark.createDataFrame([("r", "o1", "c1", "primary"), ("r", "o1", "zz", "context")], "run_id string, objective_ref string, claim_ref string, intent string")
    q = spark.createDataFrame([("r", "o1", "a  b", "primary"), ("r", "o9", "A b", "context")], "run_id string, objective_ref string, query string, intent string")
    claims = spark.createDataFrame([("r", "c1", "checkable"), ("r", "c2", "checkable")], "run_id string, claim_ref string, fact_checkability string")
    runs = spark.createDataFrame([("r", "QUICK", True)], "run_id string, depth string, attribution_required boolean")
    codes = {r["code"]: r["n"] for r in PO.plan_violations(obj, q, claims, runs).collect()}
    for code in ("PLAN_DUPLICATE_OBJECTIVE_REF", "PLAN_UNKNOWN_CLAIM_REF", "PLAN_MISSING_CLAIM_COVERAGE", "PLAN_DUPLICATE_QUERY", "PLAN_UNKNOWN_OBJECTIVE_REF", "PLAN_ATTRIBUTION_PATH_MISSING"):
        assert codes[code] == 1


def test_authority(spark):
    holders = spark.createDataFrame([("h1", "legal", "statute", "laws.ca", "Justice Laws", ["canada"], ["canada"], ["act"], ["act", "regulation"], 10, True, False), ("h2", "legal", "court", "court.ca", "Court", ["court of canada"], ["canada"], ["judgment"], ["judgment"], 5, False, True)], "holder_id string, subject string, source_role string, domain string, entity string, aliases array<string>, jurisdictions array<string>, query_terms array<string>, document_terms array<string>, priority int, allow_unknown_jurisdiction boolean, entity_required boolean")
    c = spark.createDataFrame([("r", 1, "c1", "The regulation in Canada changed in 2021", "factual", "text", [], [], [], None)], "run_id string, claim_no int, claim_ref string, text string, claim_kind string, input_kind string, entities array<string>, locations array<string>, metrics array<string>, time_period string")
    p = AU.profiles(c)
    r = p.first()
    assert (r["subject"], r["jurisdiction"], r["year"], r["focus"]) == ("legal", "Canada", "2021", "regulation")
    assert [x["holder_id"] for x in AU.matching_holders(p, holders).collect()] == ["h1"]
    u = spark.createDataFrame([("https://www.laws.ca/x",), ("https://notlaws.ca",)], "url string")
    assert {x["url"]: x["holder_id"] for x in AU.with_holder(u, holders).collect()} == {"https://www.laws.ca/x": "h1", "https://notlaws.ca": None}
    q = spark.range(1).select(AU.preflight_query(F.lit("laws.ca"), F.array(F.lit("site: evil AND good"), F.lit("2021")))).first()[0]
    assert q == 'site:laws.ca "good" "2021"' or q.startswith("site:laws.ca")


def test_versions_and_coverage(spark):
    stored = spark.createDataFrame([("a", 3)], "k string, version_number int")
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, o int")
    got = sorted((r["k"], r["version_number"]) for r in RU.next_versions(new, stored, "k", ["o"]).collect())
    assert got == [("a", 4), ("a", 5), ("b", 1)]
    p = {r["k"]: r["problem"] for r in RU.coverage(spark.createDataFrame([("a",), ("c",)], "k string"), new.select("k"), ["k"]).collect()}
    assert p == {"a": "DUPLICATE", "b": "UNKNOWN", "c": "MISSING"}


@pytest.mark.parametrize(("kind", "text", "submitted", "status"), [("text", " ", None, "INVALID_NORMALIZED_INPUT"), ("article_url", "x", "ftp://a", "INVALID_NORMALIZED_URL"), ("article_url", "x", " https://a.org", "ACCEPTED"), ("article_title", "x", "  ", "INVALID_ARTICLE_TITLE")])
def test_intake(spark, kind, text, submitted, status):
    given = [F.lit(x).cast("string") for x in (None, kind, text, submitted)]
    assert spark.range(1).select(PO.intake_status(*given)).first()[0] == status


def test_private_keys_at_any_depth(spark):
    rows = [('{"raw_prompt": 1}', True), ('{"a": [{"b": {"Internal-Reasoning ": 2}}]}', True), ('{"\\u0070rompt": 1}', True), ('{"a": "\\"prompt\\": x"}', False), ('{"api_key": 1}', False), (None, None)]
    df = spark.createDataFrame(rows, "payload string, want boolean")
    assert [r["private"] for r in df.select(RU.is_private_payload(F.col("payload")).alias("private")).collect()] == [w for _, w in rows]


def test_a_null_time_keeps_the_row(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", 1, "y"), ("b", None, "z")], "k string, at int, v string")
    assert sorted((r["k"], r["v"]) for r in RU.latest_per(df, ["k"], "at").collect()) == [("a", "x"), ("b", "y")]
    assert sorted((r["k"], r["v"]) for r in C.upsert(df, df.where("v = 'y'"), ["k"], "at").collect()) == [("a", "x"), ("b", "y")]


def test_cycles_and_owners_of_decompositions(spark):
    claims = [("r", i, f"c{i}", None, (i + 1) % 30) for i in range(30)] + [("s", 0, "a", "x", None), ("s", 1, "A ", "gone", 5)]
    c = spark.createDataFrame(claims, "run_id string, claim_no int, text string, span string, parent_no int")
    runs = spark.createDataFrame([("r", "DEEP", "x"), ("s", "QUICK", "xx")], "run_id string, depth string, input_text string")
    owners = spark.createDataFrame([("s", 2, "t"), ("s", 1, "t")], "run_id string, owner_no int, text string")
    got = {(r["run_id"], r["code"].removeprefix("DECOMPOSITION_")): r["n"] for r in PO.decomposition_violations(c, runs, owners).collect()}
    assert got == {("r", "CLAIM_CYCLE"): 30, ("s", "DUPLICATE_CLAIM"): 1, ("s", "INVALID_ORIGINAL_TEXT_SPAN"): 1, ("s", "PARENT_INDEX_INVALID"): 1, ("s", "AMBIGUITY_OWNER_INDEX_INVALID"): 1}
