"""Rules of planning, unions and evaluation that no query shows: P12, P13, F21, F22, U8 to U11, S14, S15, A27, A28."""

from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import evaluation as EV
from factloom.operators import expectations as EX
from factloom.operators import policy as PO


def test_plans_become_rows_with_stable_references(spark):
    kind = "run_id string, objectives array<struct<claim_ref string, intent string, target string, priority double, queries array<struct<query string, priority double>>>>"
    one = ("c1", "primary", "The  Report", 0.5, [("a", 0.9), ("b", None)])
    same, other, none = ("c1", "primary", "the report", 0.1, [("c", 0.2)]), ("c1", "support", "the report", 0.1, [("d", 0.2)]), ("c2", "primary", "x", 0.1, [])
    plans = spark.createDataFrame([("r", [one, same, other, none]), ("s", [one]), ("t", None)], kind)
    rows = {(r["run_id"], r["query"]): r for r in PO.normalized_plan(plans).collect()}
    assert sorted(rows) == [("r", "a"), ("r", "b"), ("r", "c"), ("r", "d"), ("s", "a"), ("s", "b")]
    ref = rows["r", "a"]["objective_ref"]
    assert rows["r", "b"]["objective_ref"] == rows["s", "a"]["objective_ref"] == ref and rows["r", "c"]["objective_ref"] == f"{ref}-2"
    assert not rows["r", "d"]["objective_ref"].startswith(ref) and rows["r", "d"]["intent"] == "support"
    assert [rows["r", q]["priority"] for q in "ab"] == [0.9, 0.5] and rows["r", "b"]["query_no"] == 1


def test_intents_that_claims_need(spark):
    rows = [("a", "factual", "checkable"), ("b", "quotation", "checkable"), ("c", "attribution", "not_fact_checkable"), ("d", "opinion", "not_fact_checkable")]
    c = spark.createDataFrame([("r", *x) for x in rows], "run_id string, claim_ref string, claim_kind string, fact_checkability string")
    got = {r["claim_ref"]: r["required"] for r in PO.required_intents(c).collect()}
    assert got == {"a": ["primary", "contradiction"], "b": ["primary", "contradiction", "attribution"], "c": ["attribution"], "d": []}


def test_browser_is_for_what_matters(spark):
    rows = [(0.75, "SECONDARY_REPORT", ["support"], True), (0.74, "SECONDARY_REPORT", ["support"], False), (0.1, "PRIMARY", [], True), (0.1, "OPINION", ["x", "correction"], True), (0.1, "OPINION", [], False)]
    df = spark.createDataFrame(rows, "p double, t string, i array<string>, want boolean")
    assert df.where(PO.needs_browser(F.col("p"), F.col("t"), F.col("i")) != F.col("want")).count() == 0


def test_scoring_needs_claims_evidence_and_known_multipliers(spark):
    some, none = spark.range(1), spark.range(0)
    m = lambda *v: spark.createDataFrame([(x,) for x in v], "multiplier double")
    codes = lambda *a: {r["code"]: r["n"] for r in EX.scoring_inputs(*a).collect()}
    assert codes(some, some, m(0.0, 0.1, 0.35, 1.0)) == {} == codes(some, some, m())
    assert codes(none, none, m(0.5, None, 1.0)) == {"NO_CLAIMS": 1, "NO_EVIDENCE": 1, "UNKNOWN_MULTIPLIER": 2}


def test_unions_keep_order_keys_and_seeds(spark):
    s = lambda *t: spark.createDataFrame([(x,) for x in t], "sentence string")
    got = PO.sections(("summary", s("a", "b")), ("factual", s()), ("contradiction", s("c"))).orderBy("section_no", "sentence").collect()
    assert [(r["section"], r["section_no"], r["sentence"]) for r in got] == [("summary", 0, "a"), ("summary", 0, "b"), ("contradiction", 2, "c")]
    kv = lambda *t: spark.createDataFrame(list(t), "k string, v int")
    got = PO.replaced(kv(("a", 1), ("a", 2), ("b", 3)), kv(("a", 9), ("c", 4)), ["k"]).collect()
    assert sorted((r["k"], r["v"]) for r in got) == [("a", 9), ("b", 3), ("c", 4)]
    q = spark.createDataFrame([("r", "c1", '"Big   TITLE"', "primary", 0.4, 0), ("r", "c1", '"Other"', "support", 0.4, 1)], "run_id string, claim_ref string, query string, intent string, priority double, query_no int")
    t = spark.createDataFrame([("r", "c1", "big title"), ("r", "c1", "other"), ("s", "c1", "big title")], "run_id string, claim_ref string, title string")
    new = PO.with_title_queries(q, t).where("query_no = -1").collect()
    assert sorted((r["run_id"], r["query"], r["intent"], r["priority"]) for r in new) == [("r", '"other"', "primary", 1.0), ("s", '"big title"', "primary", 1.0)]
    c = spark.createDataFrame([("r", "u", 0.2, "search")], "run_id string, url string, priority double, source_origin string")
    runs = spark.createDataFrame([("r", "v"), ("s", None)], "run_id string, submitted_url string")
    assert sorted(tuple(r) for r in PO.with_submitted_url(c, runs).collect()) == [("r", "u", 0.2, "search"), ("r", "v", 1.0, "submitted_url")]


def test_query_strings_and_searchable_text(spark):
    df = spark.createDataFrame([("  a   claim ", ["a claim", "x", "v " * 2000, None], "Rome grew 12% in 2020", ["rome", "grew"], {"k": "V"}), ("e", None, "e", [], None)], "e string, v array<string>, t string, terms array<string>, m map<string,string>")
    got = df.select(X.retrieval_queries(F.col("e"), F.col("v"), F.col("t"), F.col("terms")).alias("q"), X.searchable_text(F.col("e"), F.lit(None), F.col("t"), metadata=F.col("m")).alias("s")).collect()
    q = got[0]["q"]
    assert q[0] == "a claim" and q.count("a claim") == 1 and "x" not in q and max(map(len, q)) == 1600 and q[2] == "Rome grew 12% in 2020" and q[-1] == "rome grew"
    assert q[3] == "Rome 12 2020" and len(q) <= 8 and got[1]["q"] == []  # no word boundary between a percent sign and a space
    assert [r["s"] for r in got] == ['a claim rome grew 12% in 2020 {"k":"v"}', "e e"]


def test_accuracy_of_fields(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "c": "3"}), ({"a": "1"}, {"a": "1"}), (None, None)], "e map<string,string>, p map<string,string>")
    assert [r[0] for r in df.select(EV.field_checks(F.col("e"), F.col("p"))).collect()] == [[1, 0, 0], [1], []]
    score = lambda d: d.agg(EV.mapping_accuracy(F.col("e"), F.col("p"))).first()[0]
    assert score(df) == 0.5 and score(df.where("e is null")) == score(df.limit(0)) == 1.0
