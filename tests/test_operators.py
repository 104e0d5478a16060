from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from factloom.operators import chunking as C
from factloom.operators import evaluation as E
from factloom.operators import html as H
from factloom.operators import numeric_audit as N
from factloom.operators import policy as PO
from factloom.operators import provenance as P
from factloom.operators import retrieval as R
from factloom.operators import scoring as S
from factloom.streaming import events as EV


def test_balance_golden(spark):
    rows = [(-1.0, "0.976", "1.00"), (0.5, "0.8", "0.35"), (0.5, "0.75", "0.00")]
    w = spark.createDataFrame([("r", Decimal(str(v)), Decimal(q) * Decimal(m)) for v, q, m in rows], "run_id string, value decimal(3,2), weight decimal(12,10)")
    b = S.balance(w, ["run_id"]).first()
    assert (float(b["supporting"]), float(b["contradicting"])) == (0.14, 0.976)
    assert (round(b["support"], 1), round(b["consistency"], 1)) == (12.5, 74.9)


def test_lexical_scores_equal_the_row_function(spark):
    from factloom.functions import text as X

    q = spark.createDataFrame([(1, "aa bb aa"), (2, "zz")], "q int, t string")
    d = spark.createDataFrame([(1, "aa bb cc"), (2, "aa aa bb bb"), (3, "")], "d int, t string")
    got = {(r["q"], r["d"]): r["lexical"] for r in R.lexical_scores(q, d, ("q", "t"), ("d", "t")).collect()}
    every = q.alias("a").crossJoin(d.alias("b")).select("q", "d", X.lexical_score(F.col("a.t"), F.col("b.t")).alias("s")).where("s > 0")
    assert got == {(r["q"], r["d"]): r["s"] for r in every.collect()}


def test_greedy_distinct(spark):
    rows = [("k", 1, 0.9, "h1", ["a", "b"]), ("k", 2, 0.8, "h1", ["z"]), ("k", 3, 0.7, "h2", ["a", "b"]), ("k", 4, 0.6, "h3", ["c"])]
    df = spark.createDataFrame(rows, "g string, id int, s double, h string, t array<string>")
    got = R.greedy_distinct(df, ["g"], [F.desc("s")], "id", F.col("h"), F.col("t"), 8).orderBy("position").collect()
    assert [r["id"] for r in got] == [1, 4]


def brute_diverse(rows, limit, per_domain=2, reserved=("primary", "support", "contradiction")):
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    kept = []

    def fits(r):
        return r not in kept and sum(k[2] == r[2] for k in kept) < per_domain and all(k[3] != r[3] for k in kept)

    for intent in reserved:
        if len(kept) < limit:
            kept += [r for r in order if intent in r[4] and fits(r)][:1]
    for r in order:
        if len(kept) < limit and fits(r):
            kept.append(r)
    return [r[0] for r in kept]


def test_select_diverse_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(i, round(rng.random(), 2), f"d{rng.randrange(6)}", f"c{rng.randrange(25)}", rng.sample(["primary", "support", "contradiction", "context"], 2)) for i in range(60)]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, id int, p double, d string, c string, i array<string>")
    for limit in (2, 7):
        got = R.select_diverse(df, ["g"], "id", F.col("p"), F.col("d"), F.col("c"), F.col("i"), limit).orderBy("position").collect()
        assert [r["id"] for r in got] == brute_diverse(rows, limit)


def test_interleave(spark):
    df = spark.createDataFrame([("r", c, p, s) for c, p, s in (("a", 1, 0.9), ("a", 2, 0.8), ("b", 1, 0.1), ("b", 2, 0.2))], "run string, c string, p int, s double")
    got = R.interleaved(df, ["run"], "c", "p", F.col("s"), 3).orderBy("position").collect()
    assert [(r["c"], r["p"], r["rank"]) for r in got] == [("a", 1, 1), ("b", 2, 1), ("a", 2, 2)]


def test_multipliers(spark):
    nodes = spark.createDataFrame([("r", "a", "PRIMARY"), ("r", "b", "SECONDARY_REPORT"), ("r", "c", "INDEPENDENT_ANALYSIS"), ("r", "d", "PRIMARY"), ("r", "e", "PRIMARY"), ("r", "f", "PRIMARY")], "run string, ref string, source_type string")
    edges = spark.createDataFrame([("r", "a", "b", "REPUBLISHES", 1.0, ""), ("r", "a", "c", "USES_SAME_DATA", 1.0, ""), ("r", "a", "d", "USES_SAME_DATA", 1.0, ""), ("r", "a", "e", "CITES", 1.0, ""), ("r", "a", "f", "CITES", 1.0, ""), ("r", "a", "f", "USES_SAME_DATA", 1.0, "")], "run string, parent string, child string, relationship string, confidence double, method string")
    got = {r["ref"]: float(r["multiplier"]) for r in P.multipliers(nodes, edges, ["run"]).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 0.35, "d": 0.35, "e": 1.0, "f": 0.10}


def test_dependencies_and_clusters(spark):
    body = " ".join(f"word{i}" for i in range(200))
    rows = [("r", "original", body, 1), ("r", "copy", body.upper(), 2), ("r", "near", body.replace("word7 ", "other "), 3), ("r", "alone", " ".join(f"else{i}" for i in range(200)), 4)]
    s = spark.createDataFrame(rows, "run string, ref string, body string, at int")
    f = P.features(s, "ref", "body")
    edges = P.first_edges(P.pair_edges(P.candidate_pairs(f, ["run"], "ref", F.col("at")), f, ["run"], "ref"), ["run"])
    got = {(r["parent"], r["child"]): r["relationship"] for r in edges.collect()}
    assert got[("original", "copy")] == "REPUBLISHES" and ("original", "near") in got and not any("alone" in k for k in got)
    labels = P.components(s.select("run", "ref"), edges, ["run"])
    c = P.clusters(labels, edges, ["run"], s.select("run", "ref", F.timestamp_seconds("at").alias("at"))).collect()
    big = next(r for r in c if len(r["members"]) > 1)
    assert big["members"] == ["copy", "near", "original"] and big["representative"] == "original" and big["origin_type"] == "syndication_chain"
    assert P.provenance_violations(s.select("run", "ref"), edges, P.multipliers(s.select("run", "ref", F.lit("PRIMARY").alias("source_type")), edges, ["run"]), ["run"]).count() == 0


def test_numeric_audit_goldens(spark):
    i = lambda role, v, unit=None, period=None: Row(role=role, value=v, unit=unit, period=period)
    rows = [
        ("a", "percentage", [i("numerator", "1"), i("denominator", "3")], None, None, None, None),
        ("b", "ratio", [i("numerator", "5"), i("denominator", "2")], None, None, None, None),
        ("c", "total", [i("v", "0.1"), i("w", "0.2")], None, "0.3", None, None),
        ("d", "comparison", [i("current", "125"), i("baseline", "100")], None, None, "0.01", "ROUND_HALF_UP"),
        ("e", "percentage", [i("numerator", "1"), i("denominator", "0")], None, None, None, None),
        ("f", "ratio", [i("numerator", "1"), i("baseline", "2")], None, None, None, None),
        ("g", "total", [i("v", "1", "kg"), i("w", "2", "m")], None, None, None, None),
        ("h", "unit_conversion", [i("v", "2", "kilometers")], "m", None, None, None),
        ("i", "total", [i("v", "x")], None, None, None, None),
        ("j", "total", [i("v", "1"), i("v", "2")], None, None, None, None),
        ("k", "total", [i("v", "1", None, "2020"), i("w", "2")], None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, operation string, inputs array<struct<role: string, value: string, unit: string, period: string>>, output_unit string, claimed_value string, quantum string, mode string")
    got = {r["id"]: r for r in N.audit(df).collect()}
    assert got["a"]["value"] == "33.33333333333333333333333333" and got["b"]["value"] == "2.5"
    assert got["c"]["value"] == "0.3" and got["c"]["matches"] is True and got["d"]["value"] == "25.00" and got["h"]["value"] == "2000"
    assert {k: got[k]["status"] for k in "efgijk"} == {"e": "zero_denominator", "f": "missing_denominator", "g": "mismatched_units", "i": "invalid_input", "j": "source_value_conflict", "k": "period_mismatch"}


def test_markdown_and_chunks():
    md = "# T\n\nIntro text.\n\n## S\nALICE: hello\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---\n\nEnd."
    b = C.markdown_blocks(md)
    assert [x["kind"] for x in b] == ["heading", "paragraph", "heading", "transcript_turn", "table_row", "paragraph", "table_row", "semantic_break", "paragraph"]
    assert b[3]["heading_path"] == ["T", "S"]
    c = C.lite_chunks_of(b)
    assert [x["heading_path"] for x in c] == [["T"], ["T", "S"], ["T", "S"]]
    assert c[1]["chunk_text"].startswith("Context overlap: Intro text.") and c[2]["chunk_text"] == "End."


def test_passages_stay_short_and_whole():
    text = " ".join(f"Sentence number {i} has some words." for i in range(80)) + " " + "x" * 1000
    parts = C.passages_of(C.fallback_blocks(text), 400, 80)
    assert all(len(p["text"]) <= 400 for p in parts)
    joined = " ".join(p["text"] for p in parts)
    assert all(f"number {i} " in joined for i in range(80))


def test_html(spark):
    html = "<html><head><title>T</title><meta name='author' content='A'></head><body><nav><p>no</p></nav><article><h1>Head</h1><p>One  <b>two</b>.</p><table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>1</td></tr></table><blockquote>Q</blockquote><p>BOB: hi there</p><a href='/x'>l</a><!-- c --></article></body></html>"
    d = H.parse_page(html, "http://e.org/p")
    assert d["title"] == "T" and d["author"] == "A" and d["links"] == ["http://e.org/x"]
    assert [(b["kind"], b["text"]) for b in d["blocks"]] == [("heading", "Head"), ("paragraph", "One two ."), ("table_row", "k | v"), ("table_row", "k: a | v: 1"), ("quote", "Q"), ("transcript_turn", "BOB: hi there")]
    p = spark.createDataFrame([(1, html, "u"), (2, None, "u"), (3, "<p>access denied</p>", "u")], "page_id int, html string, url string")
    assert [r["status"] for r in H.extract(p).orderBy("page_id").collect()] == ["EXTRACTION_FAILED", "EXTRACTION_FAILED", "BOT_BLOCKED"]


def test_evaluation_metrics(spark):
    lab = spark.createDataFrame([("supported", "supported"), ("supported", "mixed"), ("mixed", "mixed")], "e string, p string")
    assert E.macro_f1(lab, "e", "p").first()[0] == pytest.approx((2 / 3 + 2 / 3) / 2)
    e = spark.createDataFrame([("c", 1, "a"), ("c", 1, "b"), ("c", 2, "d")], "case string, cluster int, member string")
    p = spark.createDataFrame([("c", 1, "a"), ("c", 1, "b"), ("c", 1, "d")], "case string, cluster int, member string")
    assert E.cluster_f1(e, p, "case").first()[0] == pytest.approx(0.5)
    assert E.cluster_pairs(e, "case", "cluster", "member").count() == 1


def test_rate_limits():
    assert EV.fixed_window_rows(-1.0, 0, [0, 1, 2, 10, 11], 2, 10)[2] == [True, True, False, True, True]
    assert EV.sliding_log_rows([], [0, 1, 2, 10.5, 11.5], 2, 10)[1] == [True, True, False, True, True]
    assert EV.transition_rows(0, False, ["QUEUED", "SCORING", "VALIDATING", "COMPLETED", "SCORING"])[2] == [True, True, False, True, False]


def test_monotone_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (2, 1, "b")], "k int, n bigint, t string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = EV.event_stream(spark, str(tmp_path / "in"))
    out = EV.run_to_end(EV.monotone_log(s, "k", "n"), f"file://{tmp_path}")
    assert sorted(map(tuple, out.collect())) == [(1, 5, "a"), (2, 1, "b")]


def test_initial_queries(spark):
    q = spark.createDataFrame([("r", "c1", "primary", "Q one", 0.9, 0), ("r", "c1", "contradiction", "q two", 0.1, 1), ("r", "c1", "context", "q  ONE", 0.95, 2), ("r", "c1", "context", "q three", 0.5, 3)], "run_id string, claim_ref string, intent string, query string, priority double, query_no int")
    runs = spark.createDataFrame([("r", "QUICK", False)], "run_id string, depth string, attribution_required boolean")
    got = {r["query_no"]: (r["mandatory"], r["phase"]) for r in PO.initial_queries(q, q.select("run_id", "claim_ref").distinct(), runs).collect()}
    assert got == {0: (True, "one"), 1: (True, "one"), 2: (False, None), 3: (False, "one")}
