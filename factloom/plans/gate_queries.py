"""Registered queries over gates, selections and small aggregates of runs, with their SQL; see record_queries for the inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators import policy as PO
from ..operators import retrieval as R
from ..operators import runs as RU
from ..operators import scoring as S
from ..session import table
from ..sources import corpus as C
from .record_queries import _case

_GIVEN = "l_orderkey AS run_id, l_linenumber AS no, l_partkey AS part, l_suppkey AS supp, 1 - l_discount * 6 AS relevance, 1 - l_tax * 5 AS certainty, l_partkey % 7 <> 0 AS entity, l_suppkey % 6 <> 0 AS period, CASE WHEN l_partkey % 11 = 0 THEN false WHEN l_partkey % 2 = 0 THEN true END AS located, CASE WHEN l_returnflag = 'N' THEN 'neutral' ELSE 'partially_supports' END AS stance, l_suppkey % 4 = 0 AS grounded, l_partkey % 5 = 0 AS explicit"


def _split(columns: str) -> list[str]:
    """The columns of a list whose CASEs have no commas."""
    return [c.strip() for c in columns.split(",")]


def rejection_gates(spark, d):
    """why evidence is refused."""
    e = table(spark, d, "lineitem").selectExpr(*_split(_GIVEN))
    r = S.rejection_reasons(*[F.col(c) for c in ("relevance", "certainty", "entity", "period", "located", "stance", "grounded", "explicit")])
    return e.select("run_id", "no", "part", "supp", F.array_join(r, ",").alias("reasons"))


REJECTION_GATES = f"""WITH e AS (SELECT {_GIVEN} FROM lineitem), g AS (SELECT *, concat_ws(',', CASE WHEN relevance < 0.50 THEN 'relevance_below_minimum' END, CASE WHEN certainty < 0.65 THEN 'extraction_certainty_below_minimum' END, CASE WHEN NOT entity AND NOT grounded THEN 'entity_mismatch' END, CASE WHEN NOT period THEN 'time_period_mismatch' END,
CASE WHEN located = false THEN 'quotation_or_number_not_located' END) AS first FROM e) SELECT run_id, no, part, supp, CASE WHEN first = '' AND stance = 'neutral' AND NOT explicit THEN 'neutral_without_explicit_evidence' ELSE first END AS reasons FROM g"""


def citation_penalties(spark, d):
    """Penalties for partly entailed sentences of each run, and its approved passages."""
    li = table(spark, d, "lineitem")
    sentences = li.selectExpr("l_orderkey AS run_id", "l_linenumber AS sentence_id", "CASE WHEN l_returnflag = 'A' THEN 'partial' ELSE 'full' END AS entailment")
    evidence = li.selectExpr("l_orderkey AS run_id", "l_linenumber AS passage_id", "CASE WHEN l_tax > 0.05 THEN array('x') ELSE array() END AS rejection_reasons")
    passages = li.selectExpr("l_orderkey AS run_id", "l_linenumber AS passage_id", "l_partkey AS snapshot_id", "l_suppkey AS source_ref").distinct()
    snapshots = li.selectExpr("l_orderkey AS run_id", "l_partkey AS snapshot_id", "CASE WHEN l_partkey % 3 = 0 THEN 'PAYWALLED' ELSE 'FETCHED' END AS access_status", "l_suppkey + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS source_ref").distinct()
    approved = S.approved_passages(evidence, snapshots, passages).groupBy("run_id").agg(F.count(F.lit(1)).alias("approved"))
    return S.partial_citation_penalty(sentences).join(approved, "run_id", "left").fillna(0, ["approved"])


CITATION_PENALTIES = """WITH p AS (SELECT DISTINCT l_orderkey AS r, l_linenumber AS n, l_partkey AS k, l_suppkey AS s FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS r, l_partkey AS k, l_suppkey + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS s FROM lineitem WHERE l_partkey % 3 <> 0),
a AS (SELECT p.r, count(*) AS approved FROM p WHERE EXISTS (SELECT 1 FROM s WHERE s.r = p.r AND s.k = p.k AND s.s = p.s) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = p.r AND l_linenumber = p.n AND NOT l_tax > 0.05) GROUP BY 1),
k AS (SELECT l_orderkey AS r, count(DISTINCT l_linenumber) FILTER (l_returnflag = 'A') AS k FROM lineitem GROUP BY 1) SELECT k.r AS run_id, least(20, 5 * k) AS support_penalty, least(25, 7 * k) AS confidence_penalty, coalesce(approved, 0) AS approved FROM k LEFT JOIN a ON a.r = k.r"""


def preflight_plan(spark, d):
    """Holders to ask for the first claims of each run."""
    m = table(spark, d, "lineitem").selectExpr("l_orderkey % 500 AS run_id", "l_linenumber AS claim_no", "l_suppkey % 10 AS priority", "l_partkey AS holder").distinct()
    return PO.preflight_plan(m).select("run_id", "claim_no", "holder", "position")


PREFLIGHT_PLAN = """WITH m AS (SELECT DISTINCT l_orderkey % 500 AS run_id, l_linenumber AS claim_no, l_suppkey % 10 AS priority, l_partkey AS holder FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY run_id, claim_no ORDER BY priority, holder) AS n FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY claim_no, n) AS position FROM n WHERE n <= 2) SELECT run_id, claim_no, holder, position FROM p WHERE position <= 6"""


def mixed_selection(spark, d):
    """Authority and broad results of each run in one list of five, two places kept for broad ones."""
    o = table(spark, d, "orders").selectExpr("o_custkey AS run_id", "o_orderkey AS ref", "o_orderstatus AS kind")
    ranked = lambda k: o.where(k).withColumn("position", F.row_number().over(_by_ref()))
    return PO.mixed_selection(ranked("kind <> 'F'"), ranked("kind <> 'O'"), 5).select("run_id", "ref", "place")


def _by_ref():
    from pyspark.sql import Window

    return Window.partitionBy("run_id").orderBy("ref")


MIXED_SELECTION = """WITH a AS (SELECT o_custkey AS r, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT o_custkey AS r, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders WHERE o_orderstatus <> 'O'),
c AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.r = b.r AND a.k = b.k)), n AS (SELECT r, count(*) AS n FROM c GROUP BY 1), u AS (SELECT a.r, a.k, 0 AS side, p FROM a LEFT JOIN n ON n.r = a.r WHERE p <= 5 - least(2, coalesce(n, 0)) UNION ALL SELECT r, k, 1, p FROM c),
z AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY side, p) AS place FROM u) SELECT r AS run_id, k AS ref, place FROM z WHERE place <= 5"""

_STANCE = _case("event_id % 5", ["'supports'", "'contradicts'", "'background'", "'irrelevant'", "'supports'"])


def context_selection(spark, d):
    """Judged events of each user: the context chosen, whether there is direct evidence, and sentences that pass."""
    chunks = table(spark, d, "events").selectExpr("user_id AS q", "event_id AS chunk", "cast(event_id % 97 AS double) / 97 AS combined")
    j = table(spark, d, "events").where("event_id % 3 > 0").selectExpr("user_id AS q", "event_id AS chunk", "1 AS position", f"{_STANCE} AS stance", "cast(event_id % 11 AS double) / 10 AS confidence")
    again = j.where("chunk % 2 = 0").withColumns({"position": F.lit(0), "stance": F.lit("background")})
    judged = R.with_judgments(chunks, j.unionByName(again), ["q", "chunk"])
    chosen = R.select_context(judged, ["q"], "chunk").groupBy("q").agg(F.collect_list("chunk").alias("chunks"), F.max("context_score").alias("best"))
    direct = judged.groupBy("q").agg(R.has_direct_evidence(F.col("stance"), F.col("confidence"), F.col("combined")).alias("direct"))
    cites = chunks.groupBy("q").agg(F.min("chunk").alias("c")).select("q", F.array("c").alias("citation_ids")).join(chosen.select("q", "chunks"), "q")
    passed = R.citation_audit(cites, F.col("chunks")).select("q", "passed")
    return chosen.select("q", F.size("chunks").alias("n"), F.array_join(F.array_sort("chunks"), ",").alias("chunks"), F.round("best", 6).alias("best")).join(direct, "q").join(passed, "q")


CONTEXT_SELECTION = f"""WITH e AS (SELECT user_id AS q, event_id AS c, (event_id % 97)::DOUBLE / 97 AS s, CASE WHEN event_id % 3 = 0 THEN 'irrelevant' WHEN event_id % 2 = 0 THEN 'background' ELSE {_STANCE} END AS stance, CASE WHEN event_id % 3 = 0 THEN 0 ELSE (event_id % 11)::DOUBLE / 10 END AS k FROM events),
x AS (SELECT *, s * 0.42::DOUBLE + k * 0.32::DOUBLE + CASE WHEN stance IN ('supports', 'contradicts') THEN 0.48::DOUBLE WHEN stance = 'background' THEN 0.16::DOUBLE ELSE 0 END AS w FROM e WHERE stance <> 'irrelevant'), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY w DESC, c) AS n FROM x),
t AS (SELECT q, CAST(count(*) AS INTEGER) AS n, string_agg(c, ',' ORDER BY c) AS chunks, round(max(w), 6) AS best, list(c) AS l FROM r WHERE n <= 8 GROUP BY 1), f AS (SELECT q, bool_or(stance IN ('supports', 'contradicts') AND k >= 0.55 AND s >= 0.32) AS direct, min(c) AS c FROM e GROUP BY 1)
SELECT t.q, n, chunks, best, direct, list_contains(l, f.c) AS passed FROM t JOIN f ON f.q = t.q"""


def batch_sums(spark, d):
    """A25, AJ2: model batches of each order: sums, most attempts, failures by kind, and whether all used one model."""
    b = table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS run_id", "l_partkey AS prompt_tokens", "l_partkey + l_suppkey AS total_tokens", "cast(l_quantity AS bigint) AS latency_ms", "l_linenumber AS attempts", "1 AS repair_count", "'m' AS model", "CASE WHEN l_tax > 0.07 THEN 'b' ELSE 'a' END AS prompt", "0.1D AS temperature",
        "CASE WHEN l_returnflag = 'A' THEN map('schema', 1) WHEN l_returnflag = 'R' THEN map('json', 2, 'schema', 1) END AS failures",
    )
    m = RU.merged_batches(b, ["run_id"])
    count = lambda k: F.coalesce(F.try_element_at("failures", F.lit(k)), F.lit(0)).cast("long")
    return m.select("run_id", "prompt_tokens", "total_tokens", "latency_ms", "repair_count", "batches", "attempts", "uniform", count("schema").alias("schema"), count("json").alias("json"))


BATCH_SUMS = """SELECT l_orderkey AS run_id, CAST(sum(l_partkey) AS BIGINT) AS prompt_tokens, CAST(sum(l_partkey + l_suppkey) AS BIGINT) AS total_tokens, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS latency_ms, count(*) AS repair_count, count(*) AS batches, max(l_linenumber) AS attempts, count(DISTINCT l_tax > 0.07) = 1 AS uniform,
count(*) FILTER (l_returnflag IN ('A', 'R')) AS schema, 2 * count(*) FILTER (l_returnflag = 'R') AS json FROM lineitem GROUP BY 1"""


def run_counts(spark, d):
    """A17, T13, F25, DT2, DT6: active and visible runs of each user, and the demos reviewed last."""
    runs = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey AS user_id", "CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'SCORING' END AS status", "CASE WHEN o_orderkey % 50 = 0 THEN 'public_demo' ELSE 'private' END AS visibility", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS evidence_reviewed_at", "CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS deleted_at")
    lines = table(spark, d, "lineitem").where("l_linenumber = 1").selectExpr("l_orderkey AS run_id", "l_shipdate AS retrieved_at")
    reviewed = RU.reviewed_at(runs.withColumnRenamed("id", "run_id"), lines).withColumnRenamed("run_id", "id")
    counts = RU.active_runs(reviewed).selectExpr("'user' AS kind", "user_id AS id", "active", "visible")
    return counts.unionByName(RU.demo_runs(reviewed).selectExpr("'demo' AS kind", "id", "cast(NULL AS bigint) AS active", "cast(NULL AS bigint) AS visible"))


RUN_COUNTS = """SELECT 'user' AS kind, o_custkey AS id, count(*) FILTER (o_orderstatus <> 'F') AS active, count(*) FILTER (o_orderkey % 11 <> 0) AS visible FROM orders GROUP BY o_custkey UNION ALL
SELECT * FROM (SELECT 'demo', o_orderkey, NULL, NULL FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 50 = 0 AND o_orderstatus = 'F' AND o_orderkey % 11 <> 0 AND (o_orderkey % 3 = 0 OR shipped IS NOT NULL) ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE shipped END DESC, o_orderkey LIMIT 12)"""


def seen_sources(spark, d):
    """IO18, IO19, F17: each source once with its first and last sighting, passages that aren't stored yet, and expired uploads."""
    li = table(spark, d, "lineitem")
    found = li.selectExpr("concat('http://s/', l_suppkey) AS canonical_url", "l_shipdate AS seen_at", "CASE WHEN l_linenumber > 2 THEN concat('T', l_orderkey) END AS title", "'s' AS domain")
    seen = C.merged_sources(found.groupBy("canonical_url", "seen_at", "domain").agg(F.min("title").alias("title"))).selectExpr("'source' AS kind", "canonical_url AS id", "cast(first_seen_at AS string) AS a", "cast(last_seen_at AS string) AS b", "title")
    keys = li.selectExpr("l_suppkey AS snapshot_id", "l_linenumber AS text_hash")
    fresh = C.new_only(keys.where("text_hash < 4"), keys.where("text_hash > 2"), ["snapshot_id", "text_hash"]).selectExpr("'passage' AS kind", "concat(snapshot_id, '/', text_hash) AS id", "'' AS a", "'' AS b", "'' AS title")
    ups = table(spark, d, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS run_id", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS deleted_at", "o_orderdate AS expires_at")
    gone = RU.expired_uploads(ups, F.lit("1993-01-01").cast("timestamp")).selectExpr("'upload' AS kind", "cast(id AS string) AS id", "'' AS a", "'' AS b", "'' AS title")
    return seen.unionByName(fresh).unionByName(gone)


SEEN_SOURCES = """WITH s AS (SELECT 'http://s/' || l_suppkey AS u, l_shipdate AS day, min(CASE WHEN l_linenumber > 2 THEN 'T' || l_orderkey END) AS t FROM lineitem GROUP BY 1, 2)
SELECT 'source' AS kind, u AS id, CAST(min(day) AS VARCHAR) AS a, CAST(max(day) AS VARCHAR) AS b, arg_min(t, day) FILTER (t IS NOT NULL) AS title FROM s GROUP BY 2 UNION ALL
SELECT DISTINCT 'passage', l_suppkey || '/' || l_linenumber, '', '', '' FROM lineitem x WHERE l_linenumber > 2 AND NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_suppkey = x.l_suppkey AND y.l_linenumber = x.l_linenumber AND y.l_linenumber < 4) UNION ALL
SELECT 'upload', CAST(o_orderkey AS VARCHAR), '', '', '' FROM orders WHERE o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 AND o_orderdate < '1993-01-01'"""


def quote_scores(spark, d):
    """A9, M23, ST10, S46: fidelity of quotations with and without translations, stances of judgments, queues and clamps."""
    e = table(spark, d, "events").selectExpr("event_id", "value", "cast(event_id % 101 AS double) AS w", "CASE WHEN event_id % 2 = 0 THEN cast(event_id % 50 AS double) END AS t", f"{_STANCE} AS stance", "cast(event_id % 11 AS double) / 10 AS k", "CASE event_id % 4 WHEN 0 THEN 'QUICK' WHEN 1 THEN 'STANDARD' ELSE 'DEEP' END AS depth")
    c = F.col
    fidelity = L.quote_fidelity(wording=c("w"), speaker_identity=c("w") / 2, completeness=F.lit(80.0), sequence_integrity=F.lit(60.0), translation_accuracy=c("t"))
    return e.select("event_id", F.round(fidelity, 6).alias("fidelity"), L.lite_stance(c("stance"), c("k")).alias("stance"), PO.queue_of(c("depth")).alias("queue"), F.round(X.clamp(c("value") / 100), 6).alias("unit"))


QUOTE_SCORES = f"""WITH e AS (SELECT event_id, value, (event_id % 101)::DOUBLE AS w, CASE WHEN event_id % 2 = 0 THEN (event_id % 50)::DOUBLE END AS t, {_STANCE} AS s, (event_id % 11)::DOUBLE / 10 AS k FROM events)
SELECT event_id, round((0.35::DOUBLE * w + 0.20::DOUBLE * w / 2 + 0.20::DOUBLE * 80 + 0.15::DOUBLE * 60 + coalesce(0.10::DOUBLE * t, 0)) / CASE WHEN t IS NULL THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END, 6) AS fidelity,
CASE WHEN s IN ('supports', 'contradicts') THEN CASE WHEN k >= 0.75 THEN 'strongly_' ELSE 'partially_' END || s ELSE 'neutral' END AS stance, CASE event_id % 4 WHEN 0 THEN 'verification.quick' WHEN 1 THEN 'verification.standard' ELSE 'verification.deep' END AS queue, round(greatest(0, least(1, value / 100)), 6) AS unit FROM e"""


QUERIES = {f.__name__: f for f in (rejection_gates, citation_penalties, preflight_plan, mixed_selection, context_selection, batch_sums, run_counts, seen_sources, quote_scores)}
ORACLES = {
    "rejection_gates": REJECTION_GATES, "citation_penalties": CITATION_PENALTIES, "preflight_plan": PREFLIGHT_PLAN, "mixed_selection": MIXED_SELECTION, "context_selection": CONTEXT_SELECTION,
    "batch_sums": BATCH_SUMS, "run_counts": RUN_COUNTS, "seen_sources": SEEN_SOURCES, "quote_scores": QUOTE_SCORES,
}
