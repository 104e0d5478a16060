"""Registered queries over records of runs: fetches, payloads, errors, uploads, intake, graphs, batches; with their SQL.

Inputs are derived from the test tables by expressions that both dialects read alike, so that every branch of a rule occurs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import html as H
from ..operators import policy as PO
from ..operators import provenance as P
from ..operators import retrieval as R
from ..operators import runs as RU
from ..session import table
from ..sources import corpus as C


def _case(x: str, values: list[str]) -> str:
    """CASE over x = 0, 1, ...; the last value for all others."""
    return f"CASE {x} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


_STAGE = _case("event_id % 12", [f"'{s}'" for s in RU.COMPLETED_STEPS])
_PAYLOAD = _case("event_id % 5", ["""'{"completed_steps": 4, "source_counts": {"web": 2, "pdf": 1}}'""", "'{}'", "'{oops'", """'{"total_steps": 13, "inaccessible_count": 2}'""", "NULL"])
_MESSAGE = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END"


def public_events(spark, d):
    """P10, AJ6: events as the public sees them."""
    e = table(spark, d, "events").selectExpr("user_id AS run_id", "event_id AS sequence", f"{_STAGE} AS stage", f"{_MESSAGE} AS message", f"{_PAYLOAD} AS payload", "CASE WHEN event_id % 2 = 0 THEN 'run.stage' END AS event_type", "ts AS created_at")
    return RU.public_events(e).select("run_id", "sequence", "stage", "message", "completed_steps", "total_steps", "inaccessible_count", F.size("source_counts").alias("counts"), F.coalesce(F.try_element_at("source_counts", F.lit("web")), F.lit(0)).alias("web"), "event_type")


_STEPS = " ".join(f"WHEN '{s}' THEN {n}" for s, n in RU.COMPLETED_STEPS.items())
PUBLIC_EVENTS = f"""WITH e AS (SELECT user_id AS run_id, event_id AS sequence, {_STAGE} AS stage, {_MESSAGE} AS message, event_id % 5 AS p, event_id FROM events)
SELECT run_id, sequence, stage, coalesce(message, 'Research progress updated.') AS message, CASE WHEN p = 0 THEN 4 ELSE CASE stage {_STEPS} END END AS completed_steps, CASE WHEN p = 3 THEN 13 ELSE 9 END AS total_steps,
CASE WHEN p = 3 THEN 2 ELSE 0 END AS inaccessible_count, CASE WHEN p = 0 THEN 2 ELSE 0 END AS counts, CASE WHEN p = 0 THEN 2 ELSE 0 END AS web, CASE WHEN event_id % 2 = 0 THEN 'run.stage' ELSE 'run.progress' END AS event_type FROM e"""

_KEYED = _case("doc_id % 8", [
    """'{"note": "fine"}'""", """'{"a": [{"Raw-Prompt": 1}]}'""", """'{"note": "the \\\\"prompt\\\\": is quoted"}'""", """'{"internal_reasoning" : null}'""",
    """'{"a": {"b": [1, {" thinking ": 2}]}}'""", """'{"api_key": 1, "prompts": 2}'""", """'{"raw_provider_response": {}}'""", """'{"message": "analysis"}'""",
])
_KEYED_SPARK = _KEYED.replace("\\\\", "\\\\\\\\")


def private_payloads(spark, d):
    """event payloads that hold a private key at any depth."""
    e = table(spark, d, "documents").selectExpr("doc_id", f"{_KEYED_SPARK} AS payload")
    return e.select("doc_id", RU.is_private_payload(F.col("payload")).alias("private"))


PRIVATE_PAYLOADS = "SELECT doc_id, doc_id % 8 IN (1, 3, 4, 6) AS private FROM documents"

_STATUS = _case("page_id % 5", ["'PAYWALLED'", "'BOT_BLOCKED'", "'UNSUPPORTED'", "'INACCESSIBLE'", "'INACCESSIBLE'"])


def failure_reasons(spark, d):
    """Codes and public texts of failed fetches."""
    p = table(spark, d, "pages").selectExpr("page_id", f"{_STATUS} AS status", "page_id % 2 = 0 AS submitted", "page_id % 3 = 0 AS retryable")
    code, reason = RU.failure_reason(F.col("status"), F.col("submitted"), F.col("retryable"))
    return p.select("page_id", code.alias("code"), reason.alias("reason"))


FAILURE_REASONS = f"""WITH p AS (SELECT page_id, {_STATUS} AS s, page_id % 2 = 0 AS own, page_id % 3 = 0 AS again FROM pages)
SELECT page_id, CASE WHEN own THEN 'SUBMITTED_URL_' ELSE 'SOURCE_' END || s AS code, CASE WHEN own THEN 'The submitted URL ' ELSE 'The evidence source ' END || CASE WHEN s = 'PAYWALLED' THEN 'is paywalled or requires authentication.' WHEN s = 'BOT_BLOCKED' THEN 'denied automated retrieval.'
WHEN s = 'UNSUPPORTED' THEN 'returned unsupported content.' WHEN again THEN 'was temporarily unavailable.' ELSE 'could not be accessed safely.' END AS reason FROM p"""

_CODE = _case("page_id % 9", ["401", "403", "402", "404", "500", "301", "200", "200", "200"])
_TYPE = _case("page_id % 7", ["'text/html; charset=utf-8'", "'Application/XHTML+xml'", "'application/pdf'", "'image/png'", "'text/plain'", "NULL", "'text/html'"])
_LENGTH = _case("page_id % 11", ["'12'", "'-1'", "'many'", "'6000000'", "''", "NULL"])
_BODY = _case("page_id % 13", ["'%PDF-1.7'", "'MZ' || html", "'#!' || html", "html || chr(0)", "html"])


def fetch_status(spark, d):
    """Access status of fetched pages from code, type, declared length and body."""
    p = table(spark, d, "pages").selectExpr("page_id", f"{_CODE} AS code", f"{_TYPE} AS type", f"{_LENGTH} AS declared", f"cast({_BODY} AS binary) AS body")
    return p.select("page_id", H.access_status(F.col("code"), F.col("type"), F.col("body"), F.col("declared")).alias("status"))


FETCH_STATUS = f"""WITH p AS (SELECT page_id, {_CODE} AS code, lower(trim(split_part({_TYPE}, ';', 1))) AS type, {_LENGTH} AS declared, {_BODY} AS body FROM pages)
SELECT page_id, CASE WHEN code = 403 THEN 'BOT_BLOCKED' WHEN code IN (401, 402) THEN 'PAYWALLED' WHEN code >= 400 THEN 'INACCESSIBLE' WHEN type IS NULL OR type NOT IN ('text/html', 'application/xhtml+xml', 'text/plain', 'application/pdf') THEN 'UNSUPPORTED'
WHEN declared IN ('-1', 'many') OR (declared = '6000000' AND type <> 'application/pdf') OR strlen(body) > CASE WHEN type = 'application/pdf' THEN 25000000 ELSE 5000000 END THEN 'UNSUPPORTED'
WHEN type <> 'application/pdf' AND contains(hex(encode(body))[:8192], '00') AND regexp_matches(hex(encode(body))[:8192], '^(..)*?00') THEN 'UNSUPPORTED' WHEN type = 'application/pdf' AND body[:5] <> '%PDF-' THEN 'UNSUPPORTED' WHEN body[:2] IN ('MZ', '#!') THEN 'UNSUPPORTED' ELSE 'FETCHED' END AS status FROM p"""

_ERROR = _case("event_id % 6", [*[f"'{c}'" for c in RU.DETERMINISTIC_CODES], "'PROVIDER_TIMEOUT'", "NULL"])
_DETAIL = _case("event_id % 4", ["'PROVIDER_BODY_PARSE_EXHAUSTED'", "'STRUCTURED_RESPONSE_INVALID'", "'RATE_LIMITED'", "NULL"])


def retryable_errors(spark, d):
    """whether failed events may be tried again; what an owner may do with a run of that stage."""
    e = table(spark, d, "events").selectExpr("event_id", f"{_ERROR} AS code", f"{_DETAIL} AS detail", "event_id % 7 <> 0 AS retryable", "event_id % 8 = 0 AS exhausted", f"{_STAGE} AS stage", "CASE WHEN event_id % 5 = 0 THEN ts END AS hold")
    return e.select(
        "event_id", RU.is_retryable(F.col("code"), F.col("retryable"), F.col("detail"), F.col("exhausted")).alias("retryable"), RU.can_retry(F.col("stage")).alias("can_retry"),
        RU.can_save(F.col("stage")).alias("can_save"), RU.can_delete(F.col("stage"), F.col("hold"), F.lit("2024-01-15").cast("timestamp")).alias("can_delete"),
    )


RETRYABLE_ERRORS = f"""WITH e AS (SELECT event_id, {_ERROR} AS code, {_DETAIL} AS detail, event_id % 7 <> 0 AS again, event_id % 8 = 0 AS spent, {_STAGE} AS stage, CASE WHEN event_id % 5 = 0 THEN ts END AS hold FROM events)
SELECT event_id, again AND coalesce(code = 'PROVIDER_TIMEOUT', true) AND coalesce(detail <> 'STRUCTURED_RESPONSE_INVALID', true) AND NOT coalesce(detail = 'PROVIDER_BODY_PARSE_EXHAUSTED' AND spent, false) AS retryable, stage IN ('FAILED', 'CANCELLED') AS can_retry, stage = 'COMPLETED' AS can_save,
stage IN ('COMPLETED', 'FAILED', 'CANCELLED') AND coalesce(hold <= TIMESTAMP '2024-01-15', true) AS can_delete FROM e"""

_NAME = _case("doc_id % 9", ["'a.txt'", "'b.PDF'", "'dir/c.txt'", "''", "'d.txt' || chr(9)", "'e.html'", "'f.tar.txt'", "NULL", "'g.txt'"])
_KIND = _case("doc_id % 4", ["'text/plain'", "'Text/Plain; charset=utf-8'", "'application/pdf'", "'text/plain'"])
_UP = _case("doc_id % 7", ["''", "'%PDF-' || text", "'PK' || chr(3) || chr(4) || text", "text || chr(7)", "text"])


def upload_checks(spark, d):
    """why uploads are refused."""
    u = table(spark, d, "documents").selectExpr("doc_id", f"{_NAME} AS name", f"{_KIND} AS kind", f"cast({_UP} AS binary) AS body")
    return u.select("doc_id", C.upload_error(F.col("name"), F.col("kind"), F.col("body"), 8000).alias("error"))


UPLOAD_CHECKS = f"""WITH u AS (SELECT doc_id, {_NAME} AS name, lower(split_part({_KIND}, ';', 1)) AS kind, {_UP} AS body FROM documents)
SELECT doc_id, CASE WHEN coalesce(name, '') = '' OR contains(name, '/') OR contains(name, chr(9)) THEN 'Upload filename is invalid' WHEN (kind = 'text/plain' AND NOT ends_with(lower(name), '.txt')) OR (kind = 'application/pdf' AND NOT ends_with(lower(name), '.pdf')) THEN 'Upload extension does not match its content type'
WHEN body = '' THEN 'Upload is empty' WHEN strlen(body) > 8000 THEN 'Upload exceeds the configured size limit' WHEN starts_with(body, 'PK' || chr(3) || chr(4)) THEN 'Executable or archive uploads are not supported' WHEN kind = 'application/pdf' AND NOT starts_with(body, '%PDF-') THEN 'PDF signature does not match its content type'
WHEN kind = 'text/plain' AND regexp_matches(body, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') THEN 'Binary control characters are not supported as text' END AS error FROM u"""

_EXPECTED = _case("doc_id % 5", ["'text'", "'article_url'", "'article_title'", "NULL"])
_GIVEN = _case("doc_id % 6", ["'text'", "'article_url'", "'article_title'", "'text'"])
_NORMAL = _case("doc_id % 7", ["' ' || chr(10)", "NULL", "text"])
_SENT = _case("doc_id % 11", ["'https://example.org/a'", "' HTTP://example.org '", "'ftp://example.org/a'", "'https://me:pw@example.org/'", "'no url'", "''", "text"])


def intake_checks(spark, d):
    """what is wrong with a submission."""
    s = table(spark, d, "documents").selectExpr("doc_id", f"{_EXPECTED} AS expected", f"{_GIVEN} AS kind", f"{_NORMAL} AS normal", f"{_SENT} AS sent")
    return s.select("doc_id", PO.intake_status(*[F.col(c) for c in ("expected", "kind", "normal", "sent")]).alias("status"))


INTAKE_CHECKS = f"""WITH s AS (SELECT doc_id, {_EXPECTED} AS expected, {_GIVEN} AS kind, {_NORMAL} AS normal, {_SENT} AS sent, doc_id % 11 AS u FROM documents)
SELECT doc_id, CASE WHEN expected <> kind THEN 'INPUT_TYPE_MISMATCH' WHEN trim(regexp_replace(coalesce(normal, ''), '\\s+', ' ', 'g')) = '' OR length(normal) > 100000 THEN 'INVALID_NORMALIZED_INPUT' WHEN kind = 'article_url' AND u NOT IN (0, 1) THEN 'INVALID_NORMALIZED_URL'
WHEN kind = 'article_title' AND (u = 5 OR length(trim(regexp_replace(sent, '\\s+', ' ', 'g'))) > 500) THEN 'INVALID_ARTICLE_TITLE' ELSE 'ACCEPTED' END AS status FROM s"""

_CLAIM = "SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS claim_no, 'Claim ' || l_partkey % 40 AS text, CASE WHEN l_suppkey % 3 = 0 THEN 'number ' || l_suppkey % 10 END AS span, l_partkey % 9 AS parent_code FROM lineitem"
_INPUT = "'text with number 1, number 3 and number 6'"


def _claim_tables(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("factloom_lineitem")
    claims = spark.sql(_CLAIM.replace("FROM lineitem", "FROM factloom_lineitem")).selectExpr("run_id", "cast(claim_no AS int) AS claim_no", "text", "span", "cast(CASE WHEN parent_code < 6 THEN parent_code END AS int) AS parent_no")
    runs = table(spark, d, "orders").selectExpr("o_orderkey AS run_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'QUICK' ELSE 'DEEP' END AS depth", f"{_INPUT} AS input_text")
    owners = claims.selectExpr("run_id", "parent_no + claim_no AS owner_no", "text").where("owner_no IS NOT NULL")
    return claims, runs, owners


def decomposition_checks(spark, d):
    """Violations of decompositions; orders stand for runs, lines for claims."""
    return PO.decomposition_violations(*_claim_tables(spark, d))


DECOMPOSITION_CHECKS = f"""WITH RECURSIVE c AS (SELECT run_id, claim_no, text, span, CASE WHEN parent_code < 6 THEN parent_code END AS parent_no, count(*) OVER (PARTITION BY run_id) AS n FROM ({_CLAIM})),
walk AS (SELECT run_id, claim_no, parent_no AS up, n, 1 AS steps FROM c UNION ALL SELECT w.run_id, w.claim_no, c.parent_no, w.n, steps + 1 FROM walk w JOIN c ON c.run_id = w.run_id AND c.claim_no = w.up WHERE steps <= w.n),
codes AS (SELECT run_id, 'DECOMPOSITION_CLAIM_LIMIT_EXCEEDED' AS code, greatest(max(n) - CASE WHEN run_id % 2 = 0 THEN 12 ELSE 50 END, 0) AS n FROM c GROUP BY 1 UNION ALL
SELECT run_id, 'DECOMPOSITION_DUPLICATE_CLAIM', count(*) - count(DISTINCT text) FROM c GROUP BY 1 UNION ALL SELECT run_id, 'DECOMPOSITION_INVALID_ORIGINAL_TEXT_SPAN', count(*) FILTER (NOT contains({_INPUT}, span)) FROM c GROUP BY 1 UNION ALL
SELECT run_id, 'DECOMPOSITION_PARENT_INDEX_INVALID', count(*) FILTER (parent_no >= n) FROM c GROUP BY 1 UNION ALL SELECT run_id, 'DECOMPOSITION_CLAIM_CYCLE', count(DISTINCT claim_no) FROM walk WHERE steps = n + 1 AND up IS NOT NULL GROUP BY 1 UNION ALL
SELECT run_id, 'DECOMPOSITION_AMBIGUITY_OWNER_INDEX_INVALID', count(*) FILTER (parent_no + claim_no >= n) FROM c GROUP BY 1) SELECT run_id, code, CAST(n AS BIGINT) AS n FROM codes WHERE n > 0"""


def claim_references(spark, d):
    """Stable references of claims, and those of their parents."""
    claims, _, _ = _claim_tables(spark, d)
    return PO.assigned_refs(claims.withColumn("span", F.coalesce("span", F.lit(""))), ["text", "span"]).select("run_id", "claim_no", "claim_ref", "parent_claim_ref")


CLAIM_REFERENCES = f"""WITH c AS (SELECT run_id, claim_no, CASE WHEN parent_code < 6 THEN parent_code END AS parent_no, 'claim-' || (claim_no + 1) || '-' || sha256('{{"span":"' || coalesce(lower(span), '') || '","text":"' || lower(text) || '"}}')[:16] AS ref FROM ({_CLAIM}))
SELECT c.run_id, CAST(c.claim_no AS INTEGER) AS claim_no, c.ref AS claim_ref, p.ref AS parent_claim_ref FROM c LEFT JOIN c p ON p.run_id = c.run_id AND p.claim_no = c.parent_no"""

_DATE = "CASE WHEN doc_id % 10 = 0 THEN NULL ELSE date '2020-01-01' + CAST(doc_id % 900 AS INTEGER) END"


def match_chunks(spark, d):
    """T2, F2, F4, J6, AJ4, DT7: the 24 nearest chunks of public documents of one corpus and two languages in a range of dates."""
    e = table(spark, d, "embeddings")
    q = V.constant(e.where("vec_id = 2").first()["embedding"])
    docs = table(spark, d, "documents").selectExpr("doc_id AS document_id", "CASE WHEN doc_id % 11 = 0 THEN 'internal' ELSE 'public' END AS visibility", "CASE WHEN doc_id % 3 = 0 THEN 'v2' ELSE 'v1' END AS corpus_version", f"{_DATE} AS document_date", "lang AS language")
    chunks = e.selectExpr("vec_id AS chunk_id", "vec_id AS document_id", "vec_id % 5 AS chunk_index", "embedding")
    hit = R.match_chunks(chunks, docs, q, 24, 0.01, "v1", since="2020-02-01", until="2022-01-31", language="en")
    return hit.select("chunk_id", F.round("similarity", 6).alias("similarity"), F.col("document_date").cast("string").alias("document_date"))


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
MATCH_CHUNKS = f"""WITH s AS (SELECT e.vec_id AS chunk_id, e.vec_id % 5 AS chunk_index, {_COS} AS s, {_DATE} AS dd FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 2) q, documents WHERE doc_id = e.vec_id AND doc_id % 11 <> 0 AND doc_id % 3 <> 0 AND lang = 'en')
SELECT chunk_id, round(s, 6) AS similarity, CAST(dd AS VARCHAR) AS document_date FROM s WHERE s >= 0.01 AND dd BETWEEN DATE '2020-02-01' AND DATE '2022-01-31' ORDER BY s DESC, dd DESC NULLS LAST, chunk_index LIMIT 24"""


def lexical_candidates(spark, d):
    """documents whose text or source holds one of three terms."""
    return R.lexical_candidates(table(spark, d, "documents"), ["thston", "SRC3", "eau."], label="source").select("doc_id")


LEXICAL_CANDIDATES = "SELECT doc_id FROM documents WHERE contains(lower(text), 'thston') OR contains(lower(text), 'src3') OR contains(lower(text), 'eau.') OR contains(lower(source), 'src3')"


def _lines(spark, d):
    """Lines as passages (their place in the order, part and supplier), parts as snapshots, suppliers as sources, orders as runs."""
    li = table(spark, d, "lineitem")
    passages = li.selectExpr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS passage_id", "l_suppkey AS source_id", "l_partkey AS snapshot_id", "l_orderkey AS order_id", "l_linenumber AS line_no")
    return li, passages.distinct()


def run_joins(spark, d):
    """For each supplier its passages in the runs that list it, details, claims and citations that passed."""
    li, passages = _lines(spark, d)
    listed = li.where("l_linenumber = 1").selectExpr("l_orderkey AS run_id", "l_suppkey AS source_id", "l_partkey AS snapshot_id").distinct()
    sources = table(spark, d, "supplier").selectExpr("s_suppkey AS source_id", "s_nationkey AS nation")
    snapshots = table(spark, d, "part").where("p_size > 20").selectExpr("p_partkey AS snapshot_id", "p_size AS size")
    in_runs = RU.run_passages(passages, listed).groupBy("source_id").agg(F.count(F.lit(1)).alias("passages"))
    details = RU.run_source_details(listed, sources, snapshots).groupBy("source_id").agg(F.count("size").alias("with_snapshot"), F.count(F.lit(1)).alias("listed"))
    evidence = passages.where("line_no < 4").selectExpr("passage_id", "concat(order_id, '/', line_no) AS claim_id")
    claims = evidence.selectExpr("claim_id", "cast(split_part(claim_id, '/', 1) AS bigint) % 100 AS run_id").distinct()
    backed = RU.claims_by_source(passages, evidence, claims).groupBy("source_id").agg(F.sum(F.size("claim_ids")).alias("claims"))
    rows = RU.evidence_details(evidence, passages, sources).groupBy("source_id").agg(F.count(F.lit(1)).alias("evidence"))
    citations = passages.selectExpr("passage_id", "CASE WHEN order_id % 50 = 0 THEN 'passed' ELSE 'failed' END AS audit_status")
    cited = RU.cited_sources(sources, passages, citations).select("source_id", F.lit(True).alias("cited"))
    out = sources.select("source_id")
    for part in (in_runs, details, backed, rows, cited):
        out = out.join(part, "source_id", "left")
    return out.fillna(0).fillna(False)


RUN_JOINS = """WITH p AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_partkey AS k, l_suppkey AS s FROM lineitem), l AS (SELECT DISTINCT l_orderkey AS run_id, l_suppkey AS s, l_partkey AS k FROM lineitem WHERE l_linenumber = 1),
a AS (SELECT p.s, count(*) AS passages FROM p JOIN l ON l.s = p.s AND l.k = p.k GROUP BY 1), b AS (SELECT l.s, count(p_size) FILTER (p_size > 20) AS with_snapshot, count(*) AS listed FROM l LEFT JOIN part ON p_partkey = k GROUP BY 1),
c AS (SELECT s, sum(n) AS claims FROM (SELECT s, o % 100 AS r, count(DISTINCT o || '/' || n) AS n FROM p WHERE n < 4 GROUP BY 1, 2) GROUP BY 1), e AS (SELECT s, count(*) AS evidence FROM p WHERE n < 4 GROUP BY 1), f AS (SELECT DISTINCT s FROM p WHERE o % 50 = 0)
SELECT s_suppkey AS source_id, coalesce(passages, 0) AS passages, coalesce(with_snapshot, 0) AS with_snapshot, coalesce(listed, 0) AS listed, CAST(coalesce(claims, 0) AS BIGINT) AS claims, coalesce(evidence, 0) AS evidence, f.s IS NOT NULL AS cited
FROM supplier LEFT JOIN a ON a.s = s_suppkey LEFT JOIN b ON b.s = s_suppkey LEFT JOIN c ON c.s = s_suppkey LEFT JOIN e ON e.s = s_suppkey LEFT JOIN f ON f.s = s_suppkey"""


def source_graph(spark, d):
    """The visible part of the graph of suppliers (sources) and nations (clusters)."""
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS source_id", "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS title", "concat('http://s/', s_suppkey) AS url", "CASE WHEN s_suppkey % 7 > 0 THEN s_nationkey END AS cluster_id")
    e = table(spark, d, "lineitem").selectExpr("l_suppkey AS parent", "l_partkey % 50 + 1 AS child", "CASE WHEN l_tax > 0.04 THEN 'QUOTES' ELSE 'CITES' END AS relationship", "0.9D AS confidence").where("parent < 60").distinct()
    nodes, edges = RU.graph(s, e, table(spark, d, "nation").selectExpr("n_nationkey AS cluster_id", "n_name AS origin_type"))
    nodes, edges = RU.graph_view(nodes, edges, (F.col("kind") == "cluster") | (F.coalesce("place", F.lit(0)) < 3))
    n = nodes.selectExpr("kind", "node_id AS first", "label AS second", "cast(place AS int) AS place")
    return n.unionByName(edges.selectExpr("kind", "`from` AS first", "`to` AS second", "cast(NULL AS int) AS place"))


SOURCE_GRAPH = """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'http://s/' || s_suppkey ELSE s_name END AS label, CASE WHEN s_suppkey % 7 > 0 THEN s_nationkey END AS c FROM supplier),
r AS MATERIALIZED (SELECT s.k, s.label, s.c, (SELECT count(*) FROM s b WHERE b.k < s.k AND b.c IS NOT DISTINCT FROM s.c) AS place FROM s), v AS (SELECT * FROM r WHERE place < 3), e AS (SELECT DISTINCT l_suppkey AS p, l_partkey % 50 + 1 AS c, CASE WHEN l_tax > 0.04 THEN 'QUOTES' ELSE 'CITES' END AS kind FROM lineitem WHERE l_suppkey < 60)
SELECT 'source' AS kind, 'source:' || k AS "first", label AS "second", CAST(place AS INTEGER) AS place FROM v UNION ALL SELECT 'cluster', 'cluster:' || n_nationkey, n_name, NULL FROM nation UNION ALL
SELECT kind, 'source:' || p, 'source:' || e.c, NULL FROM e WHERE p IN (SELECT k FROM v) AND e.c IN (SELECT k FROM v) UNION ALL SELECT 'MEMBER_OF', 'source:' || k, 'cluster:' || v.c, NULL FROM v JOIN nation ON n_nationkey = v.c"""


def completion_checks(spark, d):
    """Orders as runs: ready to complete, and held for allegations."""
    runs = table(spark, d, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 9 > 0 THEN o_orderpriority END AS title", "o_orderstatus AS verdict", "o_orderdate AS evidence_reviewed_at")
    cites = table(spark, d, "lineitem").selectExpr("l_orderkey AS run_id", "CASE WHEN l_discount < 0.1 THEN 'passed' WHEN l_tax < 0.04 THEN 'partial' ELSE 'failed' END AS audit_status")
    expected = table(spark, d, "orders").selectExpr("o_orderkey AS run_id", "CASE WHEN o_orderkey % 4 = 0 THEN 3 ELSE 0 END AS extra").join(cites.groupBy("run_id").count(), "run_id", "left").selectExpr("run_id", "coalesce(count, 0) + extra AS expected")
    held = RU.held_for_review(table(spark, d, "lineitem").selectExpr("l_orderkey AS run_id", "CASE WHEN l_returnflag = 'R' THEN 'Allegation' ELSE 'fact' END AS claim_type"))
    gate = RU.completion_gate(runs, cites, expected).select("id", "ready")
    return gate.join(held.withColumnRenamed("run_id", "id"), "id", "left").fillna(0)


COMPLETION_CHECKS = """WITH c AS (SELECT l_orderkey AS k, count(*) AS n, bool_and(l_discount < 0.1 OR l_tax < 0.04) AS good, count(*) FILTER (l_returnflag = 'R') AS a FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, o_orderkey % 9 > 0 AND o_orderkey % 4 <> 0 AND coalesce(n > 0 AND good, false) AS ready, coalesce(a, 0) AS allegations FROM orders LEFT JOIN c ON k = o_orderkey"""


def provenance_checks(spark, d):
    """Violations of an edge table, by code; and the neighbours of one node."""
    nodes = table(spark, d, "supplier").selectExpr("'r' AS run", "cast(s_suppkey AS string) AS ref")
    edges = table(spark, d, "lineitem").selectExpr("'r' AS run", "cast(l_suppkey AS string) AS parent", "cast(l_partkey AS string) AS child", "CASE WHEN l_tax > 0.04 THEN 'QUOTES' ELSE 'CITES' END AS relationship")
    mult = nodes.selectExpr("ref", "CASE WHEN ref = '3' THEN 0.5D ELSE 0.35D END AS multiplier")
    near = P.neighbourhood(edges, "7").selectExpr("concat('NEIGHBOUR ', neighbour) AS code").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return P.provenance_violations(nodes, edges, mult, ["run"]).unionByName(near)


PROVENANCE_CHECKS = """WITH e AS (SELECT l_suppkey AS p, l_partkey AS c, l_tax > 0.04 AS k FROM lineitem) SELECT * FROM (
SELECT 'UNKNOWN_ENDPOINT' AS code, count(*) FILTER (p NOT IN (SELECT s_suppkey FROM supplier)) + count(*) FILTER (c NOT IN (SELECT s_suppkey FROM supplier)) AS n FROM e UNION ALL SELECT 'SELF_EDGE', count(*) FILTER (p = c) FROM e UNION ALL
SELECT 'DUPLICATE_EDGE', count(*) FROM (SELECT 1 FROM e GROUP BY p, c, k HAVING count(*) > 1) UNION ALL SELECT 'UNKNOWN_MULTIPLIER', count(*) FROM supplier WHERE s_suppkey = 3 UNION ALL
SELECT 'NEIGHBOUR ' || CASE WHEN p = 7 THEN c ELSE p END, count(*) FROM e WHERE p = 7 OR c = 7 GROUP BY 1) WHERE n > 0"""


def claim_views(spark, d):
    """Claims with a label and a text, and whether a source of their objectives could not be read."""
    claims = table(spark, d, "orders").selectExpr("o_custkey % 20 AS run_id", "cast(o_orderkey AS string) AS claim_ref", "concat(o_orderpriority, ' ', o_orderstatus) AS text", "CASE WHEN o_orderstatus = 'F' THEN 'Supported' ELSE 'Mixed' END AS final_label")
    objectives = claims.selectExpr("run_id", "concat('o', claim_ref) AS objective_ref", "claim_ref")
    found = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("o_custkey % 20 AS run_id", "l_suppkey AS source_ref", "concat('o', l_orderkey) AS o")
    candidates = found.groupBy("run_id", "source_ref").agg(F.collect_set("o").alias("objective_refs"))
    snapshots = candidates.selectExpr("run_id", "source_ref", "CASE WHEN source_ref % 40 = 1 THEN 'PAYWALLED' ELSE 'FETCHED' END AS access_status")
    return PO.with_inaccessible(PO.visible_claims(claims, "Supported", "URGENT"), objectives, candidates, snapshots).select("claim_ref", "text", "inaccessible")


CLAIM_VIEWS = """SELECT CAST(o_orderkey AS VARCHAR) AS claim_ref, o_orderpriority || ' ' || o_orderstatus AS text, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 40 = 1) AS inaccessible FROM orders
WHERE o_orderstatus = 'F' AND contains(lower(o_orderpriority || ' ' || o_orderstatus), 'urgent')"""


def classification_tasks(spark, d):
    """P11, AJ8, S31: batches of classification tasks of each run, as JSON."""
    claims = table(spark, d, "orders").selectExpr("o_custkey AS run_id", "cast(o_orderkey AS string) AS claim_ref", "o_orderpriority AS claim_text")
    passages = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    passages = passages.selectExpr("o_custkey AS run_id", "cast(l_orderkey AS string) AS claim_ref", "l_linenumber AS rank", "concat_ws('-', l_partkey, l_suppkey) AS passage_id", "l_returnflag AS text").distinct()
    b = PO.classification_batches(claims, passages, 8)
    return b.select("run_id", F.col("batch").cast("int").alias("batch"), "tasks", F.sha2("payload", 256).alias("payload_sha256"))


CLASSIFICATION_TASKS = """WITH p AS (SELECT DISTINCT o_custkey AS run_id, CAST(l_orderkey AS VARCHAR) AS claim_ref, o_orderpriority AS claim_text, l_linenumber AS rank, l_partkey || '-' || l_suppkey AS passage_id, l_returnflag AS text FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY claim_ref, rank, passage_id, text) AS n, '{"task_ref":"classification-' || sha256(claim_ref || chr(31) || passage_id)[:24] || '","claim_ref":"' || claim_ref || '","claim_text":"' || claim_text || '","passage_id":"' || passage_id || '","text":"' || text || '"}' AS task FROM p)
SELECT run_id, CAST((n - 1) // 8 AS INTEGER) AS batch, count(*) AS tasks, sha256('[' || string_agg(task, ',' ORDER BY n) || ']') AS payload_sha256 FROM n GROUP BY 1, 2"""


QUERIES = {f.__name__: f for f in (public_events, private_payloads, failure_reasons, fetch_status, retryable_errors, upload_checks, intake_checks, decomposition_checks, claim_references, match_chunks, lexical_candidates, run_joins, source_graph, completion_checks, provenance_checks, claim_views, classification_tasks)}
ORACLES = {
    "public_events": PUBLIC_EVENTS, "private_payloads": PRIVATE_PAYLOADS, "failure_reasons": FAILURE_REASONS, "fetch_status": FETCH_STATUS, "retryable_errors": RETRYABLE_ERRORS, "upload_checks": UPLOAD_CHECKS,
    "intake_checks": INTAKE_CHECKS, "decomposition_checks": DECOMPOSITION_CHECKS, "claim_references": CLAIM_REFERENCES, "match_chunks": MATCH_CHUNKS, "lexical_candidates": LEXICAL_CANDIDATES, "run_joins": RUN_JOINS,
    "source_graph": SOURCE_GRAPH, "completion_checks": COMPLETION_CHECKS, "provenance_checks": PROVENANCE_CHECKS, "claim_views": CLAIM_VIEWS, "classification_tasks": CLASSIFICATION_TASKS,
}
