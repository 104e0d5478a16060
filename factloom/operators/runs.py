"""Reads over run tables: history, report, sources, graph, authorization, retention, metrics (F1, F9, F10, F14 to F17, F24, F25,
J1 to J8, P1 to P14, A17 to A25, T1, T13, W5, W11, W12, U7, M23, DT4)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X

STATUS_ORDER = ["QUEUED", "VALIDATING", "DECOMPOSING", "RESEARCHING", "EXTRACTING", "ANALYZING_PROVENANCE", "SCORING", "SYNTHESIZING", "AUDITING", "COMPLETED"]
TERMINAL = ["COMPLETED", "FAILED", "CANCELLED"]
#: Keys that no public event may hold.
PRIVATE_KEYS = [
    "analysis", "chain_of_thought", "internal_reasoning", "private_reasoning", "prompt", "raw_model_output", "raw_prompt", "raw_provider_response", "raw_response",
    "reasoning", "reasoning_trace", "thinking", "thoughts",
]
#: Steps done when a status is reached, of so many.
COMPLETED_STEPS = {
    "QUEUED": 0, "VALIDATING": 0, "DECOMPOSING": 1, "RESEARCHING": 2, "EXTRACTING": 3, "ANALYZING_PROVENANCE": 5, "SCORING": 6, "SYNTHESIZING": 7, "AUDITING": 8, "COMPLETED": 9,
    "FAILED": 0, "CANCELLED": 0,
}
TOTAL_STEPS = 9
#: Codes of failures that come again however often one retries.
DETERMINISTIC_CODES = ["AGENT_CONTRACT_REPAIR_EXHAUSTED", "STRUCTURED_RESPONSE_INVALID", "STRUCTURED_RESPONSE_REPAIR_EXHAUSTED", "STRUCTURED_SCHEMA_REPAIR_EXHAUSTED"]
#: Public reasons by access status, of submitted URLs and of evidence sources.
SUBMITTED_REASONS = {
    "PAYWALLED": "The submitted URL is paywalled or requires authentication.",
    "BOT_BLOCKED": "The submitted URL denied automated retrieval.",
    "UNSUPPORTED": "The submitted URL returned unsupported content.",
    "RETRYABLE": "The submitted URL was temporarily unavailable.",
    "OTHER": "The submitted URL could not be accessed safely.",
}
SOURCE_REASONS = {
    "PAYWALLED": "The evidence source is paywalled or requires authentication.",
    "BOT_BLOCKED": "The evidence source denied automated retrieval.",
    "UNSUPPORTED": "The evidence source returned unsupported content.",
    "RETRYABLE": "The evidence source was temporarily unavailable.",
    "OTHER": "The evidence source could not be accessed safely.",
}


def ilike_any(pattern: str, *columns: Column) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c.ilike(f"%{pattern.strip()}%"), F.lit(False))
    return out


def history_filter(runs: DataFrame, owner, query: str | None = None, status: str | None = None, depth: str | None = None, verdict: str | None = None, saved: bool = False, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """what is given filters; `%` and `_` in a query stay wildcards."""
    df = runs.where((F.col("user_id") == owner) & F.col("deleted_at").isNull())
    if query:
        df = df.where(ilike_any(query, *[F.col(c) for c in ("title", "submitted_text", "submitted_url", "verdict")]))
    for column, value in (("status", status), ("research_depth", depth)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if verdict:
        df = df.where(ilike_any(verdict, F.col("verdict")))
    if saved:
        df = df.where(F.col("saved_at").isNotNull())
    if since is not None:
        df = df.where(F.col("created_at") >= F.lit(since))
    if until is not None:
        df = df.where(F.col("created_at") <= F.lit(until))
    return df


SORTS = {"date_asc": ("created_at", True), "oldest": ("created_at", True), "confidence_asc": ("verdict_confidence", True), "confidence_desc": ("verdict_confidence", False), "confidence": ("verdict_confidence", False)}


def page(df: DataFrame, sort: str = "date_desc", number: int = 1, size: int = 20, key: str = "id") -> DataFrame:
    """Sorted, nulls last, ties by id; one page."""
    column, up = SORTS.get(sort, ("created_at", False))
    c = F.col(column)
    return df.orderBy(c.asc_nulls_last() if up else c.desc_nulls_last(), key).offset((number - 1) * size).limit(size)


def preview(c: Column, most: int = 240) -> Column:
    """P1."""
    return F.nullif(F.substring(F.coalesce(c, F.lit("")), 1, most), F.lit(""))


def history(runs: DataFrame, owner, sort: str = "date_desc", number: int = 1, size: int = 20, **filters) -> DataFrame:
    rows = page(history_filter(runs, owner, **filters), sort, number, size)
    return rows.select("id", "status", "input_type", "research_depth", "title", preview(F.col("submitted_text")).alias("preview"), "verdict", "verdict_confidence", "evidence_reviewed_at", "created_at", "updated_at", "saved_at")


def run_passages(passages: DataFrame, run_sources: DataFrame) -> DataFrame:
    """J1."""
    return passages.join(run_sources, ["source_id", "snapshot_id"])


def run_source_details(run_sources: DataFrame, sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """J2."""
    return run_sources.join(sources, "source_id").join(snapshots, "snapshot_id", "left")


def evidence_details(evidence: DataFrame, passages: DataFrame, sources: DataFrame) -> DataFrame:
    """J3."""
    return evidence.join(passages, "passage_id").join(sources, "source_id")


def claims_by_source(passages: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """J4."""
    j = evidence.join(passages.select("passage_id", "source_id"), "passage_id").join(claims.select("claim_id", "run_id"), "claim_id")
    return j.groupBy("run_id", "source_id").agg(F.array_sort(F.collect_set("claim_id")).alias("claim_ids"))


def cited_sources(sources: DataFrame, passages: DataFrame, citations: DataFrame) -> DataFrame:
    """Sources with a citation that passed its audit."""
    cited = passages.join(citations.where("audit_status = 'passed'"), "passage_id", "left_semi")
    return sources.join(cited, "source_id", "left_semi")


def orphans(snapshots: DataFrame, references: DataFrame, completed: DataFrame, cutoff: Column, key: str = "snapshot_id") -> DataFrame:
    """J7, DT4: old rows that neither a completed run nor any run refers to."""
    return snapshots.where(F.col("retrieved_at") < cutoff).join(completed, key, "left_anti").join(references, key, "left_anti")


def expired_uploads(uploads: DataFrame, now: Column) -> DataFrame:
    """F17."""
    return uploads.where(F.col("run_id").isNull() & F.col("deleted_at").isNull() & (F.col("expires_at") < now))


def authorized(runs: DataFrame, shares: DataFrame, viewer, now: Column, scopes: list[str]) -> DataFrame:
    """Runs that the viewer owns, has a live share of, or that are public demos."""
    live = shares.where((F.col("viewer_id") == viewer) & (F.col("expires_at") > now) & F.col("scope").isin(scopes) & F.col("revoked_at").isNull()).select(F.col("run_id").alias("id"), F.lit(True).alias("shared")).distinct()
    return runs.join(live, "id", "left").where((F.col("user_id") == viewer) | F.coalesce("shared", F.lit(False)) | is_demo()).drop("shared")


def is_demo() -> Column:
    """F25."""
    return (F.col("visibility") == "public_demo") & (F.col("status") == "COMPLETED") & F.col("evidence_reviewed_at").isNotNull() & F.col("deleted_at").isNull()


def demo_runs(runs: DataFrame, limit: int = 12) -> DataFrame:
    """The demo runs reviewed last."""
    return runs.where(is_demo()).orderBy(F.col("evidence_reviewed_at").desc(), "id").limit(limit)


def can_retry(status: Column) -> Column:
    """F25."""
    return status.isin("FAILED", "CANCELLED")


def can_save(status: Column) -> Column:
    """completed reports can be saved and exported."""
    return status == "COMPLETED"


def can_delete(status: Column, hold_until: Column, now: Column) -> Column:
    """ended runs without a legal hold."""
    return status.isin(TERMINAL) & F.coalesce(hold_until <= now, F.lit(True))


def is_private_payload(payload: Column) -> Column:
    """whether a JSON text holds a forbidden key at any depth, in either case, with hyphens for underscores. The text is
    parsed and written again, so that escapes in keys are plain and quotes in values are not."""
    keys = "|".join(k.replace("_", "[_-]") for k in PRIVATE_KEYS)
    canonical = F.coalesce(F.to_json(F.try_parse_json(payload)), payload)
    space = r"(?:\s|\\[nrtfb])*"
    return F.rlike(canonical, F.lit(rf'(?i)[{{,]\s*"{space}({keys}){space}"\s*:'))


def transition_violations(events: DataFrame) -> DataFrame:
    """F10, ST9 in batch: events (run_id, sequence, stage) after a terminal one, or backward."""
    w = Window.partitionBy("run_id").orderBy("sequence")
    place = X.lookup(F.col("stage"), {s: i for i, s in enumerate(STATUS_ORDER)})
    e = events.withColumn("place", place).withColumn("highest", F.max("place").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("ended", F.max(F.col("stage").isin(TERMINAL)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    reason = F.when(F.col("ended"), "TERMINAL").when(~F.col("stage").isin("FAILED", "CANCELLED") & (F.col("place") < F.col("highest")), "BACKWARD")
    return e.withColumn("reason", reason).where("reason is not null").select("run_id", "sequence", "stage", "reason")


def completion_gate(runs: DataFrame, citations: DataFrame, expected: DataFrame) -> DataFrame:
    """runs with ready: title, verdict and review time, and as many citations as expected, all passed or partial."""
    c = citations.groupBy("run_id").agg(F.count(F.lit(1)).alias("citations"), F.bool_and(F.col("audit_status").isin("passed", "partial")).alias("audited"))
    j = runs.join(c, F.col("id") == F.col("run_id"), "left").drop("run_id").join(expected, F.col("id") == F.col("run_id"), "left").drop("run_id")
    ready = F.col("title").isNotNull() & F.col("verdict").isNotNull() & F.col("evidence_reviewed_at").isNotNull() & (F.col("expected") > 0) & (F.col("citations") == F.col("expected")) & F.col("audited")
    return j.withColumn("ready", F.coalesce(ready, F.lit(False)))


def held_for_review(claims: DataFrame) -> DataFrame:
    """Runs with allegations, and their number."""
    return claims.groupBy("run_id").agg(F.count_if(F.lower("claim_type") == "allegation").alias("allegations")).where("allegations > 0")


def next_versions(snapshots: DataFrame, stored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows numbered on from the highest stored version of their key."""
    top = stored.groupBy(key).agg(F.max("version_number").alias("__top"))
    w = Window.partitionBy(key).orderBy(*order)
    return snapshots.join(top, key, "left").withColumn("version_number", F.coalesce("__top", F.lit(0)) + F.row_number().over(w)).drop("__top")


def latest_terminal(events: DataFrame) -> DataFrame:
    """W11."""
    return events.where(F.col("stage").isin(TERMINAL)).groupBy("run_id").agg(F.max_by(F.struct("stage", "created_at"), "sequence").alias("e")).select("run_id", "e.*")


def public_events(events: DataFrame) -> DataFrame:
    """P10, AJ6: payload fields with their defaults; malformed payloads count as empty. events: run_id, sequence, stage, message,
    payload, and, where there are any, event_type and created_at."""
    events = events.withColumns({c: F.lit(None).cast(t) for c, t in (("event_type", "string"), ("created_at", "timestamp")) if c not in events.columns})
    p = F.from_json("payload", "completed_steps int, total_steps int, inaccessible_count int, source_counts map<string,int>")
    return events.withColumn("__p", p).select(
        "run_id", "sequence", "stage", F.coalesce("message", F.lit("Research progress updated.")).alias("message"),
        F.coalesce("__p.completed_steps", X.lookup(F.col("stage"), COMPLETED_STEPS, 0)).alias("completed_steps"), F.coalesce("__p.total_steps", F.lit(TOTAL_STEPS)).alias("total_steps"),
        F.coalesce("__p.inaccessible_count", F.lit(0)).alias("inaccessible_count"), F.coalesce("__p.source_counts", F.create_map().cast("map<string,int>")).alias("source_counts"),
        F.coalesce("event_type", F.lit("run.progress")).alias("event_type"), F.coalesce("created_at", F.current_timestamp()).alias("created_at"),
    )


def stage_progress(stage_no: Column, completed: Column, stages: int = 13) -> tuple[Column, Column]:
    """ST11: a worker's own count of its stages, which are more than the public steps."""
    return F.when(completed, stage_no).otherwise(stage_no - 1), F.lit(stages)


def report(run_id: str, runs: DataFrame, claims: DataFrame, evidence: DataFrame, calculations: DataFrame, citations: DataFrame) -> DataFrame:
    """One row for the run, with its claims (each with evidence), calculations and citations as sorted arrays. Filters on
    run_id reach the scans; each child table is grouped once."""
    per = lambda df: df.where(F.col("run_id") == run_id)
    ev = per(evidence).groupBy("run_id", "claim_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "evidence_id", "passage_id", "stance_value"))).alias("evidence"))
    cl = per(claims).join(ev, ["run_id", "claim_id"], "left").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("importance_weight")).alias("o"), "created_at", "claim_id", "text", "evidence"))).alias("claims"))
    ca = per(calculations).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "calculation_id", "formula_name", "result", "audit_status"))).alias("calculations"), F.count_if(~F.col("audit_status").isin("passed", "non_blocking")).alias("failed_audits"))
    ci = per(citations).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "citation_id", "passage_id", "audit_status"))).alias("citations"))
    out = runs.where(F.col("id") == run_id).withColumnRenamed("id", "run_id")
    for part in (cl, ca, ci):
        out = out.join(part, "run_id", "left")
    failed = F.when(F.col("failed_audits") > 0, F.concat(F.col("failed_audits"), F.lit(" calculation audit(s) require review; inspect audit_status and inputs.")))
    return out.withColumn("limitations", F.filter(F.array(failed), lambda x: x.isNotNull()))


def nested_sources(sources: DataFrame, passages: DataFrame, citations: DataFrame) -> DataFrame:
    """Sources, each with its passages, each with its citations."""
    c = citations.groupBy("passage_id").agg(F.array_sort(F.collect_list(F.struct("citation_id", "section"))).alias("citations"))
    p = passages.join(c, "passage_id", "left").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("passage_id", "text", "citations"))).alias("passages"))
    return sources.join(p, "source_id", "left")


def graph(sources: DataFrame, edges: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (sources with their place in the cluster, and clusters) and edges."""
    w = Window.partitionBy("cluster_id").orderBy("source_id")
    s = sources.select(F.concat(F.lit("source:"), "source_id").alias("node_id"), F.lit("source").alias("kind"), F.coalesce("title", "url").alias("label"), "cluster_id", (F.row_number().over(w) - 1).alias("place"))
    c = clusters.select(F.concat(F.lit("cluster:"), "cluster_id").alias("node_id"), F.lit("cluster").alias("kind"), F.col("origin_type").alias("label"), "cluster_id")
    nodes = s.unionByName(c, allowMissingColumns=True)
    own = sources.where("cluster_id is not null").select(F.concat(F.lit("source:"), "source_id").alias("from"), F.concat(F.lit("cluster:"), "cluster_id").alias("to"), F.lit("MEMBER_OF").alias("kind"))
    dep = edges.select(F.concat(F.lit("source:"), "parent").alias("from"), F.concat(F.lit("source:"), "child").alias("to"), F.col("relationship").alias("kind"), "confidence")
    return nodes, dep.unionByName(own, allowMissingColumns=True)


def graph_view(nodes: DataFrame, edges: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """the visible nodes, and the edges with both ends visible."""
    seen = nodes.where(where)
    ids = seen.select("node_id")
    e = edges.join(ids.withColumnRenamed("node_id", "from"), "from", "left_semi").join(ids.withColumnRenamed("node_id", "to"), "to", "left_semi")
    return seen, e


def lite_report(chunks: DataFrame) -> DataFrame:
    """Chunks grouped by document, with the strongest first. chunks: document_id, title, chunk_id, stance, confidence, combined."""
    return chunks.withColumn("strength", L.lite_stance(F.col("stance"), F.col("confidence"))).groupBy("document_id").agg(F.first("title").alias("title"), F.max("combined").alias("best"), F.array_sort(F.collect_list(F.struct((-F.col("combined")).alias("o"), "chunk_id", "strength"))).alias("chunks"))


def chunk_place(section: Column, page_: Column, heading: Column) -> tuple[Column, Column]:
    """Where a chunk stands, and its heading path as text."""
    return F.coalesce(section, F.concat(F.lit("page "), page_)), F.array_join(heading, " > ")


def public_documents(documents: DataFrame) -> DataFrame:
    """P8, F14."""
    return documents.where("visibility = 'public'").drop("metadata")


def demo_projection(runs: DataFrame) -> DataFrame:
    """Demo runs without private fields."""
    return runs.where(is_demo()).withColumns({c: F.lit(None).cast("string") for c in ("user_id", "submitted_url")})


def failure_reason(status: Column, submitted: Column, retryable: Column) -> tuple[Column, Column]:
    """Reason code and its public text."""
    known = ["PAYWALLED", "BOT_BLOCKED", "UNSUPPORTED"]
    code = F.concat(F.when(submitted, "SUBMITTED_URL").otherwise("SOURCE"), F.lit("_"), F.when(status.isin(known), status).otherwise("INACCESSIBLE"))
    kind = F.when(status.isin(known), status).when(retryable, "RETRYABLE").otherwise("OTHER")
    return code, F.when(submitted, X.lookup(kind, SUBMITTED_REASONS)).otherwise(X.lookup(kind, SOURCE_REASONS))


#: Kinds of failures of structured answers.
FAILURE_SUBTYPES = ["response_json", "choices_envelope", "message_content_type", "content_json", "usage_metadata", "output_schema"]
#: Metrics that are plain counts, with their units; each is a column of that name.
COUNTS = {
    "brave_query_count": "query", "brave_network_request_count": "request", "brave_cache_hit_count": "query", "brave_phase_two_query_count": "query", "brave_gate_expansion_count": "expansion",
    "deepseek_request_count": "request", "deepseek_batch_count": "batch", "deepseek_repair_count": "repair", "deepseek_recovery_count": "recovery_call",
    "deepseek_split_fallback_count": "split_fallback", "deepseek_recovery_success_count": "recovered_batch", "deepseek_recovery_exhaustion_count": "exhausted_stage",
    "queue_length": "job", "retry_count": "retry",
}


def run_metric_points(per_run: DataFrame, prices: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(run_id, name, value, unit), 35 points for each row of counts: snapshots, fetched, extracted, results, cache_hits,
    browser, approved, duplicates, candidates, prompt_tokens, total_tokens, median_latency, duration_seconds, citation_failed,
    cancelled, the columns of COUNTS and structured_failures (a map by subtype). Counts that per_run lacks are 0. prices: of a
    million tokens in and out, and of a search request."""
    have = set(per_run.columns)
    c = lambda name: F.coalesce(F.col(name), F.lit(0)) if name in have else F.lit(0)
    out = F.greatest(c("total_tokens") - c("prompt_tokens"), F.lit(0))
    money = lambda n, price: n.cast("decimal(18,0)") * F.lit(str(price)).cast("decimal(16,8)")
    cost = ((money(c("prompt_tokens"), prices[0]) + money(out, prices[1])) * F.lit("0.000001").cast("decimal(7,6)")).cast("double") + money(c("brave_network_request_count"), prices[2]).cast("double")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).cast("int") if name in have else F.lit(0)
    values = {
        "search_to_fetch_conversion": (L.safe_ratio(c("fetched"), c("results")), "ratio"), "extraction_success": (L.safe_ratio(c("extracted"), c("fetched")), "ratio"),
        "median_fetch_latency": (c("median_latency"), "millisecond"), "playwright_fallback_rate": (L.safe_ratio(c("browser"), c("fetched")), "ratio"),
        "cache_hit_rate": (L.safe_ratio(c("cache_hits"), c("fetched")), "ratio"), "duplicate_cluster_rate": (L.safe_ratio(c("duplicates"), c("candidates")), "ratio"),
        "evidence_yield": (L.safe_ratio(c("approved"), c("fetched")), "evidence_per_source"), "cost_per_verification": (cost, "currency_usd"),
        "deepseek_token_usage": (c("total_tokens"), "token"), "deepseek_input_token_usage": (c("prompt_tokens"), "token"), "deepseek_output_token_usage": (out, "token"),
        "source_accessibility_failure_rate": (L.safe_ratio(c("snapshots") - c("fetched"), c("snapshots")), "ratio"), "citation_audit_failure_rate": (flag("citation_failed"), "ratio"),
        "run_duration": (F.bround(c("duration_seconds").cast("double"), 6), "second"), "cancellation_rate": (flag("cancelled"), "ratio"),
    }
    values |= {name: (c(name), unit) for name, unit in COUNTS.items()}
    failures = lambda k: F.coalesce(F.try_element_at("structured_failures", F.lit(k)), F.lit(0)) if "structured_failures" in have else F.lit(0)
    values |= {f"deepseek_structured_failure_{k}_count": (failures(k), "failure") for k in FAILURE_SUBTYPES}
    points = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"), F.lit(u).alias("unit")) for n, (v, u) in values.items()])
    return per_run.select("run_id", F.inline(points))


def merged_batches(batches: DataFrame, by: list[str]) -> DataFrame:
    """Sums of tokens, latency, requests, repairs and recoveries, most attempts, failures by kind; uniform: all batches used one
    model, prompt and temperature. batches: by, model, prompt, temperature, attempts, failures map and the summed columns, those
    that there are."""
    kinds = batches.select(*by, F.explode_outer("failures").alias("k", "v")).groupBy(*by, "k").agg(F.sum("v").alias("v")).where("k is not null").groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("failures"))
    summed = [c for c in ("prompt_tokens", "completion_tokens", "total_tokens", "latency_ms", "request_count", "repair_count", "recovery_count", "split_fallback_count", "recovery_success_count") if c in batches.columns]
    sums = batches.groupBy(*by).agg(*[F.sum(c).alias(c) for c in summed], F.count(F.lit(1)).alias("batches"), F.max("attempts").alias("attempts"), (F.countDistinct(F.struct("model", "prompt", "temperature")) == 1).alias("uniform"))
    return sums.join(kinds, by, "left")


def is_retryable(code: Column, retryable: Column, error_code: Column, recovery_exhausted: Column) -> Column:
    """what the workflow says, but for failures of contract and bodies that no local recovery could parse."""
    final = F.coalesce(code.isin(DETERMINISTIC_CODES), F.lit(False)) | F.coalesce(error_code.isin(DETERMINISTIC_CODES), F.lit(False))
    unparsed = F.coalesce((error_code == "PROVIDER_BODY_PARSE_EXHAUSTED") & recovery_exhausted, F.lit(False))
    return ~final & ~unparsed & retryable


def latest_per(df: DataFrame, key: list[str], at: str) -> DataFrame:
    """IO15: the latest row of each key; a null time is the earliest, ties go to the largest row."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(at).isNotNull(), at, F.xxhash64(*rest))).alias("r")).select(*key, "r.*")


def active_runs(runs: DataFrame) -> DataFrame:
    """(user_id, active, visible): runs that haven't ended, and those that aren't deleted."""
    return runs.groupBy("user_id").agg(F.count_if(~F.col("status").isin(TERMINAL)).alias("active"), F.count_if(F.col("deleted_at").isNull()).alias("visible"))


def reviewed_at(runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """DT2, DT6: runs with evidence_reviewed_at, else the latest retrieval of their snapshots; UTC in a UTC session."""
    last = snapshots.groupBy("run_id").agg(F.max("retrieved_at").alias("__last"))
    return runs.join(last, "run_id", "left").withColumn("evidence_reviewed_at", F.coalesce("evidence_reviewed_at", "__last")).drop("__last")


def snapshot_label(version: Column, retrieved_at: Column) -> Column:
    """DT5: `v3 · 2024-05-01`."""
    return F.concat(F.lit("v"), version, F.lit(" · "), F.date_format(retrieved_at, "yyyy-MM-dd"))


def merged_json(old: Column, **new: Column) -> Column:
    """AJ2: a map of JSON texts with the new entries over the old ones."""
    pairs = [x for k, v in new.items() for x in (F.lit(k), F.to_json(v))]
    added = F.create_map(*pairs)
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(added, k))
    return F.map_concat(kept, added)


def coverage(expected: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): references without a result, with several, and results that nobody asked for."""
    r = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    j = expected.select(*keys).distinct().withColumn("e", F.lit(True)).join(r, keys, "full_outer")
    return j.withColumn("problem", F.when(F.col("n").isNull(), "MISSING").when(F.col("e").isNull(), "UNKNOWN").when(F.col("n") > 1, "DUPLICATE")).where("problem is not null").select(*keys, "problem")


def unknown_references(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """J17."""
    return rows.join(known.select(*keys), keys, "left_anti")


def parent_texts(claims: DataFrame) -> DataFrame:
    """Claims with the text of their parent."""
    p = claims.select("run_id", F.col("claim_ref").alias("parent_claim_ref"), F.col("text").alias("parent_text"))
    return claims.join(p, ["run_id", "parent_claim_ref"], "left")
