"""Search policy and planning (T10 to T12, T15, M22, J16, F8, F19, F20, F22, P12, P13, U8 to U11, ST10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import labels as L
from ..functions import text as X


def normalized_plan(plans: DataFrame) -> DataFrame:
    """Plans (run_id, objectives array<struct<claim_ref, intent, target, priority, queries array<struct<query, priority>>>>)
    as one row for each query, with the objective's intent and stable references."""
    o = plans.select("run_id", F.posexplode("objectives").alias("objective_no", "o"))
    ref = I.short_ref("obj", F.col("o.claim_ref"), F.col("o.intent"), X.canonical_text(F.col("o.target")))
    # equal objectives of a run get their place as a suffix
    again = F.row_number().over(Window.partitionBy("run_id", ref).orderBy("objective_no"))
    o = o.withColumn("objective_ref", F.when(again == 1, ref).otherwise(F.concat(ref, F.lit("-"), again)))
    q = o.select("run_id", "objective_no", "objective_ref", "o.claim_ref", "o.intent", F.posexplode("o.queries").alias("query_no", "q"))
    return q.select("run_id", "objective_no", "query_no", "objective_ref", "claim_ref", "intent", "q.query", F.coalesce("q.priority", F.lit(0.5)).alias("priority"))


def required_intents(claims: DataFrame) -> DataFrame:
    """The intents each claim needs."""
    need = F.when(F.col("fact_checkability") == "not_fact_checkable", F.array().cast("array<string>")).otherwise(F.array(F.lit("primary"), F.lit("contradiction")))
    quoted = F.col("claim_kind").isin("quotation", "attribution")
    return claims.select("run_id", "claim_ref", F.when(quoted, F.array_append(need, "attribution")).otherwise(need).alias("required"))


def initial_queries(queries: DataFrame, claims: DataFrame, runs: DataFrame) -> DataFrame:
    """Queries with phase: one (mandatory or filling), reserve, or null (beyond the budget or a repeated text).

    queries: run_id, claim_ref, intent, query, priority, query_no; claims: run_id, claim_ref (those to be checked);
    runs: run_id, depth, attribution_required. Texts are first made unique in each run and intent, so the mandatory query of a
    claim and intent is a rank, not a fold, unless two claims want the same text: then the first in order has it.
    """
    # what a run needs comes as one row, and all windows are within a run, so that the queries are shuffled once
    of_run = claims.groupBy("run_id").agg(F.count(F.lit(1)).alias("claims"), F.collect_set("claim_ref").alias("checked"))
    budget = runs.join(of_run, "run_id", "left").select("run_id", "attribution_required", "checked", L.search_budget(F.col("depth"), F.coalesce("claims", F.lit(0)), F.col("attribution_required")).alias("b"))
    q = queries.withColumn("text", X.canonical_text(F.col("query"))).join(budget, "run_id")
    order = [F.desc("priority"), F.col("text"), F.col("query_no")]
    q = q.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))
    own = F.coalesce(F.array_contains("checked", F.col("claim_ref")) & F.col("intent").isin("primary", "contradiction"), F.lit(False))
    attribution = F.coalesce(F.col("attribution_required") & (F.col("intent") == "attribution"), F.lit(False))
    q = q.withColumn("own", own).withColumn("attr", attribution)
    nth = lambda *keys: F.row_number().over(Window.partitionBy("run_id", *keys).orderBy("rank"))
    chosen = (F.col("own") & (F.col("of_claim") == 1)) | (F.col("attr") & (F.col("of_run") == 1))
    q = q.withColumn("of_claim", nth("claim_ref", "intent", "own")).withColumn("of_run", nth("attr"))
    q = q.withColumn("taken", F.min(F.when(chosen, F.col("rank"))).over(Window.partitionBy("run_id", "text")))
    m = q.withColumn("again", nth("text")).withColumn("mandatory", F.when(F.col("rank") == F.col("taken"), 1))
    usable = F.col("mandatory").isNotNull() | (F.col("taken").isNull() & (F.col("again") == 1))
    m = m.withColumn("usable", usable).withColumn("place", F.when(usable, F.row_number().over(Window.partitionBy("run_id", "usable").orderBy(F.desc_nulls_last("mandatory"), "rank"))))
    phase = F.when(F.col("place") <= F.col("b.phase_one"), "one").when(F.col("place") <= F.col("b.total"), "reserve")
    return m.select(*queries.columns, F.col("mandatory").isNotNull().alias("mandatory"), F.col("place").alias("position"), phase.alias("phase"))


def reserve_batch(reserve: DataFrame, executed: DataFrame, batch: Column, remaining: Column) -> DataFrame:
    """For each run, the next reserve queries that weren't executed. executed: run_id, objective_ref, query."""
    rest = reserve.join(executed.select("run_id", "objective_ref", "query"), ["run_id", "objective_ref", "query"], "left_anti")
    ranked = rest.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("position")))
    return ranked.where(F.col("n") <= F.least(batch, F.greatest(remaining, F.lit(0))))


def discovery_gate(candidates: DataFrame, objectives: DataFrame, claims: DataFrame, runs: DataFrame, origin: str = "brave_discovery") -> DataFrame:
    """One row for each run: counts, coverage gaps and reason codes. candidates: run_id, url, canonical_url,
    domain, objective_refs, source_origin."""
    found = candidates.where(F.col("source_origin") == origin)
    covered = found.select("run_id", F.explode("objective_refs").alias("objective_ref")).distinct().join(objectives, ["run_id", "objective_ref"]).select("run_id", "claim_ref", "intent").distinct()
    per_claim = claims.select("run_id", "claim_ref").join(covered.groupBy("run_id", "claim_ref").agg(F.collect_set("intent").alias("i")), ["run_id", "claim_ref"], "left")
    lacks = lambda x: F.count_if(F.col("i").isNull() | ~F.array_contains("i", x))
    gaps = per_claim.groupBy("run_id").agg(lacks("primary").alias("missing_primary"), lacks("contradiction").alias("missing_contradiction"))
    attribution = covered.groupBy("run_id").agg(F.bool_or(F.col("intent") == "attribution").alias("attribution"))
    counts = found.groupBy("run_id").agg(F.countDistinct(F.coalesce("canonical_url", "url")).alias("candidates"), F.countDistinct("domain").alias("domains"))
    j = runs.join(gaps, "run_id", "left").join(attribution, "run_id", "left").join(counts, "run_id", "left").fillna(0, ["missing_primary", "missing_contradiction", "candidates", "domains"])
    part = lambda i: X.lookup(F.col("depth"), {k: v[i] for k, v in L.DEPTHS.items()})
    reasons = F.array(
        F.when(F.col("missing_primary") > 0, "MISSING_PRIMARY_COVERAGE"),
        F.when(F.col("missing_contradiction") > 0, "MISSING_CONTRADICTION_COVERAGE"),
        F.when(F.col("attribution_required") & ~F.coalesce("attribution", F.lit(False)), "MISSING_ATTRIBUTION_COVERAGE"),
        F.when(F.col("candidates") < part(4), "CANDIDATE_COUNT_BELOW_MINIMUM"),
        F.when(F.col("domains") < part(5), "DOMAIN_COUNT_BELOW_MINIMUM"),
    )
    j = j.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))
    return j.select("run_id", "candidates", "domains", "missing_primary", "missing_contradiction", "reasons", (F.size("reasons") == 0).alias("passed"))


def preflight_plan(matches: DataFrame, per_claim: int = 2, total: int = 6) -> DataFrame:
    """At most two holders for each claim, six for a run, claims in order. matches: run_id, claim_no, priority, holder."""
    own = matches.withColumn("n", F.row_number().over(Window.partitionBy("run_id", "claim_no").orderBy("priority", "holder"))).where(F.col("n") <= per_claim)
    return own.withColumn("position", F.row_number().over(Window.partitionBy("run_id").orderBy("claim_no", "n"))).where(F.col("position") <= total)


def mixed_selection(authority: DataFrame, broad: DataFrame, limit: int, reserved: int = 2) -> DataFrame:
    """Ranked authority and broad rows (run_id, ref, position) in one list of `limit`, with up to `reserved` places kept
    for broad ones; what one side leaves, the other has."""
    b = broad.join(authority.select("run_id", "ref"), ["run_id", "ref"], "left_anti")
    nb = b.groupBy("run_id").agg(F.count(F.lit(1)).alias("nb"))
    a = authority.join(nb, "run_id", "left").withColumn("room", limit - F.least(F.lit(reserved), F.coalesce("nb", F.lit(0)))).where("position <= room").drop("nb", "room")
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    w = Window.partitionBy("run_id").orderBy("side", "position")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def needs_browser(priority: Column, source_type: Column, intents: Column) -> Column:
    """F22."""
    return (priority >= 0.75) | source_type.isin("PRIMARY", "OFFICIAL_SELF_REPORT") | F.arrays_overlap(intents, F.array(F.lit("primary"), F.lit("correction")))


def plan_violations(objectives: DataFrame, queries: DataFrame, claims: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, code, n) of plan contract violations; n > 0. Every code is one aggregate over its own tables."""
    r = ["run_id"]
    count = F.count(F.lit(1)).alias("n")
    c = claims.select("run_id", "claim_ref")
    planned = objectives.select("run_id", "claim_ref").distinct()
    o = objectives.select("run_id", "objective_ref", F.col("claim_ref").alias("o_claim"), F.col("intent").alias("o_intent")).dropDuplicates(["run_id", "objective_ref"])
    q = queries.join(o, ["run_id", "objective_ref"], "left").withColumn("text", X.canonical_text(F.col("query")))
    checkable = claims.where("fact_checkability <> 'not_fact_checkable'").select("run_id", "claim_ref")

    def lacking(intent: str) -> DataFrame:
        have = q.where(F.col("intent") == intent).select("run_id", F.col("o_claim").alias("claim_ref")).distinct()
        return checkable.join(have, ["run_id", "claim_ref"], "left_anti")

    budget = runs.join(checkable.groupBy(*r).agg(F.count(F.lit(1)).alias("k")), "run_id", "left").select("run_id", "attribution_required", L.search_budget(F.col("depth"), F.coalesce("k", F.lit(0)), F.col("attribution_required")).alias("b"))
    sizes = q.groupBy(*r).agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("text").alias("texts"), F.count_if(F.col("intent") == "attribution").alias("attr"))
    s = budget.join(sizes, "run_id", "left").fillna(0, ["queries", "texts", "attr"])
    as_code = lambda df, code: df.groupBy(*r).agg(count).select("run_id", F.lit(code).alias("code"), "n")
    parts = [
        objectives.groupBy(*r).agg((F.count(F.lit(1)) - F.countDistinct("objective_ref")).alias("n")).select("run_id", F.lit("PLAN_DUPLICATE_OBJECTIVE_REF").alias("code"), "n"),
        as_code(objectives.join(c, ["run_id", "claim_ref"], "left_anti"), "PLAN_UNKNOWN_CLAIM_REF"),
        as_code(c.distinct().join(planned, ["run_id", "claim_ref"], "left_anti"), "PLAN_MISSING_CLAIM_COVERAGE"),
        as_code(planned.join(c, ["run_id", "claim_ref"], "left_anti"), "PLAN_EXTRA_CLAIM_COVERAGE"),
        s.where("b.total is null").select("run_id", F.lit("PLAN_COVERAGE_BUDGET_EXCEEDED").alias("code"), F.lit(1).cast("long").alias("n")),
        s.select("run_id", F.lit("PLAN_QUERY_LIMIT_EXCEEDED").alias("code"), (F.col("queries") - F.coalesce("b.total", F.lit(0))).cast("long").alias("n")),
        s.select("run_id", F.lit("PLAN_DUPLICATE_QUERY").alias("code"), (F.col("queries") - F.col("texts")).cast("long").alias("n")),
        as_code(lacking("primary"), "PLAN_PRIMARY_PATH_MISSING"),
        as_code(lacking("contradiction"), "PLAN_CONTRADICTION_PATH_MISSING"),
        s.where("attribution_required and attr = 0").select("run_id", F.lit("PLAN_ATTRIBUTION_PATH_MISSING").alias("code"), F.lit(1).cast("long").alias("n")),
        as_code(q.where("o_intent is null"), "PLAN_UNKNOWN_OBJECTIVE_REF"),
        as_code(q.where("intent <> o_intent"), "PLAN_INTENT_MISMATCH"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")


CLAIM_LIMITS = {"QUICK": 12, "STANDARD": 25, "DEEP": 50}


def decomposition_violations(claims: DataFrame, runs: DataFrame, ambiguities: DataFrame) -> DataFrame:
    """(run_id, code, n). claims: run_id, claim_no (from 0), text, span, parent_no; runs: run_id, depth, input_text; ambiguities:
    run_id, owner_no, text. A run's parents are walked in one array, as many steps as it has claims."""
    c = claims.join(runs, "run_id")
    per = c.groupBy("run_id").agg(
        F.greatest(F.count(F.lit(1)) - F.max(X.lookup(F.col("depth"), CLAIM_LIMITS)), F.lit(0)).alias("DECOMPOSITION_CLAIM_LIMIT_EXCEEDED"),
        (F.count(F.lit(1)) - F.countDistinct(X.canonical_text(F.col("text")))).alias("DECOMPOSITION_DUPLICATE_CLAIM"),
        F.count_if(F.col("span").isNotNull() & ~F.contains("input_text", "span")).alias("DECOMPOSITION_INVALID_ORIGINAL_TEXT_SPAN"),
        F.count(F.lit(1)).alias("claims"), F.array_sort(F.collect_list(F.struct("claim_no", "parent_no"))).alias("p"),
    )
    parents = F.transform("p", lambda x: x["parent_no"].cast("int"))
    outside = F.size(F.filter("parents", lambda x: x >= F.col("claims")))
    step = lambda at, _: F.when((at >= 0) & (at < F.col("claims")), F.get("parents", at))
    ends = lambda i: F.aggregate(F.sequence(F.lit(0), F.col("claims").cast("int")), i, step)
    cycle = F.size(F.filter(F.sequence(F.lit(0), F.col("claims").cast("int") - 1), lambda i: ends(i).isNotNull()))
    per = per.withColumn("parents", parents).withColumns({"DECOMPOSITION_PARENT_INDEX_INVALID": outside.cast("long"), "DECOMPOSITION_CLAIM_CYCLE": cycle.cast("long")})
    owners = ambiguities.join(per.select("run_id", "claims"), "run_id").groupBy("run_id").agg(F.count_if(F.col("owner_no") >= F.col("claims")).alias("DECOMPOSITION_AMBIGUITY_OWNER_INDEX_INVALID"))
    codes = [f"DECOMPOSITION_{x}" for x in ("CLAIM_LIMIT_EXCEEDED", "DUPLICATE_CLAIM", "INVALID_ORIGINAL_TEXT_SPAN", "PARENT_INDEX_INVALID", "CLAIM_CYCLE", "AMBIGUITY_OWNER_INDEX_INVALID")]
    return per.join(owners, "run_id", "left").select("run_id", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in codes]).unpivot(["run_id"], codes, "code", "n").where("n > 0")


def assigned_refs(claims: DataFrame, content: list[str]) -> DataFrame:
    """Claims with claim_ref, `claim-<number>-<16 hex digits>` of their canonical content, and parent_claim_ref. claims:
    run_id, claim_no (from 0), parent_no and the text columns of `content`."""
    body = I.sorted_json(**{c: X.canonical_text(F.col(c)) for c in content})
    c = claims.withColumn("claim_ref", F.concat(F.lit("claim-"), F.col("claim_no") + 1, F.lit("-"), F.substring(I.sha256(body), 1, 16)))
    p = c.select("run_id", F.col("claim_no").alias("parent_no"), F.col("claim_ref").alias("parent_claim_ref"))
    return c.join(p, ["run_id", "parent_no"], "left")


def intake_status(expected: Column, kind: Column, text: Column, submitted: Column) -> Column:
    """kinds are text, article_title and article_url; the first failing check, or ACCEPTED."""
    part = lambda x: F.try_parse_url(F.trim(submitted), F.lit(x))
    good_url = F.lower(part("PROTOCOL")).isin("http", "https") & part("HOST").isNotNull() & part("USERINFO").isNull()
    title = F.trim(F.regexp_replace(submitted, r"\s+", " "))
    return (
        F.when(expected.isNotNull() & (expected != kind), "INPUT_TYPE_MISMATCH")
        .when((F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) == "") | (F.length(text) > 100_000), "INVALID_NORMALIZED_INPUT")
        .when((kind == "article_url") & ~F.coalesce(good_url, F.lit(False)), "INVALID_NORMALIZED_URL")
        .when((kind == "article_title") & ((F.coalesce(title, F.lit("")) == "") | (F.length(title) > 500)), "INVALID_ARTICLE_TITLE").otherwise("ACCEPTED")
    )


def visible_claims(claims: DataFrame, label: str | None = None, text: str = "") -> DataFrame:
    """claims with a final label and a text that holds what was typed, in either case."""
    kept = claims.where(F.contains(F.lower("text"), F.lit(text.lower())))
    return kept if label is None else kept.where(F.col("final_label") == label)


def with_inaccessible(claims: DataFrame, objectives: DataFrame, candidates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Claims with inaccessible: whether a source that was looked up for one of their objectives has a snapshot that was not fetched.
    Objectives of candidates (array objective_refs) are exploded, so the overlap is an equi-join."""
    failed = snapshots.where("access_status <> 'FETCHED'").select("run_id", "source_ref").distinct()
    met = candidates.join(failed, ["run_id", "source_ref"], "left_semi").select("run_id", F.explode("objective_refs").alias("objective_ref")).distinct()
    hit = objectives.join(met, ["run_id", "objective_ref"], "left_semi").select("run_id", "claim_ref", F.lit(True).alias("__hit")).distinct()
    return claims.join(hit, ["run_id", "claim_ref"], "left").withColumn("inaccessible", F.coalesce("__hit", F.lit(False))).drop("__hit")


def classification_batches(claims: DataFrame, passages: DataFrame, size: int) -> DataFrame:
    """P11, AJ8: (run_id, batch, payload): JSON lists of at most `size` tasks, a claim and one of its passages each, in order of
    claim and rank. passages: run_id, claim_ref, rank, passage_id, text; claims: run_id, claim_ref, claim_text."""
    task = F.concat(F.lit("classification-"), F.substring(I.sha256(F.concat_ws("\x1f", "claim_ref", "passage_id")), 1, 24))
    j = passages.join(claims, ["run_id", "claim_ref"]).withColumn("task_ref", task)
    w = Window.partitionBy("run_id").orderBy("claim_ref", "rank", "passage_id")
    j = j.withColumn("n", F.row_number().over(w)).withColumn("batch", F.floor((F.col("n") - 1) / size))
    item = F.struct("n", F.struct("task_ref", "claim_ref", "claim_text", "passage_id", "text").alias("task"))
    return j.groupBy("run_id", "batch").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["task"])).alias("payload"), F.count(F.lit(1)).alias("tasks"))


def sections(*named: tuple[str, DataFrame]) -> DataFrame:
    """U8: sentence tables one after another, with section and its number."""
    out = None
    for i, (name, df) in enumerate(named):
        part = df.withColumn("section", F.lit(name)).withColumn("section_no", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key isn't in new."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def with_title_queries(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """A query with the exact title before the others, unless an equal primary one exists. titles: run_id, claim_ref, title."""
    have = queries.where("intent = 'primary'").select("run_id", X.canonical_text(F.col("query")).alias("text"))
    new = titles.select("run_id", "claim_ref", F.concat(F.lit('"'), "title", F.lit('"')).alias("query")).withColumn("text", X.canonical_text(F.col("query")))
    new = new.join(have, ["run_id", "text"], "left_anti").select("run_id", "claim_ref", "query", F.lit("primary").alias("intent"), F.lit(1.0).alias("priority"), F.lit(-1).alias("query_no"))
    return new.unionByName(queries, allowMissingColumns=True)


def with_submitted_url(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """The submitted URL as a candidate of priority 1."""
    seed = runs.where("submitted_url is not null").select("run_id", F.col("submitted_url").alias("url"), F.lit(1.0).alias("priority"), F.lit("submitted_url").alias("source_origin"))
    return candidates.unionByName(seed, allowMissingColumns=True)


def queue_of(depth: Column) -> Column:
    """ST10."""
    return X.lookup(depth, {"QUICK": "verification.quick", "STANDARD": "verification.standard", "DEEP": "verification.deep"})
