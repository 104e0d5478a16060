"""Evidence scoring of claims and runs.

Tables: evidence (run_id, claim_ref, passage_id, source_ref, stance, six quality components, context_issues, confidence_issues,
rejection_reasons), multipliers (run_id, source_ref, multiplier), sources (run_id, source_ref, source_type, origin,
organization), claims (run_id, claim_ref, importance, importance_weight, checkable, claim_kind, ambiguity_owned, has_period).
Each stage is a join on keys and one aggregate; weights stay decimals until the last division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

QUALITY = ("relevance", "directness", "authority", "transparency", "temporal_fit", "certainty")


def rejection_reasons(relevance: Column, certainty: Column, entity_match: Column, period_match: Column, located: Column, stance: Column, grounded_contradiction: Column, explicit: Column) -> Column:
    """the gates that an item fails; the last counts only where no other did."""
    first = F.filter(
        F.array(
            F.when(relevance < 0.50, "relevance_below_minimum"),
            F.when(certainty < 0.65, "extraction_certainty_below_minimum"),
            F.when(~entity_match & ~grounded_contradiction, "entity_mismatch"),
            F.when(~period_match, "time_period_mismatch"),
            F.when(located == F.lit(False), "quotation_or_number_not_located"),
        ),
        lambda x: x.isNotNull(),
    )
    neutral = (F.size(first) == 0) & (stance == "neutral") & ~explicit
    return F.when(neutral, F.array(F.lit("neutral_without_explicit_evidence"))).otherwise(first)


def weighted_evidence(evidence: DataFrame, multipliers: DataFrame) -> DataFrame:
    """A1, A2: evidence with value, quality, multiplier (1 where none is given) and weight."""
    m = multipliers.select("run_id", "source_ref", F.col("multiplier").cast("decimal(3,2)").alias("multiplier"))
    e = evidence.join(m, ["run_id", "source_ref"], "left").withColumn("multiplier", F.coalesce("multiplier", F.lit("1.00").cast("decimal(3,2)")))
    e = e.withColumn("value", L.stance_value(F.col("stance")).cast("decimal(3,2)")).withColumn("quality", L.evidence_quality(**{c: F.col(c) for c in QUALITY}))
    return e.withColumn("weight", (F.col("quality") * F.col("multiplier")).cast("decimal(12,10)"))


def balance(weighted: DataFrame, by: list[str]) -> DataFrame:
    """A3 to A5: supporting, contradicting and total weight of each key, support and consistency."""
    up, down = F.greatest("value", F.lit(0)) * F.col("weight"), F.greatest(-F.col("value"), F.lit(0)) * F.col("weight")
    sums = weighted.groupBy(*by).agg(F.sum(up).cast("decimal(28,12)").alias("supporting"), F.sum(down).cast("decimal(28,12)").alias("contradicting"), F.count(F.lit(1)).alias("items"))
    p, n = F.col("supporting").cast("double"), F.col("contradicting").cast("double")
    return sums.withColumn("total", F.col("supporting") + F.col("contradicting")).withColumn("support", L.support(p, n)).withColumn("consistency", L.consistency(p, n))


def all_issues(c: str) -> Column:
    """An aggregate: the distinct issues of arrays. Empty arrays, which most are, go into no set."""
    return F.array_distinct(F.flatten(F.collect_set(F.when(F.size(c) > 0, F.col(c)))))


def by_source(evidence: DataFrame, multipliers: DataFrame, sources: DataFrame) -> DataFrame:
    """A1, A2: one row for each claim and source: sums of its accepted items and the source's own columns. Evidence, multipliers and
    sources meet on (run_id, source_ref), and the aggregate keeps that partitioning: the evidence is shuffled once."""
    accepted = evidence.where(F.size("rejection_reasons") == 0)
    w = weighted_evidence(accepted, multipliers).join(sources, ["run_id", "source_ref"], "left")
    up, down = F.greatest("value", F.lit(0)) * F.col("weight"), F.greatest(-F.col("value"), F.lit(0)) * F.col("weight")
    own = [c for c in sources.columns if c not in ("run_id", "source_ref")]
    return w.groupBy("run_id", "claim_ref", "source_ref").agg(
        F.sum(up).cast("decimal(28,12)").alias("up"), F.sum(down).cast("decimal(28,12)").alias("down"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("quality") * F.col("weight")).alias("qw"), F.sum("weight").alias("w"),
        *[all_issues(c).alias(c) for c in ("context_issues", "confidence_issues")],
        *[F.first(c).alias(c) for c in own],
    )


def up_to_two(c: Column) -> Column:
    """An aggregate: the number of distinct values, 2 for more. What counts is none, one or several (A8 caps at 2), so the smallest
    and the largest value tell it, in one pass with map-side combine."""
    return F.when(F.min(c).isNull(), 0).when(F.min(c) == F.max(c), 1).otherwise(2)


def gathered(rows: DataFrame, by: list[str]) -> DataFrame:
    """A3 to A5, A7, A8 of each key from by_source() rows, in one aggregate: balance, mean quality, issues, and independence of the
    distinct sources. origins, primary_sources, organizations, methods and sources are 0, 1, or 2 for more."""
    org = F.coalesce(F.nullif(F.lower("organization"), F.lit("")), F.col("source_ref"))
    source = F.col("source_ref")
    sums = rows.groupBy(*by).agg(
        F.sum("up").cast("decimal(28,12)").alias("supporting"), F.sum("down").cast("decimal(28,12)").alias("contradicting"), F.sum("n").alias("items"),
        F.try_divide(100 * F.sum("qw").cast("double"), F.sum("w").cast("double")).alias("average_quality"),
        *[all_issues(c).alias(c) for c in ("context_issues", "confidence_issues")],
        up_to_two(F.coalesce("origin", "source_ref")).alias("origins"), up_to_two(F.when(F.col("source_type") == "PRIMARY", source)).alias("primary_sources"), up_to_two(org).alias("organizations"),
        F.greatest(up_to_two(F.col("data_chain")), up_to_two(F.when(F.col("independent"), source))).alias("methods"), up_to_two(source).alias("sources"),
        F.max(F.when(F.col("source_type") == "OFFICIAL_SELF_REPORT", 1).otherwise(0)).alias("self_report"),
    )
    p, n = F.col("supporting").cast("double"), F.col("contradicting").cast("double")
    sums = sums.withColumn("total", F.col("supporting") + F.col("contradicting")).withColumn("support", L.support(p, n)).withColumn("consistency", L.consistency(p, n))
    return sums.withColumn("independence", L.source_independence(**{k: L.diversity_part(F.col(k)) for k in L.INDEPENDENCE_WEIGHTS}))


def claim_scores(rows: DataFrame, claims: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Scores, gates and label of each claim of claims, from its by_source() rows."""
    by = ["run_id", "claim_ref"]
    none = F.array().cast("array<string>")
    j = claims.join(gathered(rows, by), by, "left")
    j = j.withColumn("adequate", F.coalesce(F.col("total").cast("double") >= minimum, F.lit(False)))
    j = j.withColumn("primary_access", F.when(F.col("primary_sources") > 0, 100.0).otherwise(0.0))
    issues = F.array_union(
        F.coalesce("confidence_issues", none),
        F.filter(F.array(F.when(F.col("ambiguity_owned"), "essential_term_ambiguous"), F.when((F.col("origins") == 1) & (F.col("sources") > 1), "single_information_cluster")), lambda x: x.isNotNull()),
    )
    j = j.withColumn("confidence_issues", issues).withColumn("context", L.context_completeness(F.coalesce("context_issues", none)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    confidence = L.verdict_confidence(
        L.penalty_sum(F.col("confidence_issues"), L.CONFIDENCE_PENALTIES),
        coverage=F.when(F.col("adequate"), 100.0).otherwise(0.0), average_quality=zero("average_quality"), independence=zero("independence"), consistency=zero("consistency"), primary_access=F.col("primary_access"),
    )
    j = j.withColumn("confidence", confidence)
    single = (F.col("sources") == 1) & (F.col("self_report") == 1)
    blocks = F.col("ambiguity_owned") & ~L.ambiguity_non_blocking(F.col("ambiguity_owned"), F.col("adequate"), F.col("support"), F.coalesce("supporting", F.lit(0)), F.coalesce("contradicting", F.lit(0)))
    unresolved = blocks | (F.array_contains("confidence_issues", "speaker_or_date_unresolved") & (F.col("claim_kind").isin("attribution", "quotation") | F.col("has_period")))
    j = j.withColumn("unresolved", unresolved).withColumn("reasons", L.insufficiency_reasons(~F.col("adequate"), F.lit(False), F.coalesce(single, F.lit(False)), F.col("unresolved")))
    return j.withColumn("label", L.claim_label(F.col("support"), F.col("confidence"), F.col("context"), F.size("reasons") > 0))


def run_scores(claim_scores_: DataFrame, rows: DataFrame, minimum: float = 0.5, places: int | None = 10) -> DataFrame:
    """One row for each run. Balance and quality are over all accepted items, not means of claims. Means are
    taken at so many places; without places they are plain doubles as SQL has them, a run's claims added in their order."""
    overall = gathered(rows, ["run_id"]).select("run_id", "average_quality", "consistency", "total", "independence", "primary_sources", "sources", "self_report")
    essential = F.col("importance") == "essential"
    scored = F.col("support").isNotNull()
    weight = F.col("importance_weight").cast("double")

    def mean(value: Column, where: Column) -> Column:
        if places is not None:  # so that the order in which doubles are added moves no mean across a label's threshold
            return F.round(F.try_divide(F.sum(F.when(where, value * weight)), F.sum(F.when(where, weight))), places)
        claims = F.array_sort(F.collect_list(F.when(where, F.struct("claim_ref", (value * weight).alias("x")))))
        return F.try_divide(F.aggregate(claims, F.lit(0.0), lambda a, c: a + c["x"]), F.sum(F.when(where, weight)))

    per_run = claim_scores_.groupBy("run_id").agg(
        mean(F.col("support"), scored & F.col("checkable")).alias("accuracy"),
        mean(F.col("support"), scored & (F.col("claim_kind") == "attribution")).alias("attribution"),
        mean(F.col("context"), F.lit(True)).alias("context"),
        mean(F.when(F.col("adequate"), 100.0).otherwise(0.0), essential & F.col("checkable")).alias("coverage_essential"),
        mean(F.when(F.col("adequate"), 100.0).otherwise(0.0), F.col("checkable")).alias("coverage_all"),
        F.bool_or(essential).alias("any_essential"),
        F.bool_or(essential & F.col("adequate")).alias("essential_adequate"),
        F.coalesce(F.bool_or(essential & (F.col("support") <= 10) & (F.col("confidence") >= 70)), F.lit(False)).alias("refuted"),
        F.array_distinct(F.flatten(F.collect_set(F.array_remove("confidence_issues", "essential_term_ambiguous")))).alias("issues"),
        F.bool_or(F.array_contains("confidence_issues", "speaker_or_date_unresolved") & (F.col("claim_kind").isin("attribution", "quotation") | F.col("has_period"))).alias("speaker_block"),
    )
    j = per_run.join(overall, "run_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    j = j.withColumn("coverage", F.coalesce(F.when(F.col("any_essential"), F.col("coverage_essential")).otherwise(F.col("coverage_all")), F.lit(0.0)))
    j = j.withColumn("confidence", L.verdict_confidence(
        L.penalty_sum(F.col("issues"), L.CONFIDENCE_PENALTIES), coverage=F.col("coverage"), average_quality=zero("average_quality"), independence=zero("independence"),
        consistency=zero("consistency"), primary_access=F.when(F.col("primary_sources") > 0, 100.0).otherwise(0.0),
    ))
    j = j.withColumn("reasons", L.insufficiency_reasons(
        F.coalesce(F.col("total").cast("double") < minimum, F.lit(True)), F.col("any_essential") & ~F.col("essential_adequate"),
        F.coalesce((F.col("sources") == 1) & (F.col("self_report") == 1), F.lit(False)), F.col("speaker_block"),
    ))
    return j.withColumn("label", L.article_label(F.col("accuracy"), F.col("confidence"), F.coalesce("context", F.lit(100.0)), F.size("reasons") > 0, F.col("refuted")))


def approved_passages(evidence: DataFrame, snapshots: DataFrame, passages: DataFrame) -> DataFrame:
    """distinct passages with accepted evidence whose snapshot was fetched and is the passage's own."""
    accepted = evidence.where(F.size("rejection_reasons") == 0).select("run_id", "passage_id").distinct()
    fetched = snapshots.where("access_status = 'FETCHED'").select("run_id", "snapshot_id", "source_ref")
    return passages.join(accepted, ["run_id", "passage_id"], "left_semi").join(fetched, ["run_id", "snapshot_id", "source_ref"], "left_semi")


def partial_citation_penalty(sentences: DataFrame) -> DataFrame:
    """5 for each partially entailed sentence, 20 at most, off the support; 7 and 25 off the confidence."""
    k = F.countDistinct(F.when(F.col("entailment") == "partial", F.col("sentence_id")))
    return sentences.groupBy("run_id").agg(F.least(F.lit(20), 5 * k).alias("support_penalty"), F.least(F.lit(25), 7 * k).alias("confidence_penalty"))


def by_stance(evidence: DataFrame, by: list[str]) -> DataFrame:
    """The passages of each key as supporting, contradicting, neutral and invalid lists."""
    kind = F.when(F.size("rejection_reasons") > 0, "invalid").when(F.col("stance").endswith("supports"), "supporting").when(F.col("stance").endswith("contradicts"), "contradicting").otherwise("neutral")
    return evidence.withColumn("kind", kind).groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("items"), F.array_sort(F.collect_list("passage_id")).alias("passages"))


def latest_scores(calculations: DataFrame) -> DataFrame:
    """The latest result of each run and formula. calculations: run_id, formula_name, result, created_at, calculation_id."""
    return calculations.groupBy("run_id", "formula_name").agg(F.max_by("result", F.struct("created_at", "calculation_id")).alias("result"))
