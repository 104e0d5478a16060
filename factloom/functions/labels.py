"""Scores, labels and gates over decimals (A1 to A14 and M11 to M21 as expressions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lookup

# The methodology's weights, penalties and thresholds.
QUALITY_WEIGHTS = {"relevance": "0.25", "directness": "0.20", "authority": "0.20", "transparency": "0.15", "temporal_fit": "0.10", "certainty": "0.10"}
CONFIDENCE_WEIGHTS = {"coverage": "0.30", "average_quality": "0.25", "independence": "0.20", "consistency": "0.15", "primary_access": "0.10"}
INDEPENDENCE_WEIGHTS = {"origins": "0.40", "primary_sources": "0.25", "organizations": "0.20", "methods": "0.15"}
QUOTE_WEIGHTS = {"wording": "0.35", "speaker_identity": "0.20", "completeness": "0.20", "sequence_integrity": "0.15", "translation_accuracy": "0.10"}
STANCE_VALUES = {"strongly_contradicts": -1.0, "partially_contradicts": -0.5, "neutral": 0.0, "partially_supports": 0.5, "strongly_supports": 1.0}
CONTEXT_PENALTIES = {
    "key_term_undefined": 20, "date_range_omitted": 15, "baseline_or_denominator_omitted": 20, "relative_without_absolute": 15, "correlation_as_causation": 25,
    "material_qualifier_omitted": 15, "incomparable_groups": 20, "unit_or_measure_changed": 20, "surrounding_quote_changes_meaning": 25, "conditional_language_removed": 25,
    "adjacent_sentence_omitted": 20, "scope_omitted": 15, "speaker_quoting_another": 25, "nonliteral_presented_literally": 25, "question_as_assertion": 20,
    "translation_qualifier_removed": 20, "edit_hides_correction": 25,
}
CONFIDENCE_PENALTIES = {
    "essential_term_ambiguous": 10.5, "speaker_or_date_unresolved": 10.0, "primary_evidence_unavailable": 0.0, "major_contradiction_unresolved": 15.0, "single_information_cluster": 15.0,
    "important_source_inaccessible": 5.0, "translation_uncertain": 10.0, "edited_media_unauthenticated": 15.0, "developing_event_low": 5.0, "developing_event_high": 7.5,
}
PRIORITY_WEIGHTS = {"relevance": "0.30", "directness": "0.20", "temporal_fit": "0.15", "diversity": "0.15", "novelty": "0.10", "extractability": "0.10"}
DEPTHS = {"QUICK": (8, 14, 25, 4, 3, 2), "STANDARD": (18, 30, 51, 6, 5, 3), "DEEP": (36, 64, 101, 8, 8, 4)}
DEPTH_LIMITS = {"QUICK": 5, "STANDARD": 10, "DEEP": 20}
SUPPORT_STEPS = [(90, "Supported"), (75, "Mostly supported"), (60, "Leaning supported"), (40, "Mixed"), (26, "Leaning contradicted"), (11, "Mostly contradicted")]
CONFIDENCE_STEPS = [(85, "Very high"), (70, "High"), (50, "Moderate"), (30, "Low")]


def dec(x: str | float, scale: int = 4) -> Column:
    return F.lit(x).cast(f"decimal(8,{scale})")


def weighted(weights: dict[str, str], values: dict[str, Column]) -> Column:
    """Sum of weight * value; a decimal where the values are."""
    return reduce(lambda a, b: a + b, [dec(w, 2) * values[k] for k, w in weights.items()])


def evidence_quality(**components: Column) -> Column:
    """A1: null where a component is out of [0, 1]. Hundredths times millionths are whole numbers, so the sum is exact in longs."""
    inside = reduce(lambda a, b: a & b, [c.between(0, 1) for c in components.values()])
    parts = [F.lit(int(QUALITY_WEIGHTS[k].replace("0.", ""))) * (c.cast("decimal(8,6)") * 1_000_000).cast("long") for k, c in components.items()]
    return F.when(inside, (reduce(lambda a, b: a + b, parts).cast("decimal(10,0)") * F.lit("0.00000001").cast("decimal(8,8)")).cast("decimal(10,8)"))


def support(p: Column, n: Column) -> Column:
    """A4, null without weight."""
    return F.try_divide(100 * p, p + n)


def consistency(p: Column, n: Column) -> Column:
    """A5, null without weight."""
    return F.try_divide(100 * F.abs(p - n), p + n)


def percent(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c.cast("double")))


def half_away(c: Column, places: int) -> Column:
    """A double at so many places, as SQL rounds: the scaled double decides a tie, not the shortest decimal that names it."""
    return F.round(c * 10.0**places) / 10.0**places


def verdict_confidence(penalties: Column, **parts: Column) -> Column:
    """A6."""
    return percent(reduce(lambda a, b: a + b, [F.lit(float(w)) * parts[k].cast("double") for k, w in CONFIDENCE_WEIGHTS.items()]) - penalties)


def source_independence(**parts: Column) -> Column:
    """A7."""
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * parts[k].cast("double") for k, w in INDEPENDENCE_WEIGHTS.items()])


def diversity_part(count: Column) -> Column:
    """50 for each, 100 at most."""
    return F.least(F.lit(100), 50 * count)


def quote_fidelity(**parts: Column) -> Column:
    """The weight of a missing translation goes to the others."""
    used = [(F.lit(float(QUOTE_WEIGHTS[k])), c.cast("double")) for k, c in parts.items()]
    top = reduce(lambda a, b: a + b, [F.coalesce(w * c, F.lit(0.0)) for w, c in used])
    return F.try_divide(top, reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for w, c in used]))


def penalty_sum(issues: Column, table: dict) -> Column:
    """Of the distinct issues of an array."""
    return F.aggregate(F.array_distinct(issues), F.lit(0.0), lambda a, x: a + lookup(x, {k: float(v) for k, v in table.items()}, 0.0))


def context_completeness(issues: Column) -> Column:
    """A10."""
    return percent(100 - penalty_sum(issues, CONTEXT_PENALTIES))


def safe_ratio(a: Column, b: Column) -> Column:
    """A22."""
    return F.coalesce(F.bround(F.try_divide(a.cast("double"), b.cast("double")), 6), F.lit(0.0))


def weighted_average(value: Column, weight: Column) -> Column:
    """A13, an aggregate: null without weight."""
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def rounded_score(c: Column) -> Column:
    """M11."""
    return F.round(c, 0).cast("int")


def _steps(c: Column, steps: list[tuple[int, str]], last: str) -> Column:
    out = F.when(c.isNull(), None)
    for least, name in steps:
        out = out.when(c >= least, name)
    return out.otherwise(last)


def support_label(c: Column) -> Column:
    """M12."""
    return _steps(c, SUPPORT_STEPS, "Contradicted")


def confidence_label(c: Column) -> Column:
    """M13."""
    return _steps(c, CONFIDENCE_STEPS, "Very low")


def insufficient_label(c: Column) -> Column:
    """M14."""
    return F.when(c.isNull(), "Insufficient evidence").when(c >= 60, "Insufficient evidence: leans supported").when(c < 40, "Insufficient evidence: leans contradicted").otherwise("Insufficient evidence: mixed")


def insufficiency_reasons(below_minimum: Column, no_essential: Column, single_interested: Column, unresolved: Column) -> Column:
    """M17."""
    names = ["total_adjusted_evidence_below_minimum", "no_essential_claim_has_adequate_evidence", "single_interested_source_cannot_be_independently_checked", "key_definitions_dates_or_identities_unresolved"]
    return F.filter(F.array(*[F.when(c, n) for c, n in zip((below_minimum, no_essential, single_interested, unresolved), names, strict=True)]), lambda x: x.isNotNull())


def claim_label(support_: Column, confidence: Column, context: Column, insufficient: Column) -> Column:
    """M15."""
    return (
        F.when(support_.isNull() | (confidence < 35) | insufficient, insufficient_label(support_))
        .when((support_ >= 70) & (context < 50), "Technically supported but misleading")
        .otherwise(support_label(support_))
    )


def article_label(accuracy: Column, confidence: Column, context: Column, insufficient: Column, refuted: Column) -> Column:
    """M16."""
    label = claim_label(accuracy, confidence, context, insufficient)
    return F.when(refuted & (label == "Supported"), "Mostly supported").otherwise(label)


def ambiguity_non_blocking(owned: Column, adequate: Column, support_: Column, p: Column, n: Column) -> Column:
    """Owned, adequate, supported by 70, and at most 0.15 of contradiction for what supports."""
    ratio = F.when(p > 0, n.cast("double") / p.cast("double")).otherwise(1.0)
    return owned & adequate & F.coalesce(support_ >= 70, F.lit(False)) & (ratio <= 0.15)


def stance_value(stance: Column) -> Column:
    """M19."""
    return lookup(stance, STANCE_VALUES)


def priority_score(**signals: Column) -> Column:
    """Half-even at four places; null out of [0, 1]."""
    inside = reduce(lambda a, b: a & b, [c.between(0, 1) for c in signals.values()])
    return F.when(inside, F.bround(weighted(PRIORITY_WEIGHTS, {k: c.cast("decimal(10,6)") for k, c in signals.items()}), 4))


def search_budget(depth: Column, claims: Column, attribution: Column) -> Column:
    """A struct of mandatory floor, total budget (null above the ceiling) and phase-one limit."""
    part = lambda i: lookup(depth, {k: v[i] for k, v in DEPTHS.items()})
    floor = 2 * claims + attribution.cast("int")
    total = F.when(floor <= part(2), F.greatest(part(0) + part(1), floor))
    return F.struct(floor.alias("mandatory_floor"), total.alias("total"), F.least(total, F.greatest(part(0), floor)).alias("phase_one"))


def lite_stance(stance: Column, confidence: Column) -> Column:
    """M23."""
    strong = confidence >= 0.75
    return (
        F.when((stance == "supports") & strong, "strongly_supports").when(stance == "supports", "partially_supports")
        .when((stance == "contradicts") & strong, "strongly_contradicts").when(stance == "contradicts", "partially_contradicts").otherwise("neutral")
    )
