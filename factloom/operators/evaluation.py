"""Evaluation of predictions against expectations (A26 to A35, G11, AJ8).

Cases: id, expected and predicted structs (FIXTURES.md, A8). Every metric is an aggregate over one row for each case, or over
its exploded fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import share

#: The verdict classes.
LABELS = ["supported", "contradicted", "mixed", "insufficient"]


def six(c: Column) -> Column:
    return F.bround(c, 6)


def accuracy(expected: Column, predicted: Column) -> Column:
    """Over rows with an expectation."""
    return F.coalesce(F.avg(F.when(expected.isNotNull(), F.equal_null(expected, predicted).cast("double"))), F.lit(0.0))


def field_checks(expected: Column, predicted: Column) -> Column:
    """For two maps, an array of 1 and 0 over the union of their keys; a missing field is wrong."""
    none = F.create_map().cast("map<string,string>")
    e, p = F.coalesce(expected, none), F.coalesce(predicted, none)
    return F.transform(F.array_union(F.map_keys(e), F.map_keys(p)), lambda k: F.equal_null(F.try_element_at(e, k), F.try_element_at(p, k)).cast("int"))


def mapping_accuracy(expected: Column, predicted: Column) -> Column:
    """A28, an aggregate: 1 where there is nothing to check."""
    c = field_checks(expected, predicted)
    return F.coalesce(F.try_divide(F.sum(F.aggregate(c, F.lit(0), lambda a, x: a + x)), F.sum(F.size(c)).cast("double")), F.lit(1.0))


def micro_precision_recall(expected: Column, predicted: Column) -> tuple[Column, Column]:
    """A29 over arrays of ids: 1 where nothing is predicted or expected."""
    none = F.array().cast("array<string>")
    e, p = F.array_distinct(F.coalesce(expected, none)), F.array_distinct(F.coalesce(predicted, none))
    tp = F.sum(F.size(F.array_intersect(e, p))).cast("double")
    return F.coalesce(F.try_divide(tp, F.sum(F.size(p))), F.lit(1.0)), F.coalesce(F.try_divide(tp, F.sum(F.size(e))), F.lit(1.0))


def macro_f1(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """The mean F1 of the classes that are expected somewhere. One aggregate by (expected, predicted), then by class."""
    pairs = df.groupBy(F.col(expected).alias("e"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array_distinct(F.array("e", "p"))).alias("label"), "e", "p", "n").where("label is not null")
    by = sides.groupBy("label").agg(
        F.sum(F.when((F.col("e") == F.col("label")) & (F.col("p") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("all"),
        F.max((F.col("e") == F.col("label")).cast("int")).alias("present"),
    )
    return by.where("present = 1").agg(F.avg(share(2 * F.col("tp"), F.col("tp") + F.col("all"))).alias("macro_f1"))


def cluster_pairs(df: DataFrame, case: str, cluster: str, member: str) -> DataFrame:
    """The pairs of members of each cluster, smaller first."""
    a = df.select(case, cluster, F.col(member).alias("x"))
    b = df.select(case, cluster, F.col(member).alias("y"))
    return a.join(b, [case, cluster]).where("x < y").select(case, "x", "y").distinct()


def _f1(e: DataFrame, p: DataFrame, both: DataFrame) -> DataFrame:
    """From tables of sizes (count): of expected clusters, predicted ones and their intersections."""
    pairs = lambda df, n: df.agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0)).alias(n))
    total = pairs(e, "e").join(pairs(p, "p"), F.lit(True)).join(pairs(both, "tp"), F.lit(True))
    return total.select(F.coalesce(F.try_divide(2 * F.col("tp"), F.col("e") + F.col("p")), F.lit(1.0)).alias("cluster_f1"))


def cluster_f1(expected: DataFrame, predicted: DataFrame, case: str) -> DataFrame:
    """A31 without making pairs: their numbers follow from the sizes of clusters and of their intersections. Both: case,
    cluster, member, a member in one cluster of each side."""
    size = lambda df: df.groupBy(case, "cluster").count()
    both = expected.withColumnRenamed("cluster", "ec").join(predicted.withColumnRenamed("cluster", "pc"), [case, "member"]).groupBy(case, "ec", "pc").count()
    return _f1(size(expected), size(predicted), both)


def cluster_f1_of(members: DataFrame, case: str, member: str, expected: str, predicted: str) -> DataFrame:
    """As cluster_f1(), of one table that has a member's cluster of both sides; nothing is joined or sorted.
    Sizes of clusters are sums of those of intersections."""
    each = members.select(case, member, expected, predicted).distinct()
    both = each.where(F.col(expected).isNotNull() & F.col(predicted).isNotNull()).groupBy(case, expected, predicted).count()
    sides = each.groupBy(case, expected, predicted).count()
    size = lambda c: sides.groupBy(case, c).agg(F.sum("count").alias("count")).where(F.col(c).isNotNull())
    return _f1(size(expected), size(predicted), both)


def brier(expected: Column, predicted: Column, confidence: Column, probabilities: Column | None = None) -> Column:
    """A32, for each row: mean squared error over the classes where probabilities are given, else of the confidence."""
    plain = F.pow(confidence - F.equal_null(expected, predicted).cast("double"), 2)
    if probabilities is None:
        return plain
    terms = [F.pow(F.coalesce(F.try_element_at(probabilities, F.lit(x)), F.lit(0.0)) - F.equal_null(expected, F.lit(x)).cast("double"), 2) for x in LABELS]
    return F.when(probabilities.isNotNull(), sum(terms[1:], terms[0]) / len(LABELS)).otherwise(plain)


def calibration_error(expected: Column, predicted: Column, confidence: Column) -> Column:
    """A33, an aggregate."""
    return F.avg(F.abs(confidence - F.equal_null(expected, predicted).cast("double")))


def p95(column: str) -> Column:
    """A34, an aggregate: nearest rank."""
    return F.expr(f"percentile_disc(0.95) within group (order by {column})")


def evaluate(cases: DataFrame) -> DataFrame:
    """One row of all metrics at six places. cases: id, expected.*, predicted.* as in FIXTURES.md."""
    e, p = (lambda f: F.col(f"expected.{f}")), (lambda f: F.col(f"predicted.{f}"))
    ep, er = micro_precision_recall(e("evidence_ids"), p("evidence_ids"))
    _, pr = micro_precision_recall(e("required_passage_ids"), p("required_passage_ids"))
    up, _ = micro_precision_recall(e("relevant_url_ids"), p("relevant_url_ids"))
    _, sr = micro_precision_recall(e("primary_source_ids"), p("primary_source_ids"))
    z = lambda f: F.coalesce(p(f), F.lit(0)).cast("double")
    one = cases.agg(
        six(accuracy(e("verdict"), p("verdict"))).alias("verdict_accuracy"),
        six(mapping_accuracy(e("attribution"), p("attribution"))).alias("attribution_accuracy"),
        six(ep).alias("evidence_precision"), six(er).alias("evidence_recall"), six(pr).alias("passage_recall"),
        six(mapping_accuracy(e("citation_entailment"), p("citation_entailment"))).alias("citation_entailment"),
        six(up).alias("url_relevance_precision"),
        six(mapping_accuracy(e("extracted_fields"), p("extracted_fields"))).alias("extraction_fidelity"),
        six(mapping_accuracy(e("numerical_checks"), p("numerical_checks"))).alias("numerical_accuracy"),
        six(sr).alias("primary_source_recall"),
        six(calibration_error(e("verdict"), p("verdict"), z("confidence"))).alias("confidence_calibration_error"),
        six(F.avg(brier(e("verdict"), p("verdict"), z("confidence"), p("verdict_probabilities")))).alias("confidence_brier_score"),
        six(F.coalesce(F.try_divide(F.sum(z("unsupported_statement_count")), F.sum(z("statement_count"))), F.lit(0.0))).alias("unsupported_statement_rate"),
        six(F.avg(z("latency_seconds"))).alias("mean_latency_seconds"),
        six(F.avg(z("cost_usd"))).alias("mean_cost_per_verification_usd"),
        six(F.sum(z("cost_usd"))).alias("total_cost_usd"),
    )
    late = cases.select(z("latency_seconds").alias("s")).agg(p95("s").alias("p95_latency_seconds"))

    def members(side: str) -> DataFrame:
        c = cases.select("id", F.posexplode(f"{side}.duplicate_clusters").alias("cluster", "m"))
        return c.select("id", "cluster", F.explode(F.array_distinct("m")).alias("member"))

    f1 = cluster_f1(members("expected"), members("predicted"), "id").select(six(F.col("cluster_f1")).alias("duplicate_clustering_f1"))
    macro = macro_f1(cases.select(e("verdict").alias("x"), p("verdict").alias("y")), "x", "y").select(six(F.coalesce("macro_f1", F.lit(0.0))).alias("verdict_macro_f1"))
    return one.join(late, F.lit(True)).join(f1, F.lit(True)).join(macro, F.lit(True))  # one row each


def batches(df: DataFrame, order: list[str], size: int, by: list[str]) -> DataFrame:
    """AJ8: rows of each key in batches of `size`, numbered from 0."""
    from pyspark.sql import Window

    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))


def case_violations(cases: DataFrame) -> DataFrame:
    """IO25, IO26: (code, n) of repeated and missing ids."""
    ids = cases.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return ids.agg(F.count_if(F.col("id").isNull() | (F.trim("id") == "")).alias("EMPTY_ID"), F.count_if(F.col("n") > 1).alias("DUPLICATE_ID")).selectExpr("stack(2, 'EMPTY_ID', EMPTY_ID, 'DUPLICATE_ID', DUPLICATE_ID) as (code, n)").where("n > 0")
