"""Table expectations: rows that break a rule (F16, F21, section 1.3 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: list[str], **rules: Column) -> DataFrame:
    """(key, rule) for each rule that a row breaks. A rule that is null for a row holds. One scan."""
    broken = F.filter(F.array(*[F.when(~r, n) for n, r in rules.items()]), lambda x: x.isNotNull())
    return df.select(*key, F.explode(broken).alias("rule"))


def counts(df: DataFrame, **rules: Column) -> DataFrame:
    """(rule, n) for every rule, also those that hold; one aggregate."""
    sums = df.agg(*[F.count_if(~r).alias(n) for n, r in rules.items()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])))


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unit(c: str) -> Column:
    return F.col(c).between(0, 1)


def score(c: str) -> Column:
    return F.col(c).between(0, 100)


def one_of(c: str, values: list[str]) -> Column:
    return F.col(c).isin(values)


def offsets(start: str, end: str) -> Column:
    """Both null or both set, the end not before the start."""
    s, e = F.col(start), F.col(end)
    return (s.isNull() & e.isNull()) | F.coalesce(e >= s, F.lit(False))


def importance(name: str, weight: str) -> Column:
    return F.col(weight) == F.when(F.col(name) == "essential", 3).when(F.col(name) == "major", 2).when(F.col(name) == "minor", 1)


def scoring_inputs(evidence: DataFrame, claims: DataFrame, multipliers: DataFrame) -> DataFrame:
    """(code, n) of missing inputs and unknown multipliers."""
    rows = [("NO_CLAIMS", claims.isEmpty()), ("NO_EVIDENCE", evidence.isEmpty())]
    bad = multipliers.agg(F.lit("UNKNOWN_MULTIPLIER").alias("code"), F.count_if(F.col("multiplier").isNull() | ~F.col("multiplier").isin(0.0, 0.10, 0.35, 1.0)).alias("n"))
    for code, missing in rows:
        if missing:
            bad = bad.unionByName(bad.limit(1).select(F.lit(code).alias("code"), F.lit(1).cast("long").alias("n")))
    return bad.where("n > 0")
