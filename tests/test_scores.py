"""Scores at ties and at thresholds of labels."""

from factloom.functions import labels as L
from factloom.operators import scoring as S
from pyspark.sql import functions as F


def test_a_tie_is_rounded_as_sql_rounds(spark):
    x = [1.005, 2.5, -0.125, 0.285]  # 1.005 * 100 is 100.49999999999999, 0.285 * 100 is 28.499999999999996
    got = spark.createDataFrame([(v,) for v in x], "v double").select(L.half_away(F.col("v"), 2)).collect()
    assert [r[0] for r in got] == [1.0, 2.5, -0.13, 0.28]


def test_noise_of_doubles_moves_no_run_across_a_threshold(spark):
    none = F.array().cast("array<string>")
    claims = spark.createDataFrame([(1, 99.99999999999999), (2, 99.99999999999999), (3, 99.99999999999999), (4, 0.0)], "claim_ref int, support double").select(
        F.lit(1).alias("run_id"), "claim_ref", "support", F.lit("essential").alias("importance"), F.lit(1).alias("importance_weight"), F.lit(True).alias("checkable"), F.lit("factual").alias("claim_kind"), F.lit(False).alias("has_period"),
        F.lit(100.0).alias("context"), F.lit(True).alias("adequate"), F.lit(90.0).alias("confidence"), none.alias("confidence_issues"),
    )
    evidence = [("strongly_supports", 2), ("strongly_supports", 3)]
    rows = spark.createDataFrame(evidence, "stance string, s long").select(
        F.lit(1).alias("run_id"), F.lit(1).alias("claim_ref"), F.col("s").alias("source_ref"), F.lit(1).cast("decimal(28,12)").alias("up"), F.lit(0).cast("decimal(28,12)").alias("down"), F.lit(1).alias("n"), F.lit(1).cast("decimal(20,10)").alias("qw"), F.lit(1).cast("decimal(20,10)").alias("w"),
        none.alias("context_issues"), none.alias("confidence_issues"), F.lit("PRIMARY").alias("source_type"), F.col("s").alias("origin"), F.col("s").cast("string").alias("organization"), F.col("s").alias("data_chain"), F.lit(True).alias("independent"),
    )
    r = S.run_scores(claims, rows).first()
    assert (r["accuracy"], r["label"]) == (75.0, "Mostly supported")
