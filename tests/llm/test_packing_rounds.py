"""Exchanges go on until the bounds certify the packing, or save nothing."""

import random

from factloom.llm import best_fit_packing


def test_many_small_partitions_reach_the_bound_or_stop(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("word" for _ in range(rng.choice([3, 5, 20, 31])))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = best_fit_packing.tokenizer_path()
    got = best_fit_packing.pack(docs, path, size=64, group=12).cache()
    assert got.count() >= 240 and got.select("doc_id", "piece").distinct().count() == got.count()
    bins, bound = best_fit_packing.certificate(got, 64)
    whole, same = best_fit_packing.certificate(best_fit_packing.pack(docs, path, size=64, group=10_000), 64)
    assert bound == same <= whole <= bins <= whole + 3
    over = got.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 64")
    assert over.isEmpty()
