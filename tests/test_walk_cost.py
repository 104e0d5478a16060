"""What a walk of postings costs: texts are folded as a whole, and few claims travel to the postings."""

import time

from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import ranked as K


def test_texts_with_sharp_s_fold_as_a_whole(spark):
    df = spark.createDataFrame([("Straße “groß” – " * 60_000,)], "t string").cache()

    def seconds(c):
        took = []
        for _ in range(3):
            began = time.time()
            df.select(F.xxhash64(c)).collect()
            took.append(time.time() - began)
        return min(took)

    assert df.select(X.fold(F.col("t")) == "strasse “gross” – " * 60_000).first()[0]
    assert seconds(F.size(F.filter(F.array(X.fold(F.col("t"))), lambda x: x != ""))) < 8 * seconds(F.lower("t")) + 0.2


def test_fold_equals_python(spark):
    chars = [chr(i) for i in range(0x2FFF) if chr(i).lower() == chr(i) != chr(i).casefold()] + list("ꭰꮿﬀﬆﬓﬗ")
    texts = ["", "plain", "É", *chars, *(f"groß {x}–{x}" for x in chars), "".join(chars)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.fold(F.col("t")).alias("f")).collect()
    assert {r["i"]: r["f"] for r in got} == {i: t.casefold() for i, t in enumerate(texts)}


def test_postings_stay_where_they_are_for_few_claims(spark):
    claims = spark.createDataFrame([(1, ["rare", "odd", "the"]), (2, ["odd", "the", "the"])], "c int, t array<string>")
    passages = spark.createDataFrame([(i, ["the"] * (1 + i % 2) + (["rare", "odd"] if i % 100 == 0 else [])) for i in range(1000)], "p int, t array<string>")
    out = K.best_shared(claims, passages, ("c", F.col("t")), ("p", F.col("t")), 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join [__p#" in plan and "SortMergeJoin [__p#" not in plan and "ShuffledHashJoin [__p#" not in plan
    assert sorted((r["c"], r["p"], round(r["score"], 6)) for r in out.collect()) == [(1, p, 1.0) for p in (0, 100, 200, 300, 400)] + [(2, p, 0.666667) for p in (0, 1, 3, 5, 7)]
