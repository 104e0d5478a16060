"""Cover density where lower case, rounding or the order of additions could part equal texts and scores."""

from functools import reduce
from operator import add

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from factloom.operators import postings as PO
from factloom.plans import graph_queries as G
from pyspark.sql import functions as F


def _text(noise):
    return "x " + " ".join(f"{'n ' * n}{'yx'[i % 2]}" for i, n in enumerate(noise))


def test_equal_scores_rank_by_creation_whatever_the_order_of_covers(spark):
    less, more = (0, 2, 5), (5, 2, 0)
    assert 0.1 / 1 + 0.1 / 3 + 0.1 / 6 < 0.1 / 6 + 0.1 / 3 + 0.1 / 1
    passages = spark.createDataFrame([(1, _text(less), 0), (2, _text(more), 1)], "doc long, text string, at int")
    claims = spark.createDataFrame([(7, "x y")], "item long, text string")
    assert [r["doc"] for r in PO.cover_shortlist(claims, passages, ("item", "text"), ("doc", "text", "at"), 2).orderBy("rank").collect()] == [1, 2]


def test_words_fold_character_by_character(spark):
    df = spark.createDataFrame([("ΟΔΟΣ İz Straße",)], "t string")
    assert df.select(PO.words_of(F.col("t"))).first()[0] == ["οδοσ", "iz", "straße"]


def test_scores_round_as_in_sql(spark, tmp_path):
    # the shortest decimal of these sums and the scaled double round apart at nine places
    noises = [(0, 3, 511), (3, 0, 511), (4, 9, 511)]
    sums = [reduce(add, (0.1 / (1 + n) for n in o)) for o in noises]  # sum() would correct what doubles lose
    texts = [_text(o) for o in noises]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [0], "text": ["x y"]}), tmp_path / "benchmark.parquet")
    got = {r["doc_id"]: r["score"] for r in G.cover_density_shortlist(spark, str(tmp_path)).collect()}
    # the same additions, in the order of the text
    assert got == {n: duckdb.sql(f"SELECT round({sums[n]!r}::DOUBLE, 9)").fetchall()[0][0] for n in range(len(noises))}
