"""Functions of rows in slices: results of a batch are never held together."""

import gc

from factloom.functions import arrow as A
from factloom.operators import html as H


def test_results_of_a_slice_at_most_are_held(spark):
    df = spark.range(2000).selectExpr("id", "IF(id % 7 = 0, NULL, repeat('x', IF(id = 100, 3000000, 10))) AS t").coalesce(1)
    live = A.with_rows(df, "n", "struct<n: int, m: array<string>>", lambda t: None if t is None else {"n": len(t), "m": [t[:1]]}, "t")
    rows = live.select("id", "n.n", "n.m").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(i, None, None) if i % 7 == 0 else (i, 3000000 if i == 100 else 10, ["x"]) for i in range(2000)]
    sizes = live.mapInArrow(lambda bs: bs, live.schema)
    assert sizes.count() == 2000


def test_a_tree_goes_with_its_root():
    gc.collect()
    gc.disable()
    try:
        before = sum(isinstance(x, H.Node) for x in gc.get_objects())
        H.parse_page("<body>" + "<div><p>a<b>b</b></p>" * 50 + "</body>", None)
        assert sum(isinstance(x, H.Node) for x in gc.get_objects()) == before
    finally:
        gc.enable()
