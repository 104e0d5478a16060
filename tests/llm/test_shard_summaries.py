"""Cuts from summaries of any coarseness equal those of the greedy walk over all atoms."""

import random
from itertools import accumulate

import pytest

from factloom.llm import shards


def greedy(sizes, capacity):
    ends, room = [], 0
    for i, s in enumerate(sizes):
        if s > room and i:
            ends.append(sum(sizes[:i]))
            room = capacity
        room = (capacity if not i else room) - s
    return ends


@pytest.mark.parametrize(("n", "parts", "buckets", "hot"), [(60, 7, 4, 0), (300, 24, 50, 9000), (40, 1, 8, 0), (5, 24, 100, 0), (200, 24, 10_000, 0)])
def test_cuts_equal_the_greedy_walk(spark, n, parts, buckets, hot):
    rng = random.Random(n)
    sizes = [rng.randrange(8, 400) for _ in range(n)]
    if hot:
        sizes[n // 3] = hot
    want = next(c for c in range(max(sizes), sum(sizes) + 1) if len(greedy(sizes, c)) < parts)
    df = spark.createDataFrame([(u,) for u in accumulate(sizes)], "upto long")
    assert shards.cut_points(df, sum(sizes), max(sizes), parts, buckets) == greedy(sizes, want)
