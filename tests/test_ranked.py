"""Best passages by shared terms, in the passages' tasks and by walked postings, against all pairs."""

from collections import Counter

import numpy as np
import pytest

from factloom.operators import ranked as K
from factloom.operators import retrieval as R


def brute(claims, passages, k, wanted=(), sets=False):
    out = {}
    for c, a in claims.items():
        a = list(dict.fromkeys(a)) if sets else a
        score = {p: sum((Counter(a) & Counter(dict.fromkeys(b, 1) if sets else b)).values()) / len(a) for p, b in passages.items()} if a else {}
        score = {p: s for p, s in score.items() if s > 0}
        best = sorted(score, key=lambda p: (-score[p], p))[:k]
        out |= {(c, p): score[p] for p in [*best, *(p for x, p in wanted if x == c and p in score)]}
    return out


def words(rng, n):
    """Few words are very frequent, most are rare."""
    return [f"w{min(int(x), 400)}." for x in rng.zipf(1.3, n)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    claims = {i: words(rng, int(rng.integers(1, 25))) for i in range(40)} | {40: [], 41: ["unheard"], 42: ["w1."] * 5, 43: ["w1.", "w2.", "w3."]}
    passages = {i: words(rng, int(rng.integers(0, 120))) for i in range(300)} | {300: [], 301: ["w1."] * 400, 302: ["w1."] * 400}
    wanted = [(3, 7), (5, 300), (41, 2), (42, 9), (43, 250), (43, 250)]
    return claims, passages, wanted


def frames(spark, data):
    claims, passages, wanted = data
    c = spark.createDataFrame([(i, " ".join(t), "x") for i, t in claims.items()] + [(99, None, "x")], "item int, text string, score string")
    p = spark.createDataFrame([(i, " ".join(t), 1) for i, t in passages.items()] + [(999, None, 1)], "doc long, text string, n int").repartition(5)
    return c, p, spark.createDataFrame(wanted, "item int, doc long")


def top(rows, column, k, wanted):
    """More than the k best may come, and wanted pairs that share nothing."""
    out = {}
    for c in {r["item"] for r in rows}:
        assert len({r["doc"] for r in rows if r["item"] == c}) == sum(r["item"] == c for r in rows)
        mine = {r["doc"]: r[column] for r in rows if r["item"] == c and r[column]}
        out |= {(c, p): mine[p] for p in [*sorted(mine, key=lambda p: (-mine[p], p))[:k], *(p for x, p in wanted if x == c and p in mine)]}
    return out


@pytest.mark.parametrize("most", [2_000, 3])
@pytest.mark.parametrize("k", [1, 4, 50])
def test_scores_equal_all_pairs(spark, monkeypatch, data, most, k):
    monkeypatch.setattr(R, "MOST_CLAIMS", most)
    claims, passages, wanted = data
    c, p, w = frames(spark, data)
    assert top(R.lexical_scores(c, p, ("item", "text"), ("doc", "text"), k, w).collect(), "lexical", k, wanted) == brute(claims, passages, k, wanted)
    assert top(R.overlap_scores(c, p, ("item", "text"), ("doc", "text"), k).collect(), "overlap", k, ()) == brute(claims, passages, k, sets=True)


@pytest.mark.parametrize("most", [2_000, 3])
def test_without_k_all_pairs_are_scored(spark, monkeypatch, data, most):
    monkeypatch.setattr(R, "MOST_CLAIMS", most)
    c, p, _ = frames(spark, data)
    got = {(r["item"], r["doc"]): r["lexical"] for r in R.lexical_scores(c, p, ("item", "text"), ("doc", "text")).collect() if r["lexical"]}
    assert got == brute(data[0], data[1], 10**6)


def test_hot_terms_in_lanes_and_empty_tables(spark, monkeypatch, data):
    monkeypatch.setattr(R, "MOST_CLAIMS", 0)
    monkeypatch.setattr(K, "LANE", 16)
    c, p, _ = frames(spark, data)
    ask = lambda a, b: R.lexical_scores(a, b, ("item", "text"), ("doc", "text"), 4)
    assert {(r["item"], r["doc"]): r["lexical"] for r in ask(c, p).collect()} == brute(data[0], data[1], 4)
    assert ask(c.limit(0), p).count() == ask(c, p.limit(0)).count() == 0


def test_frequent_terms_are_not_walked(spark, monkeypatch):
    """A term that all passages have never meets its postings where rarer ones fill the list."""
    claims = spark.createDataFrame([(1, ["rare", "odd", "the"])], "c int, t array<string>")
    met, plain = [], type(claims).join
    rows = [(i, ["the"] + (["rare", "odd"] if i % 100 == 0 else [])) for i in range(1000)]
    passages = spark.createDataFrame(rows, "p int, t array<string>")

    def watched(self, other, *a, **k):
        out = plain(self, other, *a, **k)
        if a and a[0] == ["term", "lane"]:
            met.append({r["term"] for r in out.select("term").distinct().collect()})
        return out

    monkeypatch.setattr(type(claims), "join", watched)
    got = K.best_shared(claims, passages, ("c", K.F.col("t")), ("p", K.F.col("t")), 5).collect()
    assert sorted((r["p"], r["score"]) for r in got) == [(i, 1.0) for i in (0, 100, 200, 300, 400)]
    assert met and all("the" not in terms for terms in met)
