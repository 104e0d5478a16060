"""Hard negatives, whitening and token counts against brute force, with the cases that their docstrings define."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import hard_negatives, token_counts, whitening
from factloom.llm.best_fit_packing import tokenizer_path

V = "vec_id long, embedding array<double>, label int, row string, score long"


def rows_of(x, labels, first=0):
    return [(first + i, v.tolist(), int(l), "x", 1) for i, (v, l) in enumerate(zip(x, labels, strict=True))]


def odd_vectors(width):
    """Null ids and labels, null and non-finite components, short and empty vectors, a row that comes twice."""
    x = [0.25] * width
    return [(None, x, 1, None, 0), (900, None, 1, "", 0), (901, [*x[1:], None], 1, "", 0), (902, [*x[1:], float("nan")], 2, "", 0), (903, [*x[1:], float("-inf")], 2, "", 0), (904, x, None, "", 0), (905, x[:3], 1, "", 0), (906, [], 2, "", 0), (300, x, 1, "", 0), (300, x, 1, "", 0)]


def brute_negatives(rows, every, pos=5, neg=10):
    width = max(len(v) for _, v, l, *_ in rows if v is not None)
    x, kept = [], []
    for i, v, l, *_ in rows:
        if v is None or l is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        x.append([int(np.floor(256 * c)) for c in v] + [0] * (width - len(v)))
        kept.append((i, l))
    x, out = np.array(x, np.int64), []
    small = lambda i: -(1 << 62) if i is None else i
    for a, (i, l) in enumerate(kept):
        if i is None or i % every:
            continue
        s = x @ x[a]
        order = sorted((j for j in range(len(kept)) if kept[j][0] != i), key=lambda j: (-s[j], small(kept[j][0])))
        for p in [j for j in order if kept[j][1] == l][:pos]:
            found = [j for j in order if kept[j][1] != l and 30 * s[p] <= 100 * s[j] <= 90 * s[p]][:neg]
            out += [(i, kept[p][0], r + 1, kept[j][0], int(s[p]), int(s[j])) for r, j in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "query_block", "nearest", "lane"), [(1024, 16384, 8, 16), (20, 5, 1, 2)])
def test_hard_negatives_equal_brute_force(spark, block, query_block, nearest, lane):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(9, 12))
    x = middle[rng.integers(9, size=400)] + rng.normal(size=(400, 12)) * 0.4
    x[200:260] = x[200]  # a vector that many rows have, so scores tie
    rows = rows_of(x, rng.integers(0, 5, 400)) + odd_vectors(12) + [(1000, [0.0] * 12, 3, "", 0), (1020, (-x[0]).tolist(), 77, "", 0), (1040, x[5].tolist(), 77, "", 0)]
    df = spark.createDataFrame(rows, V).repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, block=block, query_block=query_block, nearest=nearest, lane=lane).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_negatives(rows, 20)


def test_cells_far_away_are_not_read(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 16))
    middle *= 4 / np.linalg.norm(middle, axis=1, keepdims=True)
    x = np.concatenate([m + rng.normal(size=(100, 16)) * 0.05 for m in middle])
    rows, watch = rows_of(x, np.arange(len(x)) // 50), {}
    df = spark.createDataFrame(rows, V)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, block=50, query_block=2, nearest=2, watch=watch).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_negatives(rows, 100)
    shares = [read / every for read, every in watch["read"]]
    assert len(shares) == 4 and max(shares) < 0.6, shares


def test_bounds_of_cells_hold():
    rng = np.random.default_rng(4)
    x, q = np.floor(rng.normal(size=(300, 10)) * 64), np.floor(rng.normal(size=(30, 10)) * 64)
    cells = hard_negatives.Cells(x[:8], float((x * x).sum(axis=1).max()))
    at, far = cells.own(x)
    for c in range(7):  # the last cell is left empty
        cells.least[c], cells.most[c] = far[at == c].min(), far[at == c].max()
    least, most = cells.bounds(q)
    for i in np.flatnonzero(at < 7):
        assert ((q @ x[i] >= least[:, at[i]]) & (q @ x[i] <= most[:, at[i]])).all()
    assert (most[:, 7] == -np.inf).all()


def test_hard_negatives_without_rows_or_anchors(spark):
    df = spark.createDataFrame([], V)
    assert hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).count() == 0
    df = spark.createDataFrame(rows_of(np.ones((5, 3)), range(5), 1), V)
    assert hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.col("vec_id") == 1).count() == 0  # no other row of its label


def whole_vectors(rows, width):
    kept = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in kept], np.int64)
    return [i for i, _ in kept], x


@pytest.mark.parametrize("block", [None, 6])
def test_whitening_equals_a_whole_decomposition(spark, block):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 20)) * 0.8 ** np.arange(20) @ np.linalg.qr(rng.normal(size=(20, 20)))[0] + rng.normal(size=20)
    rows = rows_of(x, np.zeros(500)) + odd_vectors(20)
    got = whitening.whiten(spark.createDataFrame(rows, V).repartition(3), k=6, block=block).toPandas()
    ids, w = whole_vectors(rows, 20)
    n, s = len(w), w.sum(axis=0)
    value, axes = np.linalg.eigh(np.cov((w - 1_000_000).T.astype(float), bias=True))
    value, axes = value[::-1], axes[:, ::-1]
    want = (n * w - s) / n @ axes[:, :6] / np.sqrt(value[:6])
    deviation = ((n * w - s) ** 2).sum(axis=1)
    assert len(got) == 6 * n and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    for c in range(6):
        part = got[got["component"] == c + 1]
        np.testing.assert_allclose(part["explained"], value[c] / value.sum(), rtol=1e-9)
        sign = np.sign(axes[np.abs(axes[:, c]).argmax(), c])
        key = lambda i, d, y: sorted(zip([-1 if k is None or k != k else k for k in i], d, np.round(y, 6) + 0.0, strict=True))
        np.testing.assert_allclose(np.array(key(part["vec_id"], part["deviation"], part["whitened"]), float), np.array(key(ids, deviation, want[:, c] * sign), float), rtol=1e-9, atol=2e-6)


def test_subspace_iteration_is_certified_by_residuals(spark):
    rng = np.random.default_rng(7)
    d = 40
    steep = rng.normal(size=(600, d)) * 0.7 ** np.arange(d)
    for x, k, block, widens in ((steep, 4, 8, False), (rng.normal(size=(600, d)), 4, 5, True)):
        rows = whitening.integers(whitening.usable_rows(spark.createDataFrame(rows_of(x, np.zeros(600)), V)), 4096, 0)
        f, watch = whitening.fit(rows, 0), []
        value, axes = whitening.components(rows, f, k, block, patience=3, watch=watch)
        w = np.floor(x * 4096)
        v = np.cov(w.T, bias=True)
        np.testing.assert_allclose(value, np.linalg.eigvalsh(v)[::-1][:k], rtol=1e-9)
        assert np.linalg.norm(v @ axes - axes * value, axis=0).max() <= 2e-11 * value[0]
        assert len(watch) > 3 and (watch[-1][0] > block) == widens and watch[-1][1] < watch[0][1]


def test_whitening_without_variance(spark):
    assert whitening.whiten(spark.createDataFrame([], V)).count() == 0
    same = spark.createDataFrame(rows_of(np.ones((4, 3)), range(4)), V)
    assert whitening.whiten(same).count() == 0
    line = spark.createDataFrame(rows_of(np.arange(8)[:, None] * np.array([[1.0, 2.0, 0.0]]), range(8)), V)
    got = whitening.whiten(line).toPandas()
    assert set(got["component"]) == {1} and got["explained"].iloc[0] == pytest.approx(1)
    assert sorted(got["whitened"].round(6)) == sorted(((np.arange(8) - 3.5) / np.arange(8).std()).round(6))


def texts():
    rng = random.Random(8)
    kinds = [(1, 0x250), (0x250, 0x3000), (0x300, 0x370), (0xAC00, 0xD7A0), (0x1100, 0x1200), (1, 128), (32, 127), (0x1F300, 0x1F700)]
    out = ["".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(60))) for _ in range(200)]
    words = ["the", "don't", "I'LL", "x1y2", "Größe", "ΑΣΑΣ", "naïve", "---", "日本語", "Émile", "<|endoftext|>", "a<|startoftext|>b", "<|endoftext|"]
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(300))) for _ in range(40)]
    return [*out, "", " \n\t", "z" * 5000, "=" * 200 + " x", "é" * 3000, "word " * 40_000, " ".join(f"w{i}" for i in range(20_000)), "a\x00b \x85c\xa0d\x1ce"]


@pytest.mark.parametrize("hot", [65_536, 5, 0])
def test_token_counts_equal_the_library(spark, hot):
    from tokenizers import Tokenizer

    t = texts()
    rows = [*((i, x, "x", 1) for i, x in enumerate(t)), (3, t[3], "again", 2), (None, "no id", "", 0), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, key int").repartition(3)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = [(i, len((x or "").encode()), n := len(tokenizer.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x, *_ in rows]
    got = token_counts.token_counts(docs, tokenizer_path(), hot=hot).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(docs.limit(0), tokenizer_path(), hot=hot).count() == 0


def test_pre_tokens_are_counted_once(spark):
    docs = spark.createDataFrame([(i, "one two, two " + "q" * 70) for i in range(30)], "doc_id long, text string").repartition(4)
    got = {r["key"]: (r["n"], r["pieces"]) for r in token_counts.vocabulary(docs, tokenizer_path()).collect()}
    assert set(got) == {"one", "two", ",", token_counts.key_of("q" * 70)} and got["two"] == (60, 1) and got["one"][0] == 30
