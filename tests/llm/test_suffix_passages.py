"""Repeated strings of hot anchors, and passages that documents share, against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from factloom.llm import suffix_dedup

from test_llm_operators import brute_removed, corpus, prose


def hot_corpus():
    """One passage, shorter than a string, in most texts with other words around it; some of them alike on one side."""
    rng = random.Random(8)
    passage, ahead, behind = prose(rng, 45), prose(rng, 40), prose(rng, 40)
    texts = [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(12)]
    texts += [f"{ahead} {passage} {prose(rng, 30)}" for _ in range(6)] + [f"{prose(rng, 30)} {passage} {behind}" for _ in range(6)]
    texts += ["\n".join([prose(rng, 70)] * 2), f"{passage}\n{passage}\n{passage}", "la " * 300, "la " * 200, "", None, texts[0]]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    return rows + [rows[1], (None, "lost words here now", "x"), (None, texts[2], "x")]


def brute_shared(rows, n):
    words = [re.split(r"[\x20\x09-\x0d]+", (t or "").strip(" \t\n\v\f\r")) if (t or "").strip(" \t\n\v\f\r") else [] for _, t, *_ in rows]
    seen = defaultdict(set)
    for (i, t, *_), w in zip(rows, words, strict=True):
        for j in range(len(w) - n + 1):
            seen[tuple(w[j : j + n])].add((i, t))
    out = []
    for (i, *_), w in zip(rows, words, strict=True):
        mask = np.zeros(len(w), bool)
        for j in range(len(w) - n + 1):
            if len(seen[tuple(w[j : j + n])]) > 1:
                mask[j : j + n] = True
        out.append((i, int(mask.sum()), bool(mask.any())))
    return out


@pytest.mark.parametrize(("rows", "block", "hot"), [(corpus, 20_000, 4096), (hot_corpus, 20_000, 3), (hot_corpus, 3, 4096), (hot_corpus, 2, 2)])
def test_removed_strings_and_shared_passages_equal_brute_force(spark, monkeypatch, rows, block, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = spark.createDataFrame(rows(), "doc_id long, text string, spans string").repartition(3)
    got = suffix_dedup.suffix_dedup(docs, block=block).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(brute_removed(rows(), 400), key=str)
    want = brute_shared(rows(), 51)
    assert sorted(((r["doc_id"], r["shared_words"], r["shares_passage"]) for r in got), key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 5


def test_words_of_a_long_text_are_those_of_its_pieces(monkeypatch):
    t = np.frombuffer((prose(random.Random(3), 700) + " " + "x" * 900 + " end").encode(), np.uint8)
    whole, at = suffix_dedup._words(t, np.array([0, len(t)]))
    monkeypatch.setattr(suffix_dedup, "LONG", 500)
    cut, cut_at = suffix_dedup._words(t, np.array([0, len(t)]))
    assert whole.tolist() == cut.tolist() and at.tolist() == cut_at.tolist() and len(whole) == 702
