"""Bounded samples of labelled rows that models are fitted on, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Folds by crc32 of the id's text; fold 0 is held out.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a row is never learnt from. A null doc_id is not held out, and has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, balanced: bool = False) -> DataFrame:
    """doc_id, text, label: at most `bound` labelled rows that aren't held out, those with the smallest hashes (balanced: at
    most half of them with label 1, half with 0). A doc_id with several labels has their rounded mean; a repeated document its
    smallest text; null labels don't count."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg(label)).cast("int").alias("label"))
    order = (F.xxhash64("doc_id"), "doc_id")
    if balanced:
        marks = marks.where("label = 1").orderBy(*order).limit(bound // 2).unionByName(marks.where("label = 0").orderBy(*order).limit(bound // 2))
    else:
        marks = marks.orderBy(*order).limit(bound)
    marks = materialize(marks, "marks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(marks), "doc_id")  # at most `bound` rows
    return materialize(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")), "sample")


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights, the last one constant, by Newton's method."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x.shape[1])
    if len(x) == 0:
        return w
    keep = ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + keep, x.T @ (p - y) / len(x) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
