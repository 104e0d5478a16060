"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are lower-cased word heads. Their log-odds between toxic and other labelled texts, with an informative Dirichlet prior
from both, less a drift that makes an ordinary text's expectation negative, are scanned in linear time for all maximal scoring
segments. The score of a text's best segment is judged by the extreme-value law of such maxima in labelled texts that aren't
toxic (it grows with the logarithm of the length), the other significant passages are counted, and a logistic of both gives
the probability.

Cases: null or empty texts have no segment and get the score of none; null doc_ids are not held out; repeated rows are scored
alike; without labelled rows every score is 0.5 or less, predicted 0; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, materialize, slices, span_hashes, utf8, word_spans
from .labelled import held_out, labelled_sample, logistic_fit

BUCKETS = 1 << 18
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
HEAD = 5
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_GAP[0x27] = False


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, row, start and end of each token."""
    low = LOWER[data]
    s, e, row = word_spans(low, at, _GAP)
    return (span_hashes(low, s, np.minimum(e, s + HEAD)) >> np.uint64(46)).astype(np.int64), row, s, e


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) by the algorithm of Ruzzo and Tompa; linear time."""
    found: list[list] = []  # start, end, sum before, sum at end
    total = 0.0
    for i, x in enumerate(score.tolist()):
        before, total = total, total + x
        if x <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            skipped = []
            while j >= 0 and found[j][2] >= new[2]:
                skipped.append(j)
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new.append(j)
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(s, e, hi - lo) for s, e, lo, hi, _ in found]


@dataclass
class ToxicModel:
    weights: np.ndarray  # by bucket
    rate: float  # the law of maxima: P(best >= x) = 1 - exp(-scale * n * exp(-rate * x))
    scale: float
    logistic: np.ndarray
    least: float = 3.0  # a passage is significant if its expected number in such a text is under exp(-least)

    def surprise(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Minus the logarithm of the expected number of segments as good."""
        return self.rate * best - np.log(self.scale * np.maximum(n, 1))

    def features(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Best surprise and log number of significant passages of each row; and these passages' bytes in the row."""
        bucket, row, s, e = tokens(data, at)
        rows = len(at) - 1
        n = np.bincount(row, minlength=rows)
        best = np.zeros(rows)
        score = self.weights[bucket]
        if len(score):
            full = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[full]
            down = np.abs(score).sum() + 1.0  # every row starts lower than the rows before it ever were
            so_far = np.cumsum(score) - row * down
            low = np.minimum.accumulate(so_far - score)
            best[full] = np.maximum(np.maximum.reduceat(so_far - low, first), 0)
        found = self.surprise(best, n)
        passages: list[list[tuple[int, int, float]]] = [[] for _ in range(rows)]
        start = np.cumsum(n) - n
        for i in np.flatnonzero(found >= self.least).tolist():
            a = int(start[i])
            all_ = maximal_segments(score[a : a + int(n[i])])
            marks = self.surprise(np.array([x for _, _, x in all_]), np.full(len(all_), n[i]))
            passages[i] = [(int(s[a + b] - at[i]), int(e[a + c - 1] - at[i]), float(m)) for (b, c, _), m in zip(all_, marks, strict=True) if m >= self.least]
        return np.stack((np.clip(found, -20, 60), np.log1p([len(p) for p in passages])), axis=1), passages

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.logistic[:-1] + self.logistic[-1], -30, 30)))


def _counts(batches):
    """Token counts in texts with and without the label."""
    held = np.zeros((2, BUCKETS), np.int64)
    for b in slices(batches, "text"):
        bucket, row, _, _ = tokens(*utf8(b.column("text")))
        row, bucket = np.divmod(np.unique(row * BUCKETS + bucket), BUCKETS)  # once for each text: words come in bursts
        label = np.asarray(b.column("label"))[row]
        for y in (0, 1):
            held[y] += np.bincount(bucket[label == y], minlength=BUCKETS)
    some = np.flatnonzero(held.sum(axis=0))
    yield pa.RecordBatch.from_pydict({"bucket": some, "other": held[0][some], "toxic": held[1][some]})


def log_odds(other: np.ndarray, toxic: np.ndarray, strength: float = 500.0) -> np.ndarray:
    """Log-odds with a Dirichlet prior of half a count for each token and `strength` counts dealt as both classes together
    have them; shrunk to 0 where they are within 2.5 deviations of it."""
    prior = 0.5 + (other + toxic) / (other + toxic).sum() * strength
    a, b = toxic + prior, other + prior
    odds = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    z = np.abs(odds) / np.sqrt(1 / a + 1 / b)
    return odds * np.clip((z - 2.5) / 1.5, 0, 1)


def _maxima(model: ToxicModel):
    def run(batches):
        for b in slices(batches, "text"):
            data, at = utf8(b.column("text"))
            bucket, row, _, _ = tokens(data, at)
            n = np.bincount(row, minlength=b.num_rows)
            f, _ = model.features(data, at)
            yield pa.RecordBatch.from_arrays([b.column("label").cast(pa.int32()), pa.array(n), pa.array(f[:, 0]), pa.array(f[:, 1])], ["label", "n", "best", "passages"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> ToxicModel:
    sample = labelled_sample(docs, labels, "toxic", bound).select("text", "label")
    counts = sample.mapInArrow(_counts, "bucket long, other long, toxic long").groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toPandas()  # BUCKETS rows at most
    other, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    other[counts["bucket"]], toxic[counts["bucket"]] = counts["other"], counts["toxic"]
    if not toxic.sum() or not other.sum():
        return ToxicModel(np.full(BUCKETS, -1.0), 1.0, 1.0, np.array([0.0, 0.0, -1.0 if not toxic.sum() else 1.0]))
    odds = log_odds(other, toxic)
    ordinary = other / other.sum()
    drift = max(0.05, float(ordinary @ odds) + 0.25)
    raw = ToxicModel(odds - drift, 1.0, 1.0, np.zeros(3), least=np.inf)
    found = sample.mapInArrow(_maxima(raw), "label int, n long, best double, passages double").toPandas()  # `bound` rows at most
    n = np.maximum(found["n"].to_numpy(), 1)
    best = found["best"].to_numpy() + np.log(n)  # rate 1, scale 1: the maximum itself
    plain = found["label"].to_numpy() == 0
    x, size = best[plain], np.log(n[plain])
    rate = 1.0
    for _ in range(30):  # moments of the law: location log(scale n) / rate, deviation pi / (rate sqrt 6)
        rest = x - size / rate
        rate = float(np.clip(np.pi / np.sqrt(6) / max(rest.std(), 0.05), 0.2, 20))
    scale = float(np.exp(rate * (x - size / rate).mean() - 0.5772))
    model = ToxicModel(odds - drift, rate, scale, np.zeros(3))
    found = sample.mapInArrow(_maxima(model), "label int, n long, best double, passages double").toPandas()
    model.logistic = logistic_fit(found[["best", "passages"]].to_numpy(), found["label"].to_numpy().astype(float))
    return model


def _score(model: ToxicModel, passages: bool):
    def run(batches):
        for b in slices(batches, "text"):
            f, found = model.features(*utf8(b.column("text")))
            p = model.probability(f)
            columns = {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))}
            if passages:
                columns["passages"] = pa.array([[{"start": s, "end": e, "surprise": m} for s, e, m in x] for x in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surprise", pa.float64())])))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (bytes) for each row of docs (doc_id, text)."""
    model = fit_toxicity(docs, labels, bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model, True), "doc_id long, held_out boolean, score double, predicted int, passages array<struct<start: int, end: int, surprise: double>>")


def op6(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
