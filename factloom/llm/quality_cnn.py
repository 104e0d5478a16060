"""Quality by a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes run over the whole text in steps of STRIDE; each chunk of 2 * HALF bytes, overlapping its
neighbours by half, keeps its filters' maxima. Over all chunks of a text, the mean, the largest and the smallest of these are
taken, and a small dense layer combines them, and how long the text is, into one probability.

Cases: a null or empty text is one chunk of zeros; null doc_ids are not held out; repeated rows are scored alike; without
labelled rows every score is 0.5; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8
from .labelled import held_out, labelled_sample

WIDTH, STRIDE, HALF, FILTERS, HIDDEN = 6, 2, 256, 24, 16
#: Labelled rows that the network is fitted on, at most (half of each label), and the longest text among them in bytes.
SAMPLE, LONGEST = 6_000, 200_000
SIZES = 2


def laid_out(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows, each padded with zeros to whole halves, WIDTH zeros at the end; and the number of halves of each row."""
    size = np.diff(at)
    halves = np.maximum(1, -(-size // HALF))
    out = np.zeros(int(halves.sum()) * HALF + WIDTH, np.uint8)
    first = (np.cumsum(halves) - halves) * HALF
    out[np.repeat(first - at[:-1], size) + np.arange(len(data))] = data
    return out, halves


class ByteCnn:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {
            "table": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "w1": rng.normal(0, 0.2, (3 * FILTERS + SIZES, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": np.zeros(HIDDEN, np.float32),
            "b2": np.zeros(1, np.float32),
        }

    def activations(self, text: np.ndarray, halves: int) -> np.ndarray:
        """halves x places x filters."""
        n = halves * HALF
        out = np.take(self.p["table"][0], text[0:n:STRIDE], axis=0)
        for j in range(1, WIDTH):
            out += np.take(self.p["table"][j], text[j : n + j : STRIDE], axis=0)
        return out.reshape(halves, HALF // STRIDE, FILTERS)

    def half_maxima(self, text: np.ndarray, halves: int, strip: int = 512) -> np.ndarray:
        return np.concatenate([self.activations(text[i * HALF : (i + strip) * HALF + WIDTH], min(strip, halves - i)).max(axis=1) for i in range(0, halves, strip)])

    @staticmethod
    def chunked(maxima: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chunks of two halves (one, if the row has but one): values, which half each came from, chunks of each row, their starts."""
        row_end = np.cumsum(halves) - 1
        first = np.ones(len(maxima), bool)
        first[row_end[halves > 1]] = False
        left = np.flatnonzero(first)
        right = np.where(np.isin(left, row_end), left, np.minimum(left + 1, len(maxima) - 1))
        a, b = maxima[left], maxima[right]
        chunks = np.maximum(halves - 1, 1)
        return np.maximum(a, b), np.where(a >= b, left[:, None], right[:, None]), chunks, np.cumsum(chunks) - chunks

    def pooled(self, value: np.ndarray, chunks: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mean, largest and smallest of the chunks' filters, and two measures of the text's size in bytes: a short text fires
        few filters."""
        z = np.maximum(value + self.p["bias"], 0)
        sizes = np.stack((np.log1p(size) / 8, np.minimum(size, 2 * HALF) / (2 * HALF)), axis=1).astype(np.float32)
        return np.concatenate((np.add.reduceat(z, starts) / chunks[:, None], np.maximum.reduceat(z, starts), np.minimum.reduceat(z, starts), sizes), axis=1)

    def head(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.p["w1"] + self.p["b1"], 0)
        return h, 1 / (1 + np.exp(-np.clip(h @ self.p["w2"] + self.p["b2"], -30, 30)))

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0)
        text, halves = laid_out(data, at)
        value, _, chunks, starts = self.chunked(self.half_maxima(text, int(halves.sum())), halves)
        return self.head(self.pooled(value, chunks, starts, np.diff(at)))[1].astype(np.float64)

    def gradients(self, data: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        text, halves = laid_out(data, at)
        total = int(halves.sum())
        act = self.activations(text, total)
        where = act.argmax(axis=1)  # halves x filters
        maxima = np.take_along_axis(act, where[:, None, :], 1)[:, 0]
        value, source, chunks, starts = self.chunked(maxima, halves)
        z = np.maximum(value + self.p["bias"], 0)
        row = np.repeat(np.arange(len(chunks)), chunks)
        x = self.pooled(value, chunks, starts, np.diff(at))
        h, p = self.head(x)
        g = {}
        d = ((p - y) / len(y)).astype(np.float32)
        g["w2"], g["b2"] = h.T @ d, d.sum(keepdims=True)
        dh = d[:, None] * self.p["w2"] * (h > 0)
        g["w1"], g["b1"] = x.T @ dh, dh.sum(axis=0)
        dx = dh @ self.p["w1"].T
        mean, high, low = dx[:, :FILTERS], dx[:, FILTERS : 2 * FILTERS], dx[:, 2 * FILTERS : 3 * FILTERS]
        dz = (mean / chunks[:, None])[row]
        for part, pool in ((high, x[:, FILTERS : 2 * FILTERS]), (low, x[:, 2 * FILTERS : 3 * FILTERS])):
            hit = z == pool[row]
            dz += hit * (part / np.add.reduceat(hit.astype(np.float32), starts))[row]
        dz *= z > 0
        g["bias"] = dz.sum(axis=0)
        f = np.broadcast_to(np.arange(FILTERS), source.shape)
        place = (source * HALF + where[source, f] * STRIDE).ravel()
        weight, flat = dz.ravel(), f.ravel()
        some = np.flatnonzero(weight)
        place, weight, flat = place[some], weight[some], flat[some]
        g["table"] = np.stack([np.bincount(text[place + j].astype(np.int64) * FILTERS + flat, weights=weight, minlength=256 * FILTERS).reshape(256, FILTERS) for j in range(WIDTH)])
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 5) -> ByteCnn:
        """Adam on the log loss. Now and then a good text is replaced by a short passage of it, as good, so that shortness
        alone is no fault."""
        rng = np.random.default_rng(seed)
        self.p["w2"] = rng.normal(0, 0.2, HIDDEN).astype(np.float32)
        m = {k: np.zeros_like(v, np.float64) for k, v in self.p.items()}
        v = {k: np.zeros_like(x, np.float64) for k, x in self.p.items()}
        t = 0
        steps = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                raw = [texts[j] for j in some]
                for j in np.flatnonzero((rng.random(len(raw)) < 0.2) & (y[some] == 1)):
                    size = int(rng.integers(15, 300))
                    a = int(rng.integers(0, max(1, len(raw[j]) - size)))
                    raw[j] = raw[j][a : a + size]
                at = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
                g = self.gradients(np.frombuffer(b"".join(raw), np.uint8), at, y[some])
                t += 1
                now = rate * (1 - t / (steps + 1))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> ByteCnn:
    sample = labelled_sample(docs, labels, "quality", bound, balanced=True)
    # a longer text is learnt by a window of it, anywhere in it
    place, wide = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - LONGEST // 4, F.lit(1))) + 1, F.lit(LONGEST // 4)
    window = F.when(F.octet_length("text") <= LONGEST, F.col("text")).otherwise(F.substr("text", place.cast("int"), wide))
    rows = sample.withColumn("text", window).orderBy("doc_id").toPandas()  # `bound` rows of LONGEST bytes at most
    if not len(rows):
        return ByteCnn()
    return ByteCnn().fit([x.encode() for x in rows["text"]], rows["label"].to_numpy().astype(np.float32))


def _score(model: ByteCnn, threshold: float):
    def run(batches):
        for b in slices(batches, "text"):
            p = model.score(*utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text)."""
    model = fit_quality(docs, labels, bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, unchanged."""
    model = fit_quality(docs, labels, bound)

    def run(batches):
        for b in slices(batches, "text"):
            yield b.filter(pa.array(model.score(*utf8(b.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9(spark, sf_dir: str) -> DataFrame:
    return score_quality(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
