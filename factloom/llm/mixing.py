"""Mixing sources to target weights through soft domain membership, in DataFrame functions alone.

A naive Bayes classifier over hashed word heads, fitted on a bounded sample of a labelled table, gives every document a
posterior over domains. Nonnegative rates r are then fitted by projected, metric-scaled gradient steps on the squared distance
of the domains' expected token shares, sum(r * tokens * posterior) / sum(tokens), from the targets. A step moves each r along
its posterior by a few coefficients, so an iteration is one aggregate over a narrow written table, and the coefficients are
all that reaches the driver.

Cases: null or empty texts have 0 tokens and the prior as posterior; null doc_ids and repeated rows are rows like others
(equal doc_ids are drawn alike); without labelled rows the posteriors are uniform and rates 1; other columns are not read
(mixed() returns them unchanged); an empty table gives an empty result. Labels of one doc_id that disagree are all counted.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BUCKETS = 4096
#: Labelled rows, those with the smallest hashes, that the classifier is fitted on at most.
SAMPLE = 20_000
PACES = (1.0, 0.6, 0.35, 0.15, 0.05, 0.01)


def word_heads(text: Column, letters: int = 5) -> Column:
    """Hash bucket (from 1) of the first letters of each word."""
    words = F.filter(F.split(F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "\n\r\t", "   "), " "), lambda w: w != "")
    return F.transform(words, lambda w: (F.pmod(F.xxhash64(F.substring(w, 1, letters)), F.lit(BUCKETS)) + 1).cast("int"))


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> tuple[list[float], list[list[float]]]:
    """Log priors, and for each domain the log weights of the buckets. labelled: doc_id, domain."""
    some = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample)
    some = materialize(some.select(F.col("doc_id").cast("long").alias("doc_id"), "domain"), "sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")  # at most `sample` rows
    # a document's label counts once, however often its row is repeated
    found = texts.groupBy("doc_id", "domain").agg(F.min("text").alias("text")).select("domain", F.explode(word_heads(F.col("text"))).alias("bucket"))
    counts = {(r["domain"], r["bucket"]): r["count"] for r in found.groupBy("domain", "bucket").count().collect()}  # domains x BUCKETS rows at most
    rows = {r["domain"]: r["count"] for r in some.groupBy("domain").count().collect()}
    prior = [math.log((rows.get(d, 0) + 1) / (sum(rows.values()) + len(domains))) for d in domains]
    everywhere = np.array([sum(counts.get((d, b + 1), 0) for d in domains) for b in range(BUCKETS)], float)
    back = (everywhere + 0.5) / (everywhere.sum() + 0.5 * BUCKETS)
    weights = []
    for d in domains:
        own = np.array([counts.get((d, b + 1), 0) for b in range(BUCKETS)], float)
        weights.append(np.log((own + 50 * back) / (own.sum() + 50) / back).round(4).tolist())
    return prior, weights


def evidence_columns(prior: list[float], weights: list[list[float]]) -> list[Column]:
    """n_tokens and a score for each domain, from __heads. Evidence grows with the root of the text's length, which keeps membership soft."""
    def evidence(w: list[float]) -> Column:
        table = F.expr(f"cast(split('{','.join(map(str, w))}', ',') as array<double>)")  # folded to a constant
        return F.aggregate(F.col("__heads"), F.lit(0.0), lambda a, i: a + F.element_at(table, i))

    n = F.size("__heads")
    scores = [F.lit(p) + F.when(n > 0, evidence(w) / F.sqrt(n)).otherwise(F.lit(0.0)) for p, w in zip(prior, weights, strict=True)]
    return [n.cast("long").alias("n_tokens"), *[s.alias(f"__s{i}") for i, s in enumerate(scores)]]


def _scored(docs: DataFrame, prior: list[float], weights: list[list[float]], domains: list[str]) -> DataFrame:
    """docs (row struct<...>, doc_id, text) with n_tokens and p0, p1, ..."""
    with_heads = docs.withColumn("__heads", word_heads(F.col("text")))
    keep = [c for c in docs.columns if c != "text"]
    scored = with_heads.select(*keep, *evidence_columns(prior, weights))
    s = [F.col(f"__s{i}") for i in range(len(domains))]
    top = F.greatest(*s) if len(s) > 1 else s[0]
    e = [F.exp(x - top) for x in s]
    return scored.select(*keep, "n_tokens", *[(x / reduce(lambda a, b: a + b, e)).alias(f"p{i}") for i, x in enumerate(e)])


def fit_rates(scored: DataFrame, targets: list[float], iterations: int = 30, close: float = 1e-6) -> Column:
    """The rate of a row of scored (n_tokens, p0, p1, ...), as a column of its posteriors."""
    p = [F.col(f"p{i}") for i in range(len(targets))]
    share = np.array(targets, float) / sum(targets)
    rate, t = F.lit(1.0), F.col("n_tokens").cast("double")
    total = scored.agg(F.sum("n_tokens")).first()[0]
    if not total:
        return rate
    for _ in range(iterations):
        now = scored.withColumn("r", rate)
        active = F.when(F.col("r") > 0, t).otherwise(F.lit(0.0))
        pairs = [(i, j) for i in range(len(p)) for j in range(i, len(p))]
        sums = now.agg(*[F.sum(F.col("r") * t * x) for x in p], *[F.sum(active * p[i] * p[j]) for i, j in pairs]).first()
        error = np.array(sums[: len(p)]) / total - share
        if np.abs(error).max() < close:
            break
        metric = np.zeros((len(p), len(p)))
        for (i, j), x in zip(pairs, sums[len(p) :], strict=True):
            metric[i, j] = metric[j, i] = x / total
        step = np.linalg.lstsq(metric + 1e-9 * np.eye(len(p)), error, rcond=1e-3)[0]
        # rates that meet 0 make whole steps overshoot: of a few paces, the best is taken
        moved = [F.greatest(F.lit(0.0), F.col("r") - reduce(lambda a, b: a + b, [F.lit(float(pace * c)) * x for c, x in zip(step, p, strict=True)])) for pace in PACES]
        tried = np.array(now.agg(*[F.sum(m * t * x) for m in moved for x in p]).first()).reshape(len(PACES), -1) / total - share
        best = int((tried**2).sum(axis=1).argmin())
        if (tried[best] ** 2).sum() >= (error**2).sum():
            break
        rate = F.greatest(F.lit(0.0), rate - reduce(lambda a, b: a + b, [F.lit(float(PACES[best] * c)) * x for c, x in zip(step, p, strict=True)]))
    return rate


def _copies(rate: Column) -> Column:
    """The rate rounded up or down by the document's own draw."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def mix_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_tokens, p_<domain>..., rate, copies for each row of docs (doc_id, text). targets: token share of each domain."""
    domains = sorted(targets)
    prior, weights = fit_domains(docs, labelled, domains, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = materialize(_scored(rows, prior, weights, domains), "scored")
    rate = fit_rates(scored, [targets[d] for d in domains])
    return scored.withColumn("rate", rate).select("doc_id", "n_tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], "rate", _copies(F.col("rate")).alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, each as often as its rate says (rounded by a hash of doc_id)."""
    domains = sorted(targets)
    prior, weights = fit_domains(docs, labelled, domains, sample)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = materialize(_scored(rows, prior, weights, domains), "scored")
    rate = fit_rates(scored, [targets[d] for d in domains])
    copies = scored.withColumn("rate", rate).withColumn("copies", _copies(F.col("rate"))).where("copies > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: Token shares by domain. The labelled table names them by its two marks.
TARGETS = {"clean": 0.90, "low": 0.04, "toxic": 0.06}


def label_domains(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("clean").alias("domain"))


def op4(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mix_rates(docs, label_domains(labels), TARGETS)
