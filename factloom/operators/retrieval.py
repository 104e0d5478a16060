"""Retrieval: vector and lexical shortlists, hybrid ranking, diverse and deduplicated selection."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from ..functions import vectors as V
from .postings import sent
from .ranked import best_shared


def vector_topk(vectors: DataFrame, query: list[float], k: int, floor: float | None = None, where: Column | None = None, tie: tuple[str, ...] = ("vec_id",), column: str = "embedding", most: int = 50) -> DataFrame:
    """Rows by cosine distance (then `tie`), with similarity; k between 1 and `most` (50; a passage shortlist has 200), the
    floor between 0 and 1. One scan and a top-k in every task."""
    k = max(1, min(most, k))
    if where is not None:
        vectors = vectors.where(where)
    q = V.constant(query)
    scored = vectors.withColumn("similarity", V.cosine(F.col(column), q)).where(F.col("similarity").isNotNull())
    if floor is not None:
        scored = scored.where(F.col("similarity") >= max(0.0, min(1.0, floor)))
    return scored.orderBy(F.desc("similarity"), *tie).limit(k)


def match_chunks(chunks: DataFrame, documents: DataFrame, query: Column, k: int = 24, floor: float = 0.0, corpus: str | None = None, document_ids: list | None = None, since: str | None = None, until: str | None = None, language: str | None = None) -> DataFrame:
    """T2, F2, F4, J6, AJ4, DT7: public chunks by cosine, then the newer document, then the place in it. What is None filters nothing;
    dates are inclusive. k between 1 and 50, the floor between 0 and 1 are literals, so no row of bounds is joined."""
    k, floor = max(1, min(50, k)), max(0.0, min(1.0, floor))
    d = documents.where("visibility = 'public'")
    wanted = [(corpus, lambda v: F.col("corpus_version") == v), (document_ids, lambda v: F.col("document_id").isin(v)), (since, lambda v: F.col("document_date") >= F.lit(v).cast("date")), (until, lambda v: F.col("document_date") <= F.lit(v).cast("date")), (language, lambda v: F.col("language") == v)]
    for value, where in wanted:
        d = d if value is None else d.where(where(value))
    j = chunks.join(d.select("document_id", "document_date"), "document_id").withColumn("similarity", V.lite_similarity(V.cosine(F.col("embedding"), query)))
    return j.where(F.col("similarity") >= floor).orderBy(F.desc("similarity"), F.desc_nulls_last("document_date"), "chunk_index").limit(k)


def lexical_candidates(chunks: DataFrame, terms: list[str], text: str = "text", label: str = "label") -> DataFrame:
    """chunks whose text or label holds one of the (at most twelve) terms, in either case; all without terms."""
    terms = [t.lower() for t in terms[:12]]
    if not terms:
        return chunks
    holds = lambda c: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), t))
    return chunks.where(holds(text) | holds(label))


#: Claims whose tokens travel to all workers, and their tokens, at most; beyond, claims and passages meet by an equi-join.
MOST_CLAIMS, MOST_TOKENS = 2_000, 200_000


def _term_scores(claims: DataFrame, passages: DataFrame, ck: str, pk: str, top: int | None, wanted: DataFrame | None) -> DataFrame | None:
    """(ck, pk, score): the share of a claim's terms, as often as they stand there, that a passage has; tables of (key, terms array).
    Few claims are checked in the passages' own tasks, by posting lists of their terms, which give top entries of each claim alone (all
    pairs above 0 without top) and the wanted pairs. None for more claims."""
    rows = claims.select(ck, "terms").limit(MOST_CLAIMS + 1).collect()
    if len(rows) > MOST_CLAIMS or sum(len(r["terms"] or ()) for r in rows) > MOST_TOKENS:
        return None
    keys = [r[ck] for r in rows]
    vocabulary = sorted({t for r in rows for t in r["terms"] or ()})
    place = {t: i for i, t in enumerate(vocabulary)}
    pairs = sorted((place[t], i, n) for i, r in enumerate(rows) for t, n in Counter(r["terms"] or ()).items())
    of, who, often = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), (), ())))
    first_of = np.searchsorted(of, np.arange(len(vocabulary) + 1))  # postings of a term: from its own place to the next one's
    total = np.array([len(r["terms"] or ()) for r in rows], float)
    at, asked, key_type = {k: i for i, k in enumerate(keys)}, wanted is not None, to_arrow_type(claims.schema[ck].dataType)

    def run(batches):
        known_terms = pa.array(vocabulary, pa.string())
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(np.argsort(ids, kind="stable"))
            best_s, best_i = np.zeros((len(keys), 0)), np.zeros((len(keys), 0), np.int64)
            c_out, p_out, s_out = [], [], []
            for first in range(0, len(ids), 512):
                # words of these passages alone are held as arrays
                n = min(512, len(ids) - first)
                lists = b.column(1).slice(first, n)
                found = pc.index_in(lists.flatten(), known_terms).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(first, first + n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                known = ~np.isnan(found) if found.dtype.kind == "f" else np.ones(len(found), bool)
                row, found = row[known], found[known].astype(np.int64)
                term, times = np.unique(row * len(vocabulary) + found, return_counts=True)
                row, found = np.divmod(term, max(1, len(vocabulary)))
                lo, hi = 0, len(row)
                many = first_of[found[lo:hi] + 1] - first_of[found[lo:hi]]
                each = np.repeat(np.arange(lo, hi), many)
                post = np.arange(len(each)) + np.repeat(first_of[found[lo:hi]] - (np.cumsum(many) - many), many)
                hit = np.bincount((row[each] - first) * len(keys) + who[post], np.minimum(often[post], times[each]), n * len(keys)).reshape(n, len(keys))
                score = np.divide(hit, total[None, :], out=np.zeros(hit.shape), where=total > 0).T
                if top is None:
                    c, p = np.nonzero(score)
                    c_out.append(c), p_out.append(p + first), s_out.append(score[c, p])
                else:
                    best_s = np.concatenate((best_s, score), axis=1)
                    best_i = np.concatenate((best_i, np.broadcast_to(np.arange(first, first + n), score.shape)), axis=1)
                    if best_s.shape[1] > top:
                        keep = np.lexsort((order[best_i], -best_s), axis=1)[:, :top]
                        best_s, best_i = np.take_along_axis(best_s, keep, 1), np.take_along_axis(best_i, keep, 1)
                if asked:
                    for p in range(n):
                        for k in b.column(2)[first + p].as_py() or ():
                            if (c := at.get(k)) is not None:
                                c_out.append([c]), p_out.append([first + p]), s_out.append([score[c, p]])
            if top is not None:
                c, p = np.nonzero(best_s > 0)
                c_out.append(c), p_out.append(best_i[c, p]), s_out.append(best_s[c, p])
            if c_out:
                c, p, v = (np.concatenate(x) for x in (c_out, p_out, s_out))
                _, one = np.unique(c.astype(np.int64) * len(ids) + p.astype(np.int64), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, key_type).take(pa.array(c[one].astype(np.int64))), b.column(0).take(pa.array(p[one].astype(np.int64))), pa.array(v[one])], [ck, pk, "score"])

    side = passages.select(pk, "terms")
    if wanted is not None:
        # what is wanted travels to the terms, up to a measured size
        side = side.join(sent(wanted.groupBy(pk).agg(F.collect_list(ck).alias("wanted"))), pk, "left").select(pk, "terms", "wanted")
    return side.mapInArrow(run, f"{ck} {claims.schema[ck].dataType.simpleString()}, {pk} {passages.schema[pk].dataType.simpleString()}, score double")


def lexical_scores(claims: DataFrame, passages: DataFrame, claim: tuple[str, str], passage: tuple[str, str], top: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(claim key, passage key, lexical) for all claims and passages that share a token; with top, at least the top best of each
    claim (then by passage key) and the wanted pairs. Few claims: in the passages' tasks; many: by best_shared()."""
    (ck, ct), (pk, pt) = claim, passage
    terms = lambda c: X.word_tokens(F.col(c))
    found = _term_scores(claims.select(ck, terms(ct).alias("terms")), passages.select(pk, terms(pt).alias("terms")), ck, pk, top, wanted)
    if found is None:
        found = best_shared(claims, passages, (ck, terms(ct)), (pk, terms(pt)), top, wanted)
    return found.withColumnRenamed("score", "lexical")


def overlap_scores(claims: DataFrame, passages: DataFrame, claim: tuple[str, str], passage: tuple[str, str], top: int | None = None) -> DataFrame:
    """S5, as lexical_scores() over sets of terms: (claim key, passage key, overlap)."""
    (ck, ct), (pk, pt) = claim, passage
    terms = lambda c: X.overlap_terms(F.col(c))
    found = _term_scores(claims.select(ck, terms(ct).alias("terms")), passages.select(pk, terms(pt).alias("terms")), ck, pk, top, None)
    if found is None:
        found = best_shared(claims, passages, (ck, terms(ct)), (pk, terms(pt)), top, sets=True)
    return found.withColumnRenamed("score", "overlap")


def best_per(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The k first rows of each key, numbered from 1. Spark cuts to k in every task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def interleaved(df: DataFrame, run: list[str], claim: str, passage: str, score: Column, limit: int) -> DataFrame:
    """Rank passages for each claim, take rank 1 of every claim, then rank 2, and so on, `limit` in all for each run."""
    top = best_per(df.withColumn("score", score), [*run, claim], [F.desc("score"), F.col(passage)], limit)
    w = Window.partitionBy(*run).orderBy("rank", claim) if run else Window.orderBy("rank", claim)
    if not run:
        return top.orderBy("rank", claim).limit(limit)
    return top.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


HYBRID = {"lexical": 0.25, "exact": 0.25, "metadata": 0.10, "role": 0.10, "certainty": 0.10}


def hybrid_score(lexical: Column, exact: Column, metadata: Column, role: Column, certainty: Column, vector: Column) -> Column:
    """T5: weighted mean, the vector's weight of 0.20 only where there is one; half-even at six places."""
    base = lexical * 0.25 + exact * 0.25 + metadata * 0.10 + role * 0.10 + certainty * 0.10
    return F.bround(F.when(vector.isNull(), base / 0.8).otherwise(base + vector * 0.20), 6)


def vector_shortlists(queries: DataFrame, vectors: DataFrame, query: tuple[str, str], key: tuple[str, str], k: int = 200, block: int = 2048) -> DataFrame:
    """T2 for many queries: (query key, key, similarity), the k best vectors of each query by cosine, then key. Blocks of queries
    meet blocks of vectors inside a worker, which keeps each query's best and what is as good but for rounding; so do the best of all
    blocks."""
    (qk, qv), (ck, cv) = query, key
    q = queries.where(F.col(qv).isNotNull()).select(F.col(qk).alias("q"), F.col(qv).cast("array<double>").alias("x"), F.size(qv).alias("dim"))
    c = vectors.where(F.col(cv).isNotNull()).select(F.col(ck).alias("c"), F.col(cv).cast("array<double>").alias("y"), F.size(cv).alias("dim"))
    nq, nc = (max(1, -(-df.count() // block)) for df in (q, c))
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("i", F.pmod(F.xxhash64("q"), F.lit(nq)).cast("int")).withColumn("j", parts(nc))
    right = c.withColumn("j", F.pmod(F.xxhash64("c"), F.lit(nc)).cast("int")).withColumn("i", parts(nq))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows, columns, s = np.zeros(0, int), np.zeros(0, int), np.zeros((0, 0))
        if len(a) and len(b) and a["dim"].iloc[0]:
            x, y = np.array(a["x"].tolist(), float), np.array(b["y"].tolist(), float)
            with np.errstate(divide="ignore", invalid="ignore"):
                s = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)
            s = np.where(np.isnan(s), -np.inf, s)
            cut = np.partition(s, s.shape[1] - k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -2.0)
            rows, columns = np.nonzero((s >= cut[:, None] - 1e-9) & (s > -np.inf))
        return pd.DataFrame({"q": a["q"].to_numpy()[rows], "c": b["c"].to_numpy()[columns], "s": s[rows, columns]})

    types = f"q {q.schema['q'].dataType.simpleString()}, c {c.schema['c'].dataType.simpleString()}, s double"
    near = left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInPandas(best, types)
    # of all blocks' best only those of the whole, again but for rounding, meet their vectors for the exact similarity
    whole = Window.partitionBy("q").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = sent(near.withColumn("kth", F.nth_value("s", k).over(whole)).where("kth is null or s >= kth - 1e-9").select("q", "c"))
    exact = near.join(q.select("q", "x"), "q").join(c.select("c", "y"), "c").select("q", "c", V.cosine(F.col("y"), F.col("x")).alias("similarity"))
    top = best_per(exact.where("similarity is not null"), ["q"], [F.desc("similarity"), F.col("c")], k, "__n")
    return top.select(F.col("q").alias(qk), F.col("c").alias(ck), "similarity")


def union_candidates(vector: DataFrame, lexical: DataFrame, keys: list[str]) -> DataFrame:
    """By key; a row of the vector shortlist wins."""
    both = vector.withColumn("__from", F.lit(0)).unionByName(lexical.withColumn("__from", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__first", F.row_number().over(Window.partitionBy(*keys).orderBy("__from"))).where("__first = 1").drop("__from", "__first")


def hybrid_rank(candidates: DataFrame, claim: str, passage: str, k: int = 20) -> DataFrame:
    """T5 over candidates that hold lexical, exact, metadata, role, certainty and similarity columns."""
    score = hybrid_score(*[F.col(c) for c in ("lexical", "exact", "metadata", "role", "certainty", "similarity")])
    return best_per(candidates.withColumn("score", score), [claim], [F.desc("score"), F.col(passage)], k)


def lite_score(semantic: Column, lexical: Column, metadata: Column, boost: Column) -> Column:
    """T6."""
    return X.clamp(F.when(semantic.isNotNull(), semantic * 0.48 + lexical * 0.36 + metadata * 0.08 + boost).otherwise(lexical * 0.76 + metadata * 0.12 + boost))


def greedy_distinct(df: DataFrame, by: list[str], order: list[Column], keep: str, hash_: Column, terms: Column, k: int, threshold: float = 0.92, pool: int = 100) -> DataFrame:
    """For each key, walk the best `pool` rows in order and keep a row unless its hash, or a term set with a Jaccard
    similarity of at least the threshold, was kept before; k kept rows. A fold over a bounded array, in the JVM."""
    top = best_per(df.withColumn("__h", hash_).withColumn("__t", terms), by, order, pool, "__r")
    rows = top.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__r", F.col(keep).alias("id"), F.col("__h").alias("h"), F.col("__t").alias("t")))).alias("rows"))
    empty = F.filter("rows", lambda x: F.lit(False))

    def step(kept, x):
        again = F.exists(kept, lambda y: (y["h"] == x["h"]) | (X.jaccard(y["t"], x["t"]) >= threshold))
        return F.when(again | (F.size(kept) >= k), kept).otherwise(F.concat(kept, F.array(x)))

    kept = rows.select(*by, F.aggregate("rows", empty, step).alias("kept"))
    return kept.select(*by, F.posexplode("kept").alias("position", "x")).select(*by, (F.col("position") + 1).alias("position"), F.col("x.id").alias(keep))


def select_diverse(df: DataFrame, by: list[str], key: str, priority: Column, domain: Column, cluster: Column, intents: Column, limit: int, per_domain: int = 2, reserved: tuple[str, ...] = ("primary", "support", "contradiction")) -> DataFrame:
    """For each key, one row of each reserved intent, then the best; at most per_domain of a domain, one of a text
    cluster. Ranks cut what can't be reached before the fold's array is collected, so its size is bounded by the limits: for each
    set of intents, the best of a cluster in a domain; of a domain, as many as its own places and the clusters that others may
    have taken; of a cluster, as many as domains may be full, and one; and as many in all as these may block, and the limit."""
    cand = df.select(*by, F.col(key).alias("id"), priority.alias("p"), domain.alias("d"), cluster.alias("c"), F.array_sort(F.array_intersect(intents, F.array(*[F.lit(x) for x in reserved]))).alias("i"))
    for keys, most in (("dci", 1), ("di", limit + per_domain), ("ci", limit + 1), ("i", limit + (limit // per_domain + 1) * (limit + per_domain) + limit * (limit + 1))):
        cand = best_per(cand, [*by, *keys], [F.desc("p"), F.col("id")], most, "__n").drop("__n")
    # one fold: first each reserved intent's rows, of which one is taken, then all rows
    phases = F.array(*[F.when(F.array_contains("i", x), F.lit(n)) for n, x in enumerate(reserved)], F.lit(len(reserved)))
    turns = cand.withColumn("phase", F.explode(F.filter(phases, lambda x: x.isNotNull())))
    rows = turns.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("phase", (-F.col("p")).alias("o"), "id", "d", "c"))).alias("rows"))
    start = F.struct(F.lit(-1).alias("last"), F.filter("rows", lambda x: F.lit(False)).alias("kept"))

    def step(a, x):
        room = (F.size(a["kept"]) < limit) & ((x["phase"] == len(reserved)) | (a["last"] < x["phase"]))
        fits = (F.size(F.filter(a["kept"], lambda y: y["d"] == x["d"])) < per_domain) & ~F.exists(a["kept"], lambda y: (y["c"] == x["c"]) | (y["id"] == x["id"]))
        return F.when(room & fits, F.struct(x["phase"].alias("last"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)

    done = rows.select(*by, F.aggregate("rows", start, step)["kept"].alias("kept"))
    return done.select(*by, F.posexplode("kept").alias("position", "x")).select(*by, (F.col("position") + 1).alias("position"), F.col("x.id").alias(key), (-F.col("x.o")).alias("priority"), F.col("x.d").alias("domain"))


def with_judgments(chunks: DataFrame, judgments: DataFrame, keys: list[str]) -> DataFrame:
    """The first judgment of each chunk; irrelevant with confidence 0 where there is none. judgments: keys, position, stance, confidence."""
    first = judgments.groupBy(*keys).agg(F.min_by(F.struct("stance", "confidence"), "position").alias("j"))
    joined = chunks.join(first, keys, "left")
    return joined.withColumn("stance", F.coalesce("j.stance", F.lit("irrelevant"))).withColumn("confidence", F.coalesce("j.confidence", F.lit(0.0))).drop("j")


def context_score(combined: Column, confidence: Column, stance: Column) -> Column:
    """0.42 of the retrieval score, 0.32 of the confidence, and a boost by stance."""
    return combined * 0.42 + confidence * 0.32 + X.lookup(stance, {"supports": 0.48, "contradicts": 0.48, "background": 0.16}, 0.0)


def select_context(judged: DataFrame, by: list[str], key: str, k: int = 8) -> DataFrame:
    """The best chunks that aren't irrelevant."""
    scored = judged.where(F.col("stance") != "irrelevant").withColumn("context_score", context_score(F.col("combined"), F.col("confidence"), F.col("stance")))
    return best_per(scored, by, [F.desc("context_score"), F.col(key)], k)


def has_direct_evidence(stance: Column, confidence: Column, combined: Column) -> Column:
    """F7, an aggregate."""
    return F.bool_or(stance.isin("supports", "contradicts") & (confidence >= 0.55) & (combined >= 0.32))


def citation_audit(sentences: DataFrame, selected: Column) -> DataFrame:
    """What a sentence cites that wasn't selected, and whether it cites nothing. selected: array of chunk ids."""
    unknown = F.array_except("citation_ids", selected)
    return sentences.withColumn("unknown", unknown).withColumn("uncited", F.coalesce(F.size("citation_ids"), F.lit(0)) == 0).withColumn("passed", (F.size(unknown) == 0) & ~F.col("uncited"))


def running_signals(df: DataFrame, by: list[str], order: list[Column], domain: str, title: str) -> DataFrame:
    """How many earlier rows have the same domain and the same title. df: one row for each accepted URL."""
    before = lambda c: Window.partitionBy(*by, c).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("same_domain", F.count(F.lit(1)).over(before(domain))).withColumn("same_title", F.count(F.lit(1)).over(before(title)))


def best_of(df: DataFrame, keys: list[str], priority: Column, position: Column) -> DataFrame:
    """One row of each key, that of the highest priority, the first of equals."""
    return best_per(df, keys, [priority.desc(), position], 1, "__best").drop("__best")


