"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample by balanced k-means. A vector goes to its nearest centroid's list and, near a
boundary, to the lists of other centroids that are nearly as near (replicas, without lists that lie in the same direction). A
query walks an in-memory graph of the centroids from a few entry points, best first, and searches all lists whose centroid's
distance is at most `ratio` times the nearest one's. Lists longer than a block are split in blocks. Scores are exact inner
products of the original vectors.

Cases: see usable() for vectors that take no part, and zero vectors; queries without other vectors give no rows; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import blocks_of, matrix, packed, ranked, streamed_top, unpacked, usable

#: Vectors that the centroids are fitted on, at most; those with the smallest hashes.
SAMPLE = 20_000


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Balanced k-means on directions: a list that holds more than its share is made to look further away."""
    rng = np.random.default_rng(seed)
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centre = x[rng.permutation(len(x))[:count]]
    burden = np.zeros(len(centre))
    for _ in range(rounds):
        own = np.argmin(2 - 2 * (x @ centre.T) + burden, axis=1)
        size = np.bincount(own, minlength=len(centre))
        burden += 0.05 * (size / (len(x) / len(centre)) - 1)
        burden = np.clip(burden, 0, 0.5)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.where(norm > 0, norm, 1), x[rng.integers(len(x), size=len(centre))])
    return centre


class CentroidGraph:
    """Each centroid with its nearest neighbours and a few far ones, so that the graph hangs together."""

    def __init__(self, centre: np.ndarray, degree: int = 16):
        self.centre = centre
        near = np.argsort(-(centre @ centre.T), axis=1, kind="stable")[:, 1 : degree + 1]
        ring = (np.arange(len(centre))[:, None] + np.array([1, -1])) % len(centre)
        self.links = [np.unique(np.concatenate((a, b))) for a, b in zip(near, ring, strict=True)]
        self.entries = np.unique(np.linspace(0, len(centre) - 1, min(8, len(centre))).astype(int))

    def within(self, x: np.ndarray, ratio: float, spare: int = 8, least: int = 3) -> list[int]:
        """Centroids at most ratio times as far from the unit vector x as the nearest, and `least` in any case; walks on
        until `spare` expansions in turn bring none."""
        far = np.maximum(2 - 2 * (self.centre[self.entries] @ x), 0)
        seen = dict(zip(self.entries.tolist(), far.tolist(), strict=True))
        heap = [(d, i) for i, d in seen.items()]
        heapq.heapify(heap)
        best, idle = min(seen.values()), 0
        while heap and idle < spare:
            d, i = heapq.heappop(heap)
            idle = idle + 1 if d > best * ratio * ratio + 1e-12 else 0
            new = [j for j in self.links[i].tolist() if j not in seen]
            if new:
                for j, dj in zip(new, np.maximum(2 - 2 * (self.centre[new] @ x), 0).tolist(), strict=True):
                    seen[j] = dj
                    best = min(best, dj)
                    heapq.heappush(heap, (dj, j))
        limit = max(best * ratio * ratio + 1e-12, sorted(seen.values())[: least][-1])
        return [j for j, d in seen.items() if d <= limit]


def replicas(x: np.ndarray, centre: np.ndarray, boundary: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the nearest centroid's list, and up to `most` in all at most `boundary` times as far, skipping a
    centroid that is nearer to one already taken than to the vector."""
    d = np.maximum(2 - 2 * (x @ centre.T), 0)
    take = min(most * 2, len(centre))
    order = np.argpartition(d, take - 1, axis=1)[:, :take] if take < len(centre) else np.broadcast_to(np.arange(len(centre)), d.shape)
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(d, order, 1), axis=1, kind="stable"), 1)
    near = np.take_along_axis(d, order, 1)
    between = np.maximum(2 - 2 * (centre @ centre.T), 0)
    rows, lists = [np.arange(len(x))], [order[:, 0]]
    taken = np.zeros(order.shape, bool)
    taken[:, 0] = True
    for j in range(1, take):
        ok = (near[:, j] <= near[:, 0] * boundary * boundary) & (taken.sum(axis=1) < most)
        for i in range(j):
            ok &= ~taken[:, i] | (between[order[:, i], order[:, j]] > near[:, j])
        taken[:, j] = ok
        rows.append(np.flatnonzero(ok)), lists.append(order[ok, j])
    return np.concatenate(rows), np.concatenate(lists)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors with one more component, among which nearness to a lifted query is the inner product with x."""
    x = x / longest
    return np.concatenate((x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1, keepdims=True), 0))), axis=1)


def _asked(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))), axis=1)


def _assign(centre: np.ndarray, longest: float, boundary: float, most: int):
    def run(batches):
        for b in batches:
            for first in range(0, b.num_rows, 2048):
                part = b.slice(first, 2048)
                rows, lists = replicas(lifted(matrix(part.column("embedding")), longest), centre, boundary, most)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(at), part.column("embedding").take(at), pa.array(lists.astype(np.int32))], ["vec_id", "embedding", "list"])

    return run


def _route(centre: np.ndarray, ratio: float):
    graph = CentroidGraph(centre)

    def run(batches):
        for b in batches:
            x = _asked(matrix(b.column("embedding")))
            found = [sorted(graph.within(v, ratio)) for v in x]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(np.argmax(x @ centre.T, axis=1).astype(np.int32)), pa.array(found, pa.list_(pa.int32()))], ["vec_id", "embedding", "home", "lists"])

    return run


def _score(held: dict, row: dict):
    ids, mat = unpacked(row["c_ids"], row["c_mat"])
    who = np.flatnonzero(np.isin(held["ids"], np.frombuffer(row["askers"], np.int64)))
    for first in range(0, len(who), 256):
        rows = who[first : first + 256]
        s = held["mat"][rows] @ mat.T
        yield rows, np.where(held["ids"][rows][:, None] == ids[None, :], -np.inf, s), ids


def ann_search(embeddings: DataFrame, is_query: Column, k: int = 20, list_size: int = 400, most_lists: int = 1024, boundary: float = 1.15, most_replicas: int = 3, ratio: float = 1.2, query_block: int = 1024, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with is_query, the k nearest other rows found, by inner product."""
    every = usable(embeddings).where(F.exists("embedding", lambda x: x != 0.0))
    every = materialize(every, "vectors")
    n, m = every.count(), every.where(is_query).count()
    if n < 2 or not m:
        return every.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    some = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()
    longest = every.agg(F.sqrt(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    sample = lifted(np.stack(some["embedding"].to_numpy()), longest)
    centre = fit_centroids(sample, int(min(most_lists, max(1, n // list_size), len(sample))))
    posted = materialize(every.mapInArrow(_assign(centre, longest, boundary, most_replicas), "vec_id long, embedding array<double>, list int"), "posted")
    sizes = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))  # at most most_lists rows
    lists = posted.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    lists = materialize(packed(lists, ["list", "part"], "c"), "lists")
    routed = materialize(every.where(is_query).mapInArrow(_route(centre, ratio), "vec_id long, embedding array<double>, home int, lists array<int>"), "routed")
    # queries of neighbouring lists share a block; a list with many queries has several
    homes = routed.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("parts"))
    routed = routed.join(F.broadcast(homes), "home").withColumn("q", F.xxhash64(F.floor(F.col("home") * F.lit(blocks_of(m, query_block)) / F.lit(len(centre))), F.pmod(F.xxhash64("vec_id"), F.col("parts"))))
    q = packed(routed, ["q"], "q")
    asks = routed.select("q", "vec_id", F.explode("lists").alias("list")).groupBy("q", "list").agg(F.collect_list("vec_id").alias("a"))  # at most a block's queries
    asks = asks.mapInArrow(_ids, "q long, list int, askers binary")
    pairs = lists.join(asks, "list").select("q", "c_ids", "c_mat", "askers").hint("merge").join(q, "q")
    return ranked(streamed_top(pairs, _score, k, "entries").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k, F.col("score"))


def _ids(batches):
    for b in batches:
        raw = [np.array(x, np.int64).tobytes() for x in b.column("a").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("list"), pa.array(raw, pa.binary())], ["q", "list", "askers"])


def op8(spark, sf_dir: str) -> DataFrame:
    return ann_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
