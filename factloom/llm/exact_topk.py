"""Exact top-k by inner product of integer vectors, by a three-phase uniform threshold.

The components are dealt into `lists` groups; a candidate's score is the sum of its partial scores in the groups, each a local
list. Candidates lie in blocks of near vectors (those of one pivot), queries in blocks of near pivots.

Phase 1 gathers the k best entries of every local list for the few pivots that lie nearest to a query block, and completes them:
the k-th best of any candidates is a cutoff that is safe. Phase 2 gives each query block its cutoffs; a candidate that reaches
a cutoff has a partial score of at least cutoff / lists in some list, so only blocks are read in which, by pivot and
radius of each list, such an entry may lie and the sum of bounds reaches the cutoff; there the lists give these entries.
Phase 3 resolves the entries' remaining scores exactly, and ranks. Vectors that form no clusters let no block be skipped;
then phase 2 reads all.

Cases: see usable() for vectors that take no part; queries without other vectors give no rows; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import blocks_of, matrix, packed, ranked, streamed_top, unpacked, usable

TILE = 256
#: Pivots, at most: a bounded sample that only shapes the blocks. They and a radius for each of their lists travel to all workers.
PIVOTS = 1024


def _spans(width: int, lists: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, width, lists + 1).astype(int)
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]


def _partials(held: dict, row: dict, lists: int):
    """Tiles of (query rows, ids, own, query vectors, candidate vectors, [partial scores of each list])."""
    ids, mat = unpacked(row["c_ids"], row["c_mat"])
    exact = np.float32 if np.abs(mat).max(initial=0) * np.abs(held["mat"]).max(initial=0) * mat.shape[1] < 2**24 else np.float64
    mat = mat.astype(exact)
    turned = mat.T.copy()
    for first in range(0, len(held["ids"]), TILE):
        rows = np.arange(first, min(first + TILE, len(held["ids"])))
        q = held["mat"][rows].astype(exact)
        parts = (q[:, a:b] @ turned[a:b] for a, b in _spans(mat.shape[1], lists))
        yield rows, ids, held["ids"][rows][:, None] == ids[None, :], q, mat, parts


def _resolved(entry: np.ndarray, q: np.ndarray, mat: np.ndarray) -> np.ndarray:
    """Whole scores of the entries, -inf elsewhere."""
    if entry.mean() > 0.05:
        return np.where(entry, q @ mat.T, -np.inf).astype(np.float64)
    out = np.full(entry.shape, -np.inf)
    r, c = np.nonzero(entry)
    out[r, c] = np.einsum("ij,ij->i", q[r], mat[c])
    return out


def _gather(k: int, lists: int):
    def score(held, row):
        for rows, ids, own, q, mat, parts in _partials(held, row, lists):
            seen = np.zeros(own.shape, bool)
            for p in parts:
                if p.shape[1] > k + 1:  # one may be the query's own
                    np.put_along_axis(seen, np.argpartition(p, p.shape[1] - k - 1, axis=1)[:, -k - 1 :], True, 1)
                else:
                    seen[:] = True
            yield rows, _resolved(seen & ~own, q, mat), ids

    return score


def _collect(lists: int):
    def score(held, row):
        for rows, ids, own, q, mat, parts in _partials(held, row, lists):
            cutoff = held["extra"][rows][:, None].astype(np.float64)
            entry, n = np.zeros(own.shape, bool), len(_spans(mat.shape[1], lists))
            for p in parts:
                entry |= p * float(n) >= cutoff
            entry &= ~own
            keep = np.flatnonzero(entry.any(axis=1))
            if len(keep):
                total = _resolved(entry[keep], q[keep], mat)
                yield rows[keep], np.where(total >= cutoff[keep], total, -np.inf), ids

    return score


def _pivot_rows(pivots: np.ndarray, lists: int):
    """vec_id, embedding, the pivot with the largest inner product for its length, and in each list the distance from it."""
    unit = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-9)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("embedding"))
                at = (x @ unit.T).argmax(1).astype(np.int64)
                far = np.stack([np.linalg.norm((x - pivots[at])[:, a:z], axis=1) for a, z in _spans(x.shape[1], lists)], axis=1)
                far = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * far.shape[1], pa.int32()), pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), far], [*b.schema.names, "pivot", "far"])

    return run


def _chained(pivots: np.ndarray) -> np.ndarray:
    """Places of the pivots in a chain, each with its nearest one that is left."""
    unit = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-9)
    near, place, now = unit @ unit.T, np.full(len(unit), -1), 0
    for i in range(len(unit)):
        place[now] = i
        now = int(np.where(place < 0, near[now], -np.inf).argmax())
    return place


def list_bounds(q: np.ndarray, pivots: np.ndarray, far: np.ndarray) -> list[np.ndarray]:
    """queries x pivots for each list: no vector of the pivot has a larger partial score."""
    spans = _spans(q.shape[1], far.shape[1])
    return [q[:, a:b] @ pivots[:, a:b].T + np.linalg.norm(q[:, a:b], axis=1)[:, None] * far[None, :, i] * (1 + 1e-9) + 1e-6 for i, (a, b) in enumerate(spans)]


def _needed(pivots: np.ndarray, far: np.ndarray, nearest: int | None):
    """(q, pivot): the `nearest` pivots of each query block; or, with cutoffs, all with which one of its queries may find an entry."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                _, mat = unpacked(row["q_ids"], row["q_mat"])
                bounds = list_bounds(mat, pivots, far)
                if nearest is not None:
                    met = np.argsort(-sum(bounds).mean(axis=0), kind="stable")[:nearest]
                else:
                    cutoff = np.frombuffer(row["q_extra"], np.int64).astype(np.float64)[:, None]
                    some = np.zeros(bounds[0].shape, bool)
                    for x in bounds:
                        some |= x * len(bounds) >= cutoff
                    met = np.flatnonzero((some & (sum(bounds) >= cutoff)).any(axis=0))
                yield pa.RecordBatch.from_pydict({"q": pa.array([row["q"]] * len(met), pa.int64()), "pivot": pa.array(met, pa.int64())})

    return run


def exact_topk(embeddings: DataFrame, is_query: Column, k: int = 20, lists: int = 4, query_block: int = 2048, block: int = 4096, nearest: int = 8, lane: int = 16, watch: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (long): for each row with is_query, the k best other rows by the inner product of floor(64 x).

    A task works on one query block and about `lane` candidate blocks. watch: gets the numbers of blocks read by the phases.
    """
    every = usable(embeddings).withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * F.lit(64.0)).cast("double")))
    every = materialize(every, "integers")
    n, m = every.count(), every.where(is_query).count()
    sample = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(PIVOTS, blocks_of(4 * n, block))).collect()
    if not sample:
        return every.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    pivots = np.array([r["embedding"] for r in sample])
    spans = len(_spans(pivots.shape[1], lists))
    every = materialize(every.mapInArrow(_pivot_rows(pivots, lists), "vec_id long, embedding array<double>, pivot long, far array<double>"), "pivots")
    size = every.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.array(*[F.max(F.col("far")[i]) for i in range(spans)]).alias("far"))
    far = np.full((len(pivots), spans), -np.inf)  # without vectors: no bound reaches anything
    for r in size.collect():
        far[r["pivot"]] = r["far"]
    c = every.join(F.broadcast(size.select("pivot", "size")), "pivot").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("size") / block)))
    c = materialize(packed(c, ["pivot", "part"], "c"), "blocks")
    count = c.count()

    place = _chained(pivots)
    together = max(1, query_block * len(pivots) // max(m, 1))  # neighbouring pivots' queries share a block
    group = F.element_at(F.lit([int(p) // together for p in place]), (F.col("pivot") + 1).cast("int")).cast("long")
    queries = every.where(is_query).withColumn("group", group)
    parts = queries.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("parts"))
    queries = queries.join(F.broadcast(parts), "group").withColumn("q", F.col("group") + len(pivots) * F.pmod(F.xxhash64("vec_id", F.lit("q")), F.col("parts")))
    queries = materialize(queries.select("vec_id", "embedding", "q"), "queries")

    def met(q: DataFrame, near: int | None) -> DataFrame:
        """Query blocks with the candidate blocks that they need, in lanes."""
        pairs = materialize(q.mapInArrow(_needed(pivots, far, near), "q long, pivot long"), "pairs")
        blocks = c.select("pivot", "part").join(pairs, "pivot")
        if watch is not None:
            watch["gather" if near else "collect"] = blocks.count(), q.count() * count
        lane_ = F.pmod(F.xxhash64("pivot", "part"), F.lit(blocks_of(count, lane)))
        left = c.join(pairs, "pivot").withColumn("task", F.concat_ws("/", "q", lane_)).select("task", "c_ids", "c_mat")
        right = q.join(blocks.select("q", F.concat_ws("/", "q", lane_).alias("task")).distinct(), "q")
        return left.hint("merge").join(right, "task").drop("task")

    gathered = streamed_top(met(materialize(packed(queries, ["q"], "q"), "query_blocks"), nearest), _gather(k, lists), k, "kth")
    cutoffs = gathered.groupBy("query_id").agg(F.try_element_at(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), F.lit(k)).cast("long").alias("cutoff"))
    with_cut = queries.join(cutoffs.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(-(1 << 62))))
    entries = streamed_top(met(materialize(packed(with_cut, ["q"], "q", "cutoff"), "cut_blocks"), None), _collect(lists), k, "entries")
    return ranked(entries, k, F.col("score").cast("long"))


def op7(spark, sf_dir: str) -> DataFrame:
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
