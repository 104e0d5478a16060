"""Blocks of vectors: what exact and approximate search share.

Vectors travel as rows of packed blocks. A block of queries meets blocks of candidates by an equi-join; a worker streams over
the pairs and keeps one running top-k for each query, so it holds two blocks at a time and gives k rows for each query and run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding: one row for each vec_id (the smallest vector of repeated ones); without null ids and vectors,
    vectors with null or non-finite components, empty ones, and ones whose length isn't the most frequent."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    e = e.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad)
    lengths = e.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is not None:
        e = e.where(F.size("embedding") == lengths["d"])
    return e.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def packed(df: DataFrame, keys: list[str], name: str, extra: str | None = None) -> DataFrame:
    """A row for each group: its keys, and in <name>_ids, <name>_mat (and <name>_extra, of longs) its vectors, by vec_id."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("vec_id")
        out = {k: [table.column(k)[0].as_py()] for k in keys}
        out |= {f"{name}_ids": [table.column("vec_id").to_numpy().astype(np.int64).tobytes()], f"{name}_mat": [matrix(table.column("embedding")).tobytes()]}
        if extra:
            out[f"{name}_extra"] = [table.column(extra).to_numpy().astype(np.int64).tobytes()]
        return pa.table(out, schema=pa.schema([(k, table.schema.field(k).type) for k in keys] + [(c, pa.binary()) for c in out if c not in keys]))

    kinds = dict(df.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{name}_ids binary, {name}_mat binary"] + [f"{name}_extra binary"] * bool(extra))
    return df.select(*keys, "vec_id", "embedding", *([extra] if extra else [])).groupBy(*keys).applyInArrow(run, schema)


def unpacked(ids: bytes, mat: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(mat, np.float64).reshape(len(i), -1)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of scores, by score, then smaller id; ids: of the columns, or of each cell."""
    ids = np.broadcast_to(ids, scores.shape)
    if scores.shape[1] > 4 * k:
        # ties at the cutoff are settled by id, so all of them stay for the sort
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        keep = scores >= cut[:, None]
        width = int(keep.sum(axis=1).max())
        if width <= scores.shape[1] // 2:
            row, col = np.nonzero(keep)
            place = np.arange(len(row)) - np.searchsorted(row, row)
            s, i = np.full((len(scores), width), -np.inf), np.full((len(scores), width), np.iinfo(np.int64).max)
            s[row, place], i[row, place] = scores[row, col], ids[row, col]
            scores, ids = s, i
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


Scorer = Callable[[np.ndarray, np.ndarray, dict], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def streamed_top(pairs: DataFrame, score: Scorer, k: int, per_query: str) -> DataFrame:
    """query_id, vec_id, score: for each query block (key q) the running top-k over the candidate blocks that come with it.

    score(queries, candidates, row) gives (query rows, scores, ids) tiles; -inf marks what takes no part. per_query: "entries"
    or "kth", which gives a query's lists of scores alone (query_id, scores).
    """

    def run(batches):
        held = None
        for b in batches:
            for row in b.to_pylist():
                if held is None or held["q"] != row["q"]:
                    yield from flush(held)
                    ids, mat = unpacked(row["q_ids"], row["q_mat"])
                    extra = np.frombuffer(row["q_extra"], np.int64) if row.get("q_extra") is not None else None
                    held = {"q": row["q"], "ids": ids, "mat": mat, "extra": extra, "s": np.full((len(ids), k), -np.inf), "v": np.full((len(ids), k), np.iinfo(np.int64).max)}
                for rows, s, v in score(held, row):
                    s, v = top(s, v, k)
                    s, v = np.concatenate((held["s"][rows], s), 1), np.concatenate((held["v"][rows], v), 1)
                    order = np.lexsort((v, -s), axis=1)
                    s, v = np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)
                    # a candidate may come more than once, from replicas
                    again = np.zeros(s.shape, bool)
                    again[:, 1:] = (v[:, 1:] == v[:, :-1]) & (s[:, 1:] == s[:, :-1])
                    if again.any():
                        s = np.where(again, -np.inf, s)
                        order = np.lexsort((v, -s), axis=1)
                        s, v = np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)
                    held["s"][rows], held["v"][rows] = s[:, :k], v[:, :k]
        yield from flush(held)

    def flush(held):
        if held is None:
            return
        row, col = np.nonzero(held["s"] > -np.inf)
        if per_query == "entries":
            yield pa.RecordBatch.from_pydict({"query_id": held["ids"][row], "vec_id": held["v"][row, col], "score": held["s"][row, col]})
        else:
            some = np.bincount(row, minlength=len(held["ids"]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some))), pa.int32()), pa.array(held["s"][row, col]))
            yield pa.RecordBatch.from_arrays([pa.array(held["ids"]), lists], ["query_id", "scores"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score double" if per_query == "entries" else "query_id long, scores array<double>")


def ranked(entries: DataFrame, k: int, score: Column) -> DataFrame:
    """query_id, rank, vec_id, score of the k best entries of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = entries.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", score.alias("score"))


def blocks_of(n: int, size: int) -> int:
    return max(1, -(-n // size))


