"""Hard negatives by a distributed kNN join over a Voronoi partition.

Vectors get one more component, which gives all of them the same length, so that nearness to an anchor (with 0 there) is the inner
product. A bounded sample gives the pivots; each vector lies in the cell of its nearest pivot, and each anchor belongs to a group of
neighbouring pivots. For a cell the least and largest distance from its pivot are known. With them, and with the plane between two
pivots, a cell's scores with an anchor are bounded from both sides; a cell's blocks are replicated only to anchor groups of which
some anchor may find a wanted score there. A task then joins one group with some blocks exactly, and skips, block by block, the
anchors that the bounds let go.

Four such joins: the nearest cells give the k-th score of positives, a safe cutoff; with it all positives are found; each positive
gives its anchor a band of scores, and the same two steps find the best vectors of other labels in each band.

Cases: rows with a null label or vector, or a null or non-finite component, take no part. Shorter vectors count as filled up with
zeros. Repeated rows are rows of their own; rows with the anchor's vec_id are not its matches, a null vec_id is nobody's anchor and
comes first among ties. A positive with a score below 0 has no negatives, one of 0 those of 0. No anchors, or an empty table, give
no rows. Other columns are not read. Scores are exact up to 53 bits; larger ones are taken in doubles and cut at 62.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .exact_topk import _chained
from .vector_rows import filled, usable_rows
from .vectors import blocks_of, top

#: Pivots, at most: a bounded sample that only shapes the cells. They and each cell's two distances travel to all workers.
PIVOTS = 1024
TILE = 256
MOST = 1 << 62


class Cells:
    """The pivots, with the component that makes lengths equal, and the distances from them that occur in their cells."""

    def __init__(self, pivots: np.ndarray, square: float):
        self.width, self.square = pivots.shape[1], square
        self.pivots = self.lifted(pivots)
        self.least, self.most = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(self.square - (x * x).sum(axis=1, keepdims=True), 0))), axis=1)

    def own(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell and its distance from the pivot."""
        s = self.lifted(x) @ self.pivots.T
        at = s.argmax(axis=1)
        return at, np.sqrt(np.maximum(2 * (self.square - s[np.arange(len(x)), at]), 0))

    def home(self, q: np.ndarray) -> np.ndarray:
        return (q @ self.pivots[:, : self.width].T).argmax(axis=1)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """anchors x cells: no vector of the cell has a smaller, or a larger score with the anchor. Empty cells: (inf, -inf)."""
        both = (q * q).sum(axis=1, keepdims=True) + self.square
        slack = 1e-6 * np.sqrt(self.square) + 1e-9
        d = np.sqrt(np.maximum(both - 2 * (q @ self.pivots[:, : self.width].T), 0))
        near = np.maximum(np.maximum(d - self.most - slack, self.least - slack - d), 0)
        home = d.argmin(axis=1)
        apart = np.sqrt(np.maximum(2 * (self.square - self.pivots[home] @ self.pivots.T), 0))
        plane = np.divide(d * d - d[np.arange(len(q)), home][:, None] ** 2, 2 * apart, out=np.zeros_like(d), where=apart > slack)
        near = np.maximum(near, plane - slack)
        far = d + self.most + slack
        some = self.most >= 0
        rounding = 1e-9 * both + 0.01
        return np.where(some, (both - far * far) / 2 - rounding, np.inf), np.where(some, (both - near * near) / 2 + rounding, -np.inf)


def _places(cells: Cells):
    """A row's cell, its distance from the pivot, and its home as an anchor."""

    def run(batches):
        for b in batches:
            for first in range(0, b.num_rows, 4096):
                part = b.slice(first, 4096)
                x = filled(part.column("embedding"), cells.width, 0).astype(np.float64)
                at, far = cells.own(x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at.astype(np.int32)), pa.array(far), pa.array(cells.home(x).astype(np.int32))], [*part.schema.names, "cell", "far", "home"])

    return run


def _raw(x: np.ndarray) -> tuple[bytes, bool]:
    small = bool(np.abs(x).max(initial=0) < 2**15)
    return x.astype(np.int16 if small else np.int64).tobytes(), small


def _packed(df: DataFrame, keys: list[str], width: int, others: list[str]) -> DataFrame:
    """A row for each group: its keys, its vectors as whole numbers, and other columns (longs, or arrays of them) as bytes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        mat, small = _raw(filled(table.column("embedding"), width, 0))
        out = {k: table.column(k).slice(0, 1).cast(pa.int64()) for k in keys} | {"mat": pa.array([mat], pa.binary()), "small": pa.array([small])}
        for c in others:
            column = table.column(c).combine_chunks()
            flat = column.flatten() if pa.types.is_list(column.type) else column
            out[c] = pa.array([flat.fill_null(-MOST).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary())
        return pa.table(out)

    schema = ", ".join([f"{k} long" for k in keys] + ["mat binary, small boolean"] + [f"{c} binary" for c in others])
    return df.select(*keys, "embedding", *others).groupBy(*keys).applyInArrow(run, schema)


def _matrix(row: dict, width: int) -> np.ndarray:
    return np.frombuffer(row["mat"], np.int16 if row["small"] else np.int64).reshape(-1, width)


def _longs(raw: bytes, rows: int | None = None) -> np.ndarray:
    x = np.frombuffer(raw, np.int64)
    return x if rows is None else x.reshape(rows, -1)


def _wanted(cells: Cells, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """anchors x cells: where a score of one of the anchor's bands may lie."""
    least, most = cells.bounds(q)
    out = np.zeros(least.shape, bool)
    for i in range(low.shape[1]):
        open_ = (low[:, i] <= high[:, i])[:, None]
        out |= open_ & (most >= low[:, i][:, None]) & (least <= high[:, i][:, None])
    return out


def _needed(cells: Cells, nearest: int | None):
    """(group, cell): the cells that a group's anchors may need, or the `nearest` of them."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                q = _matrix(row, cells.width).astype(np.float64)
                low, high = (_longs(row[c], len(q)) for c in ("low", "high"))
                some, near = np.zeros(len(cells.pivots), bool), np.zeros(len(cells.pivots))
                for first in range(0, len(q), 1024):
                    part = slice(first, first + 1024)
                    some |= _wanted(cells, q[part], low[part], high[part]).any(axis=0)
                    near += (q[part] @ cells.pivots[:, : cells.width].T).sum(axis=0)
                met = np.flatnonzero(some)
                if nearest is not None:
                    met = met[np.argsort(-near[met], kind="stable")[:nearest]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), row["group"])), pa.array(met)], ["group", "cell"])

    return run


def _join(cells: Cells, same: bool, k: int):
    """The local join of one group with its blocks: the k best scores of every band, among equal or among other labels."""

    def run(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in anchors.to_pylist():
            mat = _matrix(row, cells.width)
            who, ids, labels = (_longs(row[c]) for c in ("row", "vec_id", "label"))
            low, high = (_longs(row[c], len(mat)) for c in ("low", "high"))
            bands = low.shape[1]
            s, v = np.full((len(mat), bands, k), -np.inf), np.full((len(mat), bands, k), np.iinfo(np.int64).max)
            for n in range(blocks.num_rows):
                block = blocks.slice(n, 1).to_pylist()[0]
                c, c_ids, c_labels = _matrix(block, cells.width), _longs(block["vec_id"]), _longs(block["label"])
                size = float(np.abs(c).max(initial=0)) * float(np.abs(mat).max(initial=0)) * cells.width
                exact = np.float32 if size < 2**24 else np.float64
                turned = c.astype(exact).T
                need = np.concatenate([_wanted(cells, mat[i : i + 1024].astype(np.float64), low[i : i + 1024], high[i : i + 1024])[:, block["cell"]] for i in range(0, len(mat), 1024)])
                need = np.flatnonzero(need)
                for first in range(0, len(need), TILE):
                    at = need[first : first + TILE]
                    score = np.clip(mat[at].astype(exact) @ turned, -MOST, MOST)
                    fits = (labels[at][:, None] == c_labels[None, :]) == same
                    fits &= ids[at][:, None] != c_ids[None, :]
                    for i in range(bands):
                        ok = fits & (score >= low[at, i][:, None]) & (score <= high[at, i][:, None])
                        some = np.flatnonzero(ok.any(axis=1))
                        if len(some):
                            a, b = top(np.where(ok[some], score[some].astype(np.float64), -np.inf), c_ids, k)
                            a, b = np.concatenate((s[at[some], i], a), axis=1), np.concatenate((v[at[some], i], b), axis=1)
                            order = np.lexsort((b, -a), axis=1)[:, :k]
                            s[at[some], i], v[at[some], i] = np.take_along_axis(a, order, 1), np.take_along_axis(b, order, 1)
            r, i, n = np.nonzero(s > -np.inf)
            out.append((who[r], i.astype(np.int32), v[r, i, n], s[r, i, n].astype(np.int64)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        return pa.table(dict(zip(("row", "band", "vec_id", "score"), columns, strict=True)))

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row", "band").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), scale: int = 256, nearest: int = 8, query_block: int = 16_384, block: int = 1024, lane: int = 16, watch: dict | None = None
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. A negative's score is between band[0] and band[1]
    hundredths of its positive's. A task joins one group of at most about `query_block` anchors with about `lane` blocks.
    watch: gets the blocks that each of the four joins reads, and all they might."""
    rows = usable_rows(embeddings, "label").where(F.col("label").isNotNull())
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale)))))
    nothing = rows.limit(0).select(F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.lit(0).alias("rank"), F.col("vec_id").alias("negative_id"), F.col("vec_id").alias("positive_score"), F.col("vec_id").alias("negative_score"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width"), F.max(square).alias("square")).first()
    if not head["n"] or not head["width"]:
        return nothing
    sample = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(min(PIVOTS, blocks_of(2 * head["n"], block))).select("embedding").collect()
    pivots = np.zeros((len(sample), head["width"]))
    for i, r in enumerate(sample):
        pivots[i, : len(r["embedding"])] = r["embedding"]
    cells = Cells(np.unique(pivots, axis=0), float(head["square"]))

    place = _chained(cells.pivots[:, : cells.width])
    put = rows.mapInArrow(_places(cells), "vec_id long, label long, embedding array<long>, cell int, far double, home int")
    # a row's place in the written table names it, so repeated rows stay apart
    put = materialize(put.withColumn("row", F.monotonically_increasing_id()).withColumn("anchor", F.coalesce(is_anchor, F.lit(False))), "places")
    size = put.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).collect()  # at most PIVOTS rows
    parts = np.ones(len(cells.pivots), int)
    for r in size:
        cells.least[r["cell"]], cells.most[r["cell"]], parts[r["cell"]] = r["least"], r["most"], blocks_of(r["n"], block)
    of = lambda values, key: F.element_at(F.lit([int(x) for x in values]), F.col(key) + 1)
    dealt = put.withColumn("part", F.pmod(F.xxhash64("row"), of(parts, "cell")))
    blocks = materialize(_packed(dealt, ["cell", "part"], cells.width, ["vec_id", "label"]), "cells")
    count = int(parts.sum())

    homes = {r["home"]: r["n"] for r in put.where("anchor").groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most PIVOTS rows
    if not homes:
        return nothing
    # neighbouring pivots' anchors share a group, a crowded pivot's have several
    group, split, filling, last = np.zeros(len(place), int), np.ones(len(place), int), 0, 0
    for p in np.argsort(place):
        n = homes.get(int(p), 0)
        if filling and filling + n > query_block:
            last, filling = last + split.max(), 0
        group[p], split[p] = last, blocks_of(n, query_block)
        filling += n
    anchors = put.where("anchor").select("row", "vec_id", "label", "embedding", (of(group, "home") + F.pmod(F.xxhash64("row"), of(split, "home"))).alias("group"))
    lanes = blocks_of(count, lane)

    def found(bounds: DataFrame | None, same: bool, k: int, near: int | None) -> DataFrame:
        """row, band, vec_id, score, rank. bounds: row, low and high, an element for each band of a row."""
        if bounds is None:
            asked = anchors.withColumn("low", F.array(F.lit(-MOST))).withColumn("high", F.array(F.lit(MOST)))
        else:
            asked = anchors.join(bounds, "row")
        asked = materialize(_packed(asked, ["group"], cells.width, ["row", "vec_id", "label", "low", "high"]), "anchors")
        pairs = asked.mapInArrow(_needed(cells, near), "group long, cell long")
        tasks = blocks.join(materialize(pairs, "needed"), "cell").withColumn("lane", F.pmod(F.xxhash64("cell", "part"), F.lit(lanes)))
        if watch is not None:
            watch.setdefault("read", []).append((tasks.count(), asked.count() * count))
        left = asked.withColumnRenamed("group", "g").join(tasks.select(F.col("group").alias("g"), F.col("lane").alias("l")).distinct(), "g")
        join = left.groupBy("g", "l").cogroup(tasks.groupBy("group", "lane")).applyInArrow(_join(cells, same, k), "row long, band int, vec_id long, score long")
        return _best(join, k)

    every = lambda bounds, same, k: found(bounds, same, k, nearest)
    cut = every(None, True, positives).where(F.col("rank") == positives).select("row", F.col("score").alias("cut"))
    bounds = anchors.select("row").join(cut, "row", "left").select("row", F.array(F.coalesce("cut", F.lit(-MOST))).alias("low"), F.array(F.lit(MOST)).alias("high"))
    positive = materialize(found(bounds, True, positives, None).select("row", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    p = F.col("positive_score").cast("decimal(20,0)")
    low, high = (p * F.lit(Decimal(x) / 100) for x in band)
    band_of = positive.select("row", "place", F.ceil(low).cast("long").alias("low"), F.floor(high).cast("long").alias("high"))
    whole = lambda c, d: F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda x: x[d])
    # a row has fewer bands than `positives` where its label is rare; closed ones fill it up
    closed = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.lit(positives) - F.size(c)))
    bands = band_of.groupBy("row").agg(whole("low", "low").alias("low"), whole("high", "high").alias("high")).select("row", closed(F.col("low"), 1).alias("low"), closed(F.col("high"), 0).alias("high"))
    bands = materialize(bands, "bands")
    cut = every(bands, False, negatives).where(F.col("rank") == negatives).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("cut"))
    raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("cut", i), x)))
    negative = found(bands.join(cut, "row", "left").select("row", raised.alias("low"), "high"), False, negatives, None)
    names = put.where("anchor").select("row", F.col("vec_id").alias("anchor_id"))
    out = negative.withColumn("place", F.col("band") + 1).join(positive, ["row", "place"]).join(names, "row")
    id_ = lambda c: F.nullif(F.col(c), F.lit(-MOST))
    return out.select("anchor_id", id_("positive_id").alias("positive_id"), "rank", id_("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11(spark, sf_dir: str) -> DataFrame:
    """Anchors: vec_ids divisible by 100; labels of those divisible by 7 changed."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(e, F.col("vec_id") % 100 == 0)
