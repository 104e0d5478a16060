"""Minimax contiguous sharding, in DataFrame functions alone.

Groups of equal texts are atoms. In the order of their 64-bit text hash, the smallest capacity is sought for which greedily
filled shards take all atoms; the cuts lie where the greedy walk with that capacity puts them. The search reads summaries of
the prefix sums: the least and the greatest one of each of a fixed number of buckets. A walk over a summary bounds the true
walk from both sides, so binary search leaves a small range of capacities; the next summary looks at the places alone where
their shards may end, more finely, until one capacity is left. Neither atoms nor sizes leave the executors.

Cases: a null text has size 8 and forms its own group, an empty text another; null doc_ids sort first in their group;
repeated rows are rows of one group; other columns are not read; an empty table gives an empty result. A group larger than
the mean shard makes its shard larger.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """df sorted by `order` over range partitions, and written, with part and at: the row's partition and place in it."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    id_ = F.monotonically_increasing_id()
    out = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return materialize(out.withColumn("part", F.shiftright(id_, 33).cast("int")).withColumn("at", id_.bitwiseAND(F.lit((1 << 33) - 1))), "sorted")


def _with_offsets(df: DataFrame, **sums: str) -> DataFrame:
    """df with columns that hold, for each name, the sum of its expression over all partitions before the row's own. The
    window runs over one row for each partition."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy("part").agg(*[F.expr(f"sum({e})").alias(n) for n, e in sums.items()])
    return df.join(parts.select("part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums]), "part")


class Summary:
    """What is known of the prefix sums: some of them in order; open[i] says that others may lie between the i-th and the next."""

    def __init__(self, total: int):
        self.known, self.open = [0, total], [True, False]

    def refine(self, found: dict[int, list[tuple[int, int, int]]]) -> None:
        """found: for gaps (by the place of their lower end), least, greatest and number of the prefix sums of each bucket in order."""
        known, open_ = [], []
        for i, x in enumerate(self.known):
            known.append(x)
            open_.append(self.open[i] and i not in found)
            for least, greatest, n in found.get(i, ()):
                known += [least, greatest] if n > 1 else [least]
                open_ += [n > 2, False] if n > 1 else [False]
        self.known, self.open = known, open_

    def before(self, goal: int) -> tuple[int, int]:
        """Bounds of the greatest prefix sum that isn't above the goal."""
        i = bisect_right(self.known, goal) - 1
        return self.known[i], goal if self.open[i] else self.known[i]

    def walk(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Bounds of the places where greedily filled shards end."""
        ends = [(0, 0)]
        for _ in range(shards):
            low, high = ends[-1]
            ends.append((self.before(low + capacity)[0], self.before(high + capacity)[1]))
        return ends

    def range_of(self, low: int, high: int, shards: int) -> tuple[int, int]:
        """The smallest capacities in [low, high] that may do and that do for sure (high, which does, if none is sure)."""
        total = self.known[-1]

        def first(low: int, high: int, side: int) -> int:
            while low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if self.walk(middle, shards)[-1][side] >= total else (middle + 1, high)
            return low

        low = first(low, high, 1)
        return low, first(low, high, 0)

    def unclear(self, low: int, high: int, shards: int) -> list[int]:
        """The gaps in which a shard may end for capacities in [low, high]."""
        out = set()
        for (a, _), (_, b) in zip(self.walk(low, shards), self.walk(high, shards), strict=True):
            i, j = bisect_right(self.known, a + low) - 1, bisect_right(self.known, b + high) - 1
            out |= {k for k in range(i, j + 1) if self.open[k]}
        return sorted(out)


def cut_points(atoms: DataFrame, total: int, largest: int, shards: int, buckets: int = 49_152) -> list[int]:
    """Prefix sizes after which to cut (at most shards - 1), for the smallest feasible capacity. atoms: upto, the sizes up to
    and with each atom, in order, written. Each summary is one aggregate of about `buckets` rows."""
    width = -(-total // buckets)
    seen = atoms.withColumn("b1", F.expr(f"upto div {width}L"))
    summary = Summary(total)
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest  # the greedy walk fits with the latter
    gaps, places = [0], seen.select("upto", F.lit(0).alias("gap"), F.col("b1").alias("b")).where(F.col("upto") < total)
    while gaps:
        rows = places.groupBy("gap", "b").agg(F.min("upto").alias("lo"), F.max("upto").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("lo").collect()
        summary.refine({g: [(r["lo"], r["hi"], r["n"]) for r in rows if r["gap"] == g] for g in gaps})
        low, high = summary.range_of(low, high, shards)
        gaps = summary.unclear(low, high, shards)
        if gaps:
            step = [max(1, -(-(summary.known[g + 1] - summary.known[g]) * len(gaps) // buckets)) for g in gaps]
            table = [(g, summary.known[g], summary.known[g + 1], (summary.known[g] + 1) // width, w) for g, w in zip(gaps, step, strict=True)]
            near = atoms.sparkSession.createDataFrame(table, "gap int, start long, stop long, b1 long, step long")
            places = seen.join(F.broadcast(near), "b1").where("upto > start AND upto < stop").select("upto", "gap", F.expr("(upto - start) div step").alias("b"))
    return sorted({x for x, _ in summary.walk(low, shards)[1:] if 0 < x < total})


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text)."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNull(), F.lit(-1).cast("long")).otherwise(F.xxhash64(text)).alias("key"),
        F.monotonically_increasing_id().alias("tie"),
    )
    rows = _numbered(rows, "key", "doc_id", "tie")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("part").alias("part"))
    groups = materialize(groups, "groups")
    to_here = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    atoms = _with_offsets(groups, b="bytes", r="n").select("key", "bytes", (F.col("b") + F.sum("bytes").over(to_here)).alias("upto"), (F.col("r") + F.sum("n").over(to_here)).alias("rows_upto"))
    atoms = materialize(atoms, "atoms")
    total, largest = atoms.agg(F.sum("bytes"), F.max("bytes")).first()
    cuts = cut_points(atoms, total, largest, shards) if total else []
    ends = atoms.where(F.col("upto").isin(cuts)).orderBy("upto").limit(shards).collect() if cuts else []
    number = reduce(lambda a, r: a + (F.col("key") > r["key"]).cast("int"), ends, F.lit(0))
    first = reduce(lambda a, r: F.when(F.col("key") > r["key"], F.lit(r["rows_upto"])).otherwise(a), ends, F.lit(0).cast("long"))
    placed = _with_offsets(rows, before="1")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), number.alias("shard"), (F.col("before") + F.col("at") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10(spark, sf_dir: str) -> DataFrame:
    """24 shards."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
