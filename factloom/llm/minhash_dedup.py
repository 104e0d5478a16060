"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard confirmation.

Two permutations make the whole signature: sigma scatters a shingle over a circle of 2^32 places, and coordinate k is the
smallest pi(place + k), pi circularly shifted by k. Bands of coordinates propose pairs; every pair is confirmed on full
shingle sets; links are contracted to components by joins only.

No group is expanded into all its pairs. Rows with the same set are one class. Members of a bucket first meet its hub, the
member that shares most, in narrow buckets (two bands agree) and then in all. What lies in different components of a bucket
after that is compared exactly: in small buckets by pairs that sizes and sketches (one bit of each coordinate) don't rule
out, in large ones block by block of bounded size inside a worker, which gives links alone. Every pair of a bucket whose ends
no other links have joined is tested, so no link between different sets that share a band is lost.

Cases: null or wordless texts have n_shingles 0 and are linked with nothing; a null doc_id is linked with nothing, its
component_id is null and it is kept; repeated rows of a doc_id share its component and are all marked kept (near_dedup, the
stage, keeps one of them); other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WHITE, bucketed, discard, materialize, mix64, slices, span_hashes, utf8, word_spans

#: Buckets of at most SMALL members compare pair by pair; larger ones in blocks of about BLOCK members with another such block.
SMALL, BLOCK = 8, 256

_SIG = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch array<long>"
#: Coordinates of a signature; the first ones make the bands, one bit of each the sketch.
COORDINATES = 256


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after another, and the number of them in each row."""
    low = LOWER[data]
    s, e, row = word_spans(low, at, WHITE)
    rows = len(at) - 1
    if len(s) == 0:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    h = span_hashes(low, s, e)
    words = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(words)[:-1]))

    def joined(i: np.ndarray, n: int) -> np.ndarray:
        out = mix64(h[i] + np.uint64(n))
        for j in range(1, n):
            out = mix64(out ^ (h[i + j] * np.uint64(2 * j + 1)))
        return out

    parts, owners = [], []
    for n in range(1, k):
        if len(few := np.flatnonzero(words == n)):
            parts.append(joined(first[few], n))
            owners.append(few)
    i = np.arange(max(0, len(h) - k + 1))
    i = i[row[i] == row[i + k - 1]]
    parts.append(joined(i, k))
    owners.append(row[i])
    value, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.bincount(owner, minlength=rows)


def circulant_signature(value: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """coordinates x rows: each row's smallest pi(sigma(x) + k); starts are of non-empty rows."""
    place = (mix64(value ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((coordinates, len(starts)), np.uint32)
    for k in range(coordinates):
        x = place + np.uint32(k)  # the circle has 2^32 places
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        out[k] = np.minimum.reduceat(x, starts)
    return out


def _signatures(k: int, bands: int, rows: int):
    def run(batches):
        for b in slices(batches, "text"):
            value, count = shingle_sets(*utf8(b.column("text")), k)
            n = b.num_rows
            full = np.flatnonzero(count)
            starts = np.concatenate(([0], np.cumsum(count)[:-1]))[full]
            s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            keys = np.zeros((n, bands), np.uint64)
            sketch = np.zeros((n, COORDINATES // 64), np.int64)
            if len(full):
                s1[full] = np.add.reduceat(mix64(value), starts)
                s2[full] = np.add.reduceat(mix64(value ^ np.uint64(0xE7037ED1A0B428DB)), starts)
                sig = circulant_signature(value, starts, max(COORDINATES, bands * rows)).astype(np.uint64)
                bits = (sig[:COORDINATES] >> np.uint64(9) & np.uint64(1)).astype(np.uint8).T
                sketch[full] = np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64)
                for band in range(bands):
                    key = np.full(len(full), band + 1, np.uint64)
                    for r in range(rows):
                        key = mix64(key ^ sig[band * rows + r])
                    keys[full, band] = key
            size = np.where(count > 0, bands, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(keys[full].ravel().view(np.int64)))
            wide = sketch.shape[1]
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * wide, pa.int32()), pa.array(sketch.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(count, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists, sketches], ["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"])

    return run


def _sets(k: int):
    def run(batches):
        for b in slices(batches, "text"):
            value, count = shingle_sets(*utf8(b.column("text")), k)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("rep"), lists], ["rep", "shingles"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each end of edges (a, b): comp is the smallest node reachable. Contracts until no edge is left."""
    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("p")), "parent")
        for _ in range(2):  # to the parent's parent, twice
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            parent = materialize(parent.join(up, "p").select("a", F.col("q").alias("p")), "parent")
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("comp"))
        else:
            labels = materialize(labels.join(parent.withColumnRenamed("a", "comp"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "labels")
        x, y = parent.select("a", F.col("p").alias("x")), parent.select(F.col("a").alias("b"), F.col("p").alias("y"))
        smaller = e.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        e = materialize(smaller, "edges")
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def near_duplicates(docs: DataFrame, k_words: int = 5, percent: int = 80, bands: int = 28, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Linked: 100 * |A and B| >= percent * |A or B|. With 4 rows a band, 28 bands miss a pair at 0.8 with probability 3e-7,
    and 20 bands one at 0.85 with 4e-7.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = materialize(docs.mapInArrow(_signatures(k_words, bands, rows), _SIG), "signatures")
    reps = materialize(
        sig.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    comps = _linked(docs, reps, k_words, percent)
    by_set = reps.select("s1", "s2", "rep")
    out = sig.select("doc_id", "n_shingles", *(F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col(c)).alias(c) for c in ("s1", "s2")))
    out = out.join(by_set, ["s1", "s2"], "left")
    out = out.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    comp = F.coalesce("comp", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def _near(x: str, y: str, percent: int) -> Column:
    """Whether two sketches differ in no more bits than those of a linked pair do but with a probability under 1e-8. A bit
    differs with probability (1 - similarity) / 2."""
    p = (1 - percent / 100) / 2
    most = COORDINATES * p + 6.5 * math.sqrt(COORDINATES * p * (1 - p))
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(COORDINATES // 64)]) <= math.ceil(most)


def _linked(docs: DataFrame, reps: DataFrame, k_words: int, percent: int) -> DataFrame:
    """(node, comp) of the class representatives that are linked with another."""
    spread = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = materialize(spread.join(shared, "bucket"), "met")
    # a text that others were made from shares more and larger buckets than they: a good centre
    weight = met.groupBy("rep").agg(F.sum("size").alias("weight"))
    some = materialize(reps.join(weight, "rep").select("rep", "n", "sketch", "weight", "bands"), "some")
    wanted = docs.join(some.select(F.col("rep").alias("doc_id")), "doc_id").groupBy(F.col("doc_id").alias("rep")).agg(F.min("text").alias("text"))
    sets = bucketed(wanted.mapInArrow(_sets(k_words), "rep long, shingles array<long>"), "rep", "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(b, "b").join(a, "a").withColumn("inter", F.size(F.array_intersect("sa", "sb")).cast("long"))
        return both.where(F.expr(f"100 * inter >= {percent} * (size(sa) + size(sb) - inter)")).select("a", "b")

    labels = some.limit(0).select(F.col("rep").alias("node"), F.col("rep").alias("comp"))

    def add(pairs: DataFrame, links: DataFrame | None = None) -> None:
        """Confirm pairs (c, rep) and merge the components of linked ones, and of links that are confirmed already."""
        nonlocal labels
        found = confirmed(pairs.select(F.least("c", "rep").alias("a"), F.greatest("c", "rep").alias("b")).distinct())
        found = materialize(found if links is None else found.unionByName(links), "links")
        if found.isEmpty():
            return
        x, y = labels.select(F.col("node").alias("a"), F.col("comp").alias("x")), labels.select(F.col("node").alias("b"), F.col("comp").alias("y"))
        merged = components(found.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
        nodes = labels.unionByName(found.select(F.explode(F.array("a", "b")).alias("node")).withColumn("comp", F.col("node"))).groupBy("node").agg(F.min("comp").alias("comp"))
        labels = materialize(nodes.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")

    def labelled(members: DataFrame) -> DataFrame:
        return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    likely = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)") & _near("sketch", "s", percent) & (F.col("comp") != F.col("cc"))

    def crossed(members: DataFrame, centres: DataFrame, where: Column | None = None) -> DataFrame:
        """Pairs (c, rep) of a bucket's centres and members of other components that may be linked."""
        c = centres.select("bucket", F.col("rep").alias("c"), F.col("n").alias("m"), F.col("comp").alias("cc"), F.col("sketch").alias("s"))
        return members.join(c, "bucket").where(likely if where is None else likely & where).select("c", "rep")


    def with_hubs(members: DataFrame) -> DataFrame:
        """Of each bucket, the member of the largest weight has level 63."""
        best = members.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("r"))).alias("best"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
        return members.join(best, "bucket").withColumn("level", F.when(F.col("rep") == -F.col("best.r"), 63).otherwise(0)).drop("best")

    # first, where two bands agree: each member with its bucket's hub; most linked texts meet so, in few pairs
    double = F.expr("transform(sequence(0, size(bands) - 2, 2), i -> xxhash64(i, bands[i], bands[i + 1]))")
    twice = labelled(materialize(with_hubs(some.select("rep", "n", "sketch", "weight", F.explode(double).alias("bucket"))), "twice"))
    top = twice.where("level < 63").join(twice.where("level = 63").select("bucket", F.col("rep").alias("c"), F.col("n").alias("m"), F.col("sketch").alias("s"), F.col("weight").alias("w")), "bucket")
    add(top.groupBy("rep").agg(F.max_by(F.struct("c", "m", "s", "n", "sketch"), F.struct("w", -F.col("c"))).alias("x")).select("rep", "x.*").withColumn("comp", F.col("rep")).withColumn("cc", F.col("c")).where(likely).select("c", "rep"))
    twice = labelled(twice.drop("comp"))
    add(crossed(twice, twice.where("level = 63")))
    # then each with the hubs of all its buckets
    every = with_hubs(met.select("rep", "bucket").join(some.select("rep", "n", "sketch", "weight"), "rep")).drop("weight")
    now = mixed_buckets(labelled(every))
    add(crossed(now, now.where("level = 63")))
    # at last, all pairs that still lie in different components: few in small buckets, by blocks in the others
    now = materialize(mixed_buckets(labelled(now.drop("comp", "g"))), "open")
    once = F.col("c") < F.col("rep")
    small = now.where(F.col("g") <= SMALL)
    large = now.where(F.col("g") > SMALL).withColumn("parts", F.ceil(F.col("g") / BLOCK)).withColumn("x", F.pmod(F.xxhash64("rep", F.lit(11)), F.col("parts")))
    blocks = large.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("rep", "comp", "bucket", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    linked = blocks.join(sets, "rep").groupBy("bucket", "x", "y").applyInArrow(_block_links(percent), "a long, b long")
    add(crossed(small, small, once), linked.distinct())
    return _done(labels, sets)


def mixed_buckets(members: DataFrame) -> DataFrame:
    """Members (bucket, rep, comp) of buckets in which more than one component is left, with g, the number of them."""
    parts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("g"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return members.join(parts.select("bucket", "g"), "bucket")


def _block_links(percent: int):
    """Exact similarities of all pairs of a block's sets; gives links enough to join what is linked across components."""

    def run(table: pa.Table) -> pa.Table:
        rep, comp = table.column("rep").to_numpy(), table.column("comp").to_numpy()
        lists = table.column("shingles").combine_chunks()
        size = np.diff(np.asarray(lists.offsets)).astype(np.int64)
        owner = np.repeat(np.arange(len(rep)), size)
        _, code, often = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = often > 1
        code = np.where(shared, np.cumsum(shared) - 1, -1)[code]
        owner, code = owner[code >= 0], code[code >= 0]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        common = np.zeros((len(rep), len(rep)), np.float32)
        for first in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(code, (first, first + 4096))
            strip = np.zeros((len(rep), 4096), np.float32)
            strip[owner[a:b], code[a:b] - first] = 1
            common += strip @ strip.T
        both = size[:, None] + size[None, :] - common
        i, j = np.nonzero((100 * common >= percent * both) & (comp[:, None] < comp[None, :]))
        root = {c: c for c in comp.tolist()}

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = top(int(comp[x])), top(int(comp[y]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _done(labels: DataFrame, sets: DataFrame) -> DataFrame:
    labels = materialize(labels, "labels")
    discard(sets)
    return labels


def near_dedup(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, one of each group of near-duplicates: that with the smallest doc_id. Rows with a null doc_id stay."""
    found = near_duplicates(docs, **parameters)
    keep = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("__keep")).distinct()
    rows = docs.withColumn("__at", F.col("doc_id").cast("long")).join(keep.withColumnRenamed("__keep", "__at"), "__at", "left_semi")
    one = rows.groupBy("__at").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64("text")).alias("__row"))
    return one.select("__row.*").unionByName(docs.where(F.col("doc_id").isNull()))


def op1(spark, sf_dir: str) -> DataFrame:
    """Three words, 85 %."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k_words=3, percent=85, bands=20, rows=4)
