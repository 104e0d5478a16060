"""Removal of repeated byte strings, and detection of passages that documents share, by a column-wise Burrows-Wheeler
construction over anchored segments.

The symbols of a text are its bytes (for removal) or the hashes of its words (for shared passages). A string of `length`
symbols has one anchor: its leftmost smallest gram. Equal strings have equal anchors at equal places, so the starts of a text
fall into runs with one anchor each, and a run's segment (the symbols of all its strings) need only meet segments of the same
anchor. Segments whose anchor occurs once are unique; equal segments are one; different segments of an anchor need suffix work.

For these, blocks of segments, aligned at their anchors, are read column by column from the right: each round inserts one
symbol per segment, appends the round's part of the collection's transform and its common prefixes to sequential files, and
takes the order of the next round from them. A string is repeated if it shares `length` symbols with a neighbour.

An anchor with more than `block` different segments is split: strings that start lo to hi symbols before the anchor share lo
symbols before it and length - gram - hi behind it, so its segments are dealt by these contexts, in halves of the range of
starts, until the groups fit. Strings that start at one place in a group that still doesn't fit are equal.

Cases: null counts as empty; null doc_ids are rows like others; repeated rows are different texts, so each repeats the other
(they share no passage across documents, as they are one document); other columns are not read; an empty table gives an empty
result. Texts of any length are cut into pieces that overlap by a string.
"""

from __future__ import annotations

import hashlib
import tempfile
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, materialize, mix64, slices, span_hashes, utf8, word_spans


class Law(NamedTuple):
    """What is compared: strings of `length` symbols with grams of `gram`; `across`: in different documents alone."""

    name: str
    length: int
    gram: int
    kind: type
    across: bool

    @property
    def left(self) -> int:
        return self.length - self.gram


def byte_law(length: int = 400) -> Law:
    return Law("bytes", length, 128, np.uint8, False)


def word_law(length: int = 51) -> Law:
    return Law("words", length, 16, np.uint64, True)


_FIELDS = "a long, g1 long, g2 long, k1 long, k2 long, s long, n int, o int"
#: A key with more than max(HOT, one in SHARE) of the rows is hot; so there are at most SHARE hot keys.
HOT, SHARE = 4096, 10_000


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each string of `gram` symbols (a power of two), by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    size = 1
    while size < gram:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15) + (h[size:] ^ (h[size:] >> np.uint64(29)))
        size *= 2
    return mix64(h)


def leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the place of its leftmost smallest one (by the upper 40 bits)."""
    n = len(h)
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    if pad:
        key = np.concatenate((key, np.full(pad, ~np.uint64(0), np.uint64)))
    blocks = key.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    return (low & np.uint64(0xFFFFFF)).astype(np.int64)


def segments(data: np.ndarray, at: np.ndarray, law: Law) -> dict[str, np.ndarray]:
    """The runs of string starts with one anchor: row, start s in the row, number n of starts, anchor offset o from s,
    anchor hash a and 128-bit hash (g1, g2) of the run's data[s : s + n + length - 1]."""
    length, gram = law.length, law.gram
    width = length - gram + 1
    out = {k: np.zeros(0, np.int64) for k in ("row", "s", "n", "o")} | {k: np.zeros(0, np.uint64) for k in ("a", "g1", "g2")}
    if len(data) < length:
        return out
    h = gram_hashes(data, gram)
    p = leftmost_minima(h, width)
    inside = np.zeros(len(p) + 1, np.int32)  # starts whose string stays in its row
    size = np.diff(at)
    for d, where in ((1, at[:-1][size >= length]), (-1, at[1:][size >= length] - length + 1)):
        np.add.at(inside, where, d)
    inside = np.cumsum(inside[:-1]) > 0
    new = inside.copy()
    new[1:] &= (p[1:] != p[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (p[1:] != p[:-1]) | ~inside[1:]
    s, e = np.flatnonzero(new), np.flatnonzero(last)
    n = e - s + 1
    size = n + length - 1
    g1 = size.astype(np.uint64)
    for step in range(0, length + width - 1, gram):
        g1 = mix64(g1 ^ h[s + np.minimum(step, size - gram)])
    g2 = mix64(g1 ^ np.uint64(0x8EBC6AF09C88C6E3))
    for step in range(0, length + width - 1, gram):
        g2 = mix64(g2 + h[s + np.minimum(step, size - gram)] * np.uint64(0xD6E8FEB86659FD93))
    row = np.searchsorted(at, s, "right") - 1
    return {"row": row, "s": s - at[row], "n": n, "o": p[s] - s, "a": h[p[s]], "g1": g1, "g2": g2}


LONG = 1 << 22


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts, and the number of words before each text."""
    if len(data) <= LONG:
        s, e, row = word_spans(data, at, WHITE)
        return (span_hashes(data, s, e) if len(s) else np.zeros(0, np.uint64)), np.searchsorted(row, np.arange(len(at)))
    found, first = [], 0  # one long text, cut at white space
    while first < len(data):
        last = first + LONG
        while last < len(data) and not (gaps := np.flatnonzero(WHITE[data[last : last + LONG]])).size:
            last += LONG
        last = len(data) if last >= len(data) else last + int(gaps[0]) + 1
        s, e, _ = word_spans(piece := data[first:last], np.array([0, last - first]), WHITE)
        found.append(span_hashes(piece, s, e))
        first = last
    found = np.concatenate(found)
    return found, np.array([0, len(found)])


def symbols(batches, law: Law):
    """Batches of texts with their symbols: (batch, symbols, offsets of the rows in them)."""
    for b in slices(batches, "text"):
        data, at = utf8(b.column("text"))
        yield (b, data, at) if law.name == "bytes" else (b, *_words(data, at))


def long_pieces(batches, law: Law):
    """symbols() whose longer texts are cut into overlapping pieces: (batch, symbols, offsets, each row's first symbol)."""
    for b, data, at in symbols(batches, law):
        if len(data) <= LONG:
            yield b, data, at, 0
            continue
        for first in range(0, max(1, len(data) - law.length + 1), LONG - law.length + 1):  # one row
            piece = data[first : first + LONG]
            yield b, piece, np.array([0, len(piece)]), first


def _segment_rows(law: Law):
    def run(batches):
        for b, data, at, first in long_pieces(batches, law):
            g = segments(data, at, law)
            row = pa.array(g["row"])
            yield pa.RecordBatch.from_arrays([pa.array(g[c].view(np.int64)) for c in ("a", "g1", "g2")] + [b.column("k1").take(row), b.column("k2").take(row), pa.array(g["s"] + first), pa.array(g["n"].astype(np.int32)), pa.array(g["o"].astype(np.int32))], ["a", "g1", "g2", "k1", "k2", "s", "n", "o"])

    return run


class _Parts:
    """A sequential file of one part a round."""

    def __init__(self, size: int, kind: type):
        self.file, self.size, self.kind, self.n = tempfile.TemporaryFile(), size, np.dtype(kind), 0  # a task's own scratch

    def append(self, part: np.ndarray) -> None:
        self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(part, self.kind).tobytes())
        self.n += 1

    def read(self, i: int) -> np.ndarray:
        self.file.seek(i * self.size * self.kind.itemsize)
        return np.frombuffer(self.file.read(self.size * self.kind.itemsize), self.kind)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def _columns(texts: list[np.ndarray], shift: np.ndarray, columns: int, file: _Parts) -> None:
    """Write the columns of the aligned texts; 0 where a text has no symbol."""
    m, kind = len(texts), texts[0].dtype
    if kind != np.uint8:  # ranks in place of hashes
        flat = np.unique(np.concatenate(texts), return_inverse=True)[1].astype(np.uint32)
        cuts = np.cumsum([len(t) for t in texts])[:-1]
        texts = np.split(flat, cuts)
    strip = max(1, (1 << 22) // m)  # columns written at once
    for j in range(0, columns, strip):
        part = np.zeros((m, min(strip, columns - j)), np.uint32)
        for i, t in enumerate(texts):
            a, b = max(j, shift[i]), min(j + part.shape[1], shift[i] + len(t))
            if a < b:
                part[i, a - j : b - j] = t[a - shift[i] : b - shift[i]]
                part[i, a - j : b - j] += 1
        for column in part.T:
            file.append(column)


def repeated_starts(texts: list[np.ndarray], anchors: np.ndarray, law: Law, docs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """segments x (length - gram + 1) flags: which strings of anchored segments occur in more than one of them, and with
    `docs`, the smallest and the largest document of each segment, in more than one document.

    Column j of a segment is its symbol j - (length - gram) places after its anchor's start; columns are inserted from the last to
    the first. A round's part of the transform is the column's symbols in the order of the suffixes so far; it and the common
    prefixes are read back from the files to make the next order.
    """
    m, left, length = len(texts), law.left, law.length
    columns = left + length
    flags = np.zeros((m, left + 1), bool)
    with _Parts(m, np.uint32) as column, _Parts(m, np.uint32) as transform, _Parts(m, np.int16) as prefixes:
        _columns(texts, left - anchors, columns, column)
        order = np.arange(m)
        prefixes.append(np.zeros(m))  # each with the one before in the order
        for round_, j in enumerate(range(columns - 1, -1, -1)):
            transform.append(column.read(j)[order])
            symbol, common = transform.read(round_), prefixes.read(round_)
            moved = np.argsort(symbol, kind="stable")
            same = np.zeros(m, bool)
            ranked = symbol[moved]
            same[1:] = (ranked[1:] == ranked[:-1]) & (ranked[1:] != 0)
            low = common[moved]
            gap = np.zeros(m, np.int64)
            gap[1:] = moved[1:] - moved[:-1]
            far = np.flatnonzero(same & (gap > 1))
            if len(far):  # the smallest common prefix between two that were not neighbours
                span, table, width = gap[far], common, 1
                level = np.frexp(span.astype(np.float64))[1] - 1
                first, last = moved[far] - span + 1, moved[far]
                for k in range(int(level.max()) + 1):
                    if len(w := np.flatnonzero(level == k)):
                        low[far[w]] = np.minimum(table[first[w]], table[last[w] - width + 1])
                    table = np.minimum(table[:-width], table[width:]) if len(table) > width else table
                    width *= 2
            common = np.where(same, np.minimum(low + 1, length), 0).astype(np.int16)
            prefixes.append(common)
            order = order[moved]
            if j <= left:
                full = common >= length
                if docs is None:
                    full[:-1] |= common[1:] >= length
                else:
                    starts = np.flatnonzero(~full)  # runs of suffixes that share a string
                    lo, hi = np.minimum.reduceat(docs[0][order], starts), np.maximum.reduceat(docs[1][order], starts)
                    full = np.repeat(lo != hi, np.diff(np.append(starts, m)))
                flags[order[full], j] = True
    return flags


def _block(law: Law):
    keys = ["a", "g1", "g2", "k1", "k2", "s", "c"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [np.frombuffer(t, law.kind) for t in pdf["symbols"]]
        o, n = pdf["o"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        flags = repeated_starts(texts, o, law, (pdf["d1"].to_numpy(), pdf["d2"].to_numpy()) if law.across else None)
        # the string of a group that starts p symbols before the anchor is the segment's string o - p
        p = law.left - np.arange(law.left + 1)
        flags &= (p >= pdf["lo"].to_numpy()[:, None]) & (p <= pdf["hi"].to_numpy()[:, None])
        wide = np.zeros((len(flags), law.left + 3), np.int8)
        wide[:, 1:-1] = flags
        row, edge = np.nonzero(np.diff(wide, axis=1))
        row, first, last = row[::2], edge[::2] - law.left + o[row[::2]], edge[1::2] - law.left + o[row[::2]]
        out = pdf[keys].iloc[row].reset_index(drop=True)
        return out.assign(lo=np.maximum(first, 0).astype(np.int32), hi=np.minimum(last, n[row]).astype(np.int32))

    return run


def _cut_segments(law: Law):
    """From texts and the list of wanted segments to their symbols."""
    fields = ["a", "g1", "g2", "n", "o", "c", "s", "d1", "d2"]

    def run(batches):
        for b, data, at in symbols(batches, law):
            wanted = b.column("wanted")
            flat = wanted.flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(wanted.offsets)))
            s, n = np.asarray(flat.field("s")), np.asarray(flat.field("n"))
            first = at[row] + s
            bits = pa.array([data[i:j].tobytes() for i, j in zip(first.tolist(), (first + n + law.length - 1).tolist(), strict=True)], pa.binary())
            who = [b.column(k).take(pa.array(row)) for k in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays([*who, *(flat.field(c) for c in fields), bits], ["k1", "k2", *fields, "symbols"])

    return run


def _grouped(cut: DataFrame, law: Law, block: int) -> tuple[DataFrame, DataFrame]:
    """cut by the groups (g, lo, hi) that its segments' strings meet in, of `block` segments at most; and the segments of larger
    groups of one start (lo = hi), whose strings there are equal, where they repeat."""
    now, done, equal = cut.withColumns({"g": F.xxhash64("a", F.lit(0)), "lo": F.lit(0), "hi": F.lit(law.left)}), None, None
    item = np.dtype(law.kind).itemsize
    repeats = "d < e" if law.across else "true"
    while True:
        big = now.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("d1").alias("d"), F.max("d2").alias("e")).where(F.col("size") > block)
        big = materialize(big.select("g", F.expr(repeats).alias("repeats")), "big")
        if not (k := big.count()):
            return (now if done is None else done.unionByName(now)), (now.limit(0) if equal is None else equal)
        tagged = now.join(F.broadcast(big) if k <= 100_000 else big, "g", "left")  # at most one group in `block` rows
        fits, ends = tagged.where("repeats is null").drop("repeats"), tagged.where("repeats and lo = hi").drop("repeats")
        done = fits if done is None else done.unionByName(fits)
        equal = ends if equal is None else equal.unionByName(ends)
        half = F.expr("cast((lo + hi) div 2 as int)")
        parts = F.explode(F.array(F.struct(F.col("lo"), half.alias("hi")), F.struct((half + 1).alias("lo"), F.col("hi"))))
        split = tagged.where("repeats is not null and lo < hi").withColumn("part", parts).drop("repeats", "lo", "hi").select("*", "part.*").drop("part")
        before = F.expr(f"substring(symbols, (o - lo) * {item} + 1, lo * {item})")
        behind = F.expr(f"substring(symbols, (o + {law.gram}) * {item} + 1, ({law.left} - hi) * {item})")
        split = split.where("o >= lo and o - n + 1 <= hi").withColumn("g", F.xxhash64("g", "lo", before, behind))
        several = split.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("g")
        now = materialize(split.join(several, "g", "left_semi"), "split")


def repeated_spans(docs: DataFrame, law: Law, block: int = 20_000) -> DataFrame:
    """(k1, k2, spans array<struct<lo, hi>>): the symbols [lo, hi) of the texts of docs (k1, k2, text) that lie in a repeated
    string. A text's spans are collected: they take less room than the text."""
    all_ = materialize(docs.mapInArrow(_segment_rows(law), _FIELDS), f"{law.name}_segments")
    most, key, doc = max(HOT, all_.count() // SHARE), ["a", "g1", "g2"], F.xxhash64("k1", "k2")
    place = ["k1", "k2", (F.col("s") + F.col("lo")).alias("lo"), (F.col("s") + F.col("hi") + (law.length - 1)).alias("hi")]
    anchors = all_.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.min("g1").alias("lo"), F.max("g1").alias("hi"), F.min(doc).alias("d1"), F.max(doc).alias("d2"))
    anchors = materialize(anchors.where("d1 < d2" if law.across else "c > 1").select("a", "c", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    # rows of hot anchors stay where they are; the others move to their anchors
    tagged = all_.join(F.broadcast(anchors.where(F.col("c") > most).select("a", F.col("mixed").alias("hot"))), "a", "left")
    cold = tagged.where("hot is null").drop("hot").join(anchors.where(F.col("c") <= most).select("a", "mixed"), "a")
    shared = materialize(tagged.where("hot is not null").withColumnRenamed("hot", "mixed").unionByName(cold), "shared")
    same, mixed = shared.where("not mixed").withColumns({"lo": F.lit(0), "hi": F.col("n")}), shared.where("mixed")
    each = mixed.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.min(doc).alias("d1"), F.max(doc).alias("d2"), F.min(F.struct("k1", "k2", "s", "n", "o")).alias("at"))
    each = materialize(each.withColumn("whole", F.expr("d1 < d2" if law.across else "c > 1")).select(*key, "c", "d1", "d2", "whole", "at.*"), "different")
    wanted = each.groupBy("k1", "k2").agg(F.collect_list(F.struct(*key, "n", "o", "c", "s", "d1", "d2")).alias("wanted"))
    one_text = docs.join(wanted.select("k1", "k2"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    cut = one_text.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted").mapInArrow(_cut_segments(law), "k1 long, k2 long, a long, g1 long, g2 long, n int, o int, c long, s long, d1 long, d2 long, symbols binary")
    cut = materialize(cut, "cut")
    blocks = max(1, -(-cut.count() // block))
    groups, equal = _grouped(cut, law, block)
    found = groups.withColumn("block", F.pmod("g", F.lit(blocks))).repartition(max(blocks, 2), "block").groupBy("block").applyInPandas(_block(law), "a long, g1 long, g2 long, k1 long, k2 long, s long, c long, lo int, hi int")
    found = materialize(found.unionByName(equal.select(*key, "k1", "k2", "s", "c", (F.col("o") - F.col("lo")).alias("lo"), (F.col("o") - F.col("lo") + 1).alias("hi"))), "found")
    # a segment's copies take its result; those of hot ones stay where they are
    runs = each.where("whole").select(*key, "c", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    if law.across:
        runs = runs.unionByName(found.where("c > 1").join(each.where("not whole").select(*key), key, "left_semi").select(*runs.columns))
    tagged = mixed.join(F.broadcast(each.where(F.col("c") > most).select(*key, F.lit(True).alias("hot"))), key, "left")
    hot = tagged.where("hot").join(F.broadcast(runs.where(F.col("c") > most).drop("c")), key)
    cold = tagged.where("hot is null").join(runs.where(F.col("c") <= most).drop("c"), key)
    out = [x.select(*place) for x in (same, found.where("c = 1"), hot, cold)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _removed():
    def run(batches):
        for b in slices(batches, "text"):
            data, at = utf8(b.column("text"))
            removed, spans, digests, words, passages = [], [], [], [], []
            for i, (found, shared) in enumerate(zip(b.column("spans").to_pylist(), b.column("shared").to_pylist(), strict=True)):
                text = data[at[i] : at[i + 1]]
                kept, end = hashlib.sha256(), 0
                for lo, hi in (runs := _merged(found)):
                    kept.update(text[end:lo].tobytes())
                    end = hi
                kept.update(text[end:].tobytes())
                removed.append(sum(hi - lo for lo, hi in runs)), spans.append(len(runs)), digests.append(kept.hexdigest())
                runs = _merged(shared)
                words.append(sum(hi - lo for lo, hi in runs)), passages.append(len(runs))
            counts = [pa.array(x, pa.int64()) for x in (np.diff(at), removed, spans)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *counts, pa.array(digests, pa.string()), pa.array(words, pa.int64()), pa.array([x > 0 for x in passages])], _COLUMNS)

    return run


_COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shared_words", "shares_passage"]


def _merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs of spans that overlap or touch."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in found or []):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def suffix_dedup(docs: DataFrame, length: int = 400, words: int = 51, block: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text): bytes in repeated strings of `length`
    bytes (at least 256) are removed; and shared_words, shares_passage: the words in passages of `words` words (at least 32) or
    more, as they stand between white space, that another document has, too, and whether there are any."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("k1", F.coalesce("doc_id", F.lit(-1))).withColumn("k2", F.xxhash64("doc_id", "text"))
    texts = docs.select("k1", "k2", "text")
    spans = materialize(repeated_spans(texts, byte_law(length), block), "spans")
    shared = materialize(repeated_spans(texts, word_law(words), block).withColumnRenamed("spans", "shared"), "shared")
    out = docs.join(spans, ["k1", "k2"], "left").join(shared, ["k1", "k2"], "left")
    return out.select("doc_id", "text", "spans", "shared").mapInArrow(_removed(), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shared_words long, shares_passage boolean")


def op2(spark, sf_dir: str) -> DataFrame:
    """400 bytes; passages of over 50 words."""
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
