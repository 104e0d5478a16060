"""Best-fit-decreasing packing whose bin counts are certified by dual-feasible lower bounds.

Documents are tokenized, cut into pieces of at most `size` tokens, and the pieces dealt to partitions of bounded size. Each
partition packs its pieces by best-fit decreasing and compares the number of bins with the largest of a family of
dual-feasible-function bounds. Where they are equal the partition is done. Partitions with a gap give the pieces of their
bins that are not full to fewer, shared partitions, which pack them again; this repeats until the gap is closed or the
exchange brings nothing.

Cases: null text counts as empty and gives one piece, id 0 alone; null doc_ids and repeated rows are rows like others; other
columns are not read; very long texts are cut; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, materialize, slices, span_hashes, utf8, word_spans

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Bins that pieces need at least; counts[x] pieces have length x <= size. The largest bound of the dual-feasible
    functions u_eps (long pieces count as whole, those under eps as nothing, eps <= size / 2)."""
    x = np.arange(size + 1)
    whole, weight = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * x)
    best = -(-int(weight[-1]) // size)
    for eps in range(1, size // 2 + 1):
        large = int(whole[size - eps + 1])  # longer than size - eps
        middle = int(weight[size - eps] - weight[eps - 1])
        best = max(best, large + -(-middle // size))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and each bin's fill."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), size
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if left := room - n:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


# How the tokenizer's file splits and normalises words, and its special tokens.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
END = b"\xff"  # stands for the vocabulary's end-of-word mark; no UTF-8 text has this byte


def byte_of_symbol() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's symbols stand for: printable ones for themselves, the others counted on from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokens:
    """Token ids of texts, word by word. The tokenizer never joins what white space parts, so a text's ids are those of its
    words in turn; a word met before is looked up. The memory is emptied when it holds more than `most` words.

    A word's pieces are merged by rank over bytes, an end mark being part of the last symbol; words for which this would not
    be the same (special tokens, letters whose lower case depends on their place) go to the tokenizer itself.
    """

    def __init__(self, path: str, most: int = 120_000):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte = byte_of_symbol()
        ranks = {}
        for token, rank in vocabulary.items():
            if token not in SPECIAL:
                last = token.endswith("</w>") and token != "</w>"
                ranks[bytes(byte[c] for c in (token[:-4] if last else token)) + (END if last else b"")] = rank
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.split = regex.compile(SPLIT).findall
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def word(self, raw: bytes) -> list[int]:
        w = raw.decode()
        if not w.isascii():
            w = unicodedata.normalize("NFC", w)
        if "Σ" in w or "<|" in w:
            return self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids
        w = w.lower()
        if w.isalpha():
            return self.merge(w.encode() + END)
        out: list[int] = []
        for piece in self.split(w):
            out += self.merge(piece.encode() + END)
        return out

    def learn(self, words: list[bytes]) -> None:
        ids: list[int] = []
        length = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            new = self.word(w)
            self.known[w] = len(self.first) + i
            length[i] = len(new)
            ids += new
        self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.pool = np.concatenate((self.pool, np.array(ids, np.uint32)))

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, each row's followed by 0, and the number of them in each row."""
        s, e, row = word_spans(data, at, WHITE)
        if len(self.known) > self.most:
            self.clear()
        code, distinct = pd.factorize(span_hashes(data, s, e)) if len(s) else (np.zeros(0, np.int64), [])
        one = np.zeros(len(distinct), np.int64)
        one[code] = np.arange(len(code))
        words = [data[a:b].tobytes() for a, b in zip(s[one].tolist(), e[one].tolist(), strict=True)]
        self.learn(list(dict.fromkeys(w for w in words if w not in self.known)))
        index = np.array([self.known[w] for w in words], np.int64)[code]
        first, length = self.first[index], self.length[index]
        rows = len(at) - 1
        count = np.bincount(row, weights=length, minlength=rows).astype(np.int64) + 1
        ids = np.zeros(int(count.sum()), np.uint32)
        each = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        ids[np.repeat(row, length) + np.arange(len(each))] = self.pool[each]  # every earlier row has one more id, its 0
        return ids, count


_tokens: dict[str, WordTokens] = {}


def _pieces(path: str, size: int):
    def run(batches):
        tokens = _tokens.setdefault(path, None) or WordTokens(path)
        _tokens[path] = tokens
        for b in slices(batches, "text"):
            ids, count = tokens(*utf8(b.column("text")))
            parts = -(-count // size)
            row = np.repeat(np.arange(b.num_rows), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * size
            length = np.minimum(size, count[row] - start)
            first = (np.cumsum(count) - count)[row] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * i : 4 * (i + n)]) for i, n in zip(first.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _pack(size: int, base: int):
    """Packs one group by best-fit decreasing. Where the group came with whole bins (sequence_id given), these stay if the new
    packing isn't smaller. open: pieces of bins that aren't full, where more bins are used than the bound certifies; and of
    the emptiest bin, which a partition's own bound rounds up for."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(n, size)
        number = base + (int(pdf["part"].iloc[0]) << 24) + bins
        if "sequence_id" in pdf and (before := pdf["sequence_id"].nunique()) <= len(fill):
            number, offsets = pdf["sequence_id"].to_numpy(), pdf["offset"].to_numpy()
            bins, used = np.unique(number, return_inverse=True)[1], before
            fill = np.bincount(bins, weights=n)
        else:
            used = len(fill)
        gap = used > lower_bound(np.bincount(n, minlength=size + 1), size)
        return pdf.assign(sequence_id=number, offset=offsets, open=(fill[bins] < size) & (gap | (bins == fill.argmin())))[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"]]

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, group: int = 100_000) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. group: pieces in a partition, about. Partitions
    with a gap exchange pieces until their bounds certify all, or an exchange saves no bin."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rest = materialize(docs.mapInArrow(_pieces(tokenizer, size), _PIECE), "pieces")
    bins = lambda df: df.select("sequence_id").distinct().count()
    done, key, r, before = None, F.monotonically_increasing_id(), 0, None  # places in written files: repeated rows part, and a task that runs again deals alike
    while True:
        parts = max(1, math.ceil(rest.count() / group))
        dealt = rest.withColumn("part", F.pmod(F.xxhash64(key, F.lit(r)), F.lit(parts)).cast("int"))
        packed = materialize(dealt.groupBy("part").applyInPandas(_pack(size, r << 48), _PIECE + ", sequence_id long, offset long, open boolean"), "packed")
        rest = packed.where("open").drop("open")
        last = parts == 1 or rest.isEmpty() or (before is not None and bins(packed) >= before)
        closed = (packed if last else packed.where("not open")).drop("open")
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        before, key, r = bins(rest), F.col("sequence_id"), r + 1


def certificate(packed: DataFrame, size: int = 2048) -> tuple[int, int]:
    """The number of sequences, and the bound that no packing of the pieces beats."""
    n = np.zeros(size + 1, np.int64)
    for length, count in packed.groupBy("length").count().collect():  # a row for each length
        n[length] = count
    return packed.select("sequence_id").distinct().count(), lower_bound(n, size)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3(spark, sf_dir: str) -> DataFrame:
    """2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
