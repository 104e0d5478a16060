"""Token counts of whole texts without their ids.

A tokenizer's pre-tokens are tokenized apart from each other, so a text's count is the sum, over its distinct pre-tokens, of how
often each stands there times the number of its pieces. Pieces are counted once for each distinct pre-token of the corpus, and
joined to the documents' frequencies; ids are never made.

The most frequent pre-tokens (at most `hot`, each named by at most 64 bytes) travel to all workers, which sum them where the
document is read; so no common word, number or mark is a join key. A document's other pre-tokens meet their counts in an
equi-join: there a row is one document's one pre-token. A pre-token longer than 64 bytes is named by its SHA-256. Texts are cut at
the tokenizer's special strings first, which count one each, as the library does by default.

Cases: a null text counts as empty, with no tokens; repeated rows and null doc_ids are rows of their own; long texts are read
whole, one at a time; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .best_fit_packing import tokenizer_path
from .common import materialize, slices

#: How a tokenizer's file must normalise and split, so that white space parts pre-tokens and each run of other bytes
#: can be split by itself. The pattern of the split is one whose matches hold no white space.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Characters from here on are split by the library. Those before, whose kinds Unicode no longer changes, by one pattern:
NEAR = 0x530
FAR = re.compile(f"[{chr(NEAR)}-\U0010ffff]")


def _near(kind: str) -> str:
    """Characters of a general category, as a class of a pattern."""
    return "".join(re.escape(c) for c in map(chr, range(NEAR)) if unicodedata.category(c)[0] == kind)


#: SPLIT for texts of near characters, lower-cased.
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_near('L')}]+|[{_near('N')}]|[^ \\t-\\r\x85\xa0{_near('L')}{_near('N')}]+")
#: Bytes of a pre-token that names itself.
NAMED = 64


def key_of(piece: str) -> str:
    """What a pre-token is joined by: itself, or a digest that no short pre-token equals."""
    raw = piece.encode()
    return piece if len(raw) <= NAMED else "sha256 " + hashlib.sha256(raw).hexdigest()


class PreTokens:
    """Distinct pre-tokens of a text with their frequencies, by the library's own normaliser and pre-tokenizer."""

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        self.added = re.compile("|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content)))) if added else None
        first = ((file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_space = (file.get("normalizer") or {}).get("normalizers") == NORMAL and first.get("type") == "Split" and first.get("pattern") == {"Regex": SPLIT} and first.get("behavior") == "Removed"

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text in order. What is a pre-token by itself stays one if it is split again."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        if self.tokenizer.pre_tokenizer is None:
            return [text]
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, pre_token: str) -> int:
        """How many tokens a pre-token has."""
        split = self.tokenizer.pre_tokenizer
        return sum(len(self.tokenizer.model.tokenize(p)) for p, _ in (split.pre_tokenize_str(pre_token) if split is not None else [(pre_token, None)]))

    def of_word(self, word: str) -> list[str]:
        """The pre-tokens of a run without ASCII white space; words met before are looked up."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.split(word)
            if len(word) <= NAMED:
                self.known[word] = found
        return found

    def _of_part(self, text: str) -> Counter:
        if not self.by_space:
            return Counter(self.split(text))
        near = unicodedata.normalize("NFC", text)
        if not FAR.search(near):
            # letter by letter, as the library does it: no final sigma
            return Counter(WORDS.findall(near.replace("Σ", "σ").lower()))
        out = Counter()
        for word, n in Counter(text.encode().split()).items():
            for p in self.of_word(word.decode()):
                out[p] += n
        return out

    def count(self, text: str) -> tuple[int, Counter]:
        """Special tokens, and the frequencies of the other parts' pre-tokens."""
        if self.added is None or not (found := self.added.findall(text)):
            return 0, self._of_part(text)
        out = Counter()
        for part in self.added.split(text):
            out.update(self._of_part(part))
        return len(found), out


_made: dict[str, PreTokens] = {}


def _pre_tokens(path: str) -> PreTokens:
    if path not in _made:
        _made[path] = PreTokens(path)
    return _made[path]


def _frequencies(path: str):
    """(key, piece, n): a slice's distinct pre-tokens; piece is null where the key is the pre-token."""

    def run(batches: Iterator[pa.RecordBatch]):
        pre = _pre_tokens(path)
        for b in slices(batches, "text", 1 << 23):
            total = Counter()
            for text in b.column("text").to_pylist():
                total.update(pre.count(text or "")[1])
            pieces = list(total)
            keys = [key_of(p) for p in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([None if k is p else p for k, p in zip(keys, pieces, strict=True)], pa.string()), pa.array(list(total.values()), pa.int64())], ["key", "piece", "n"])

    return run


def _pieces(path: str):
    def run(batches):
        pre = _pre_tokens(path)
        for b in batches:
            pieces = [pre.pieces(k if p is None else p) for k, p in zip(b.column("key").to_pylist(), b.column("piece").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), pa.array(pieces, pa.int64())], ["key", "n", "pieces"])

    return run


def vocabulary(docs: DataFrame, tokenizer: str) -> DataFrame:
    """key, n, pieces: every distinct pre-token of the texts, how often it stands there, and its number of tokens."""
    each = docs.select("text").mapInArrow(_frequencies(tokenizer), "key string, piece string, n long")
    return each.groupBy("key").agg(F.max("piece").alias("piece"), F.sum("n").alias("n")).mapInArrow(_pieces(tokenizer), "key string, n long, pieces long")


def _sums(path: str, hot: dict[str, int]):
    """A document's tokens of hot and special pre-tokens, and its other pre-tokens with their frequencies."""

    def run(batches):
        pre = _pre_tokens(path)
        for b in slices(batches, "text"):
            size, base, rare, times = [], [], [], []
            for text in b.column("text").to_pylist():
                text = text or ""
                special, n = pre.count(text)
                size.append(len(text) if text.isascii() else len(text.encode()))
                known = [hot.get(k if len(k) <= NAMED // 4 else key_of(k)) for k in n]  # a character has four bytes at most
                base.append(special + sum([c * p for c, p in zip(n.values(), known, strict=True) if p is not None]))
                rest = [(k, c) for (k, c), p in zip(n.items(), known, strict=True) if p is None]
                rare.append([key_of(k) for k, _ in rest])
                times.append([c for _, c in rest])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(base, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "base", "rare", "times"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, hot: int = 65_536) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = materialize(vocabulary(docs, tokenizer), "pre_tokens")
    common = {r["key"]: r["pieces"] for r in counts.orderBy(F.desc("n"), "key").limit(hot).collect()} if hot else {}
    # a document's place in the written table is its key, so repeated rows stay apart
    each = docs.mapInArrow(_sums(tokenizer, common), "doc_id long, n_bytes long, base long, rare array<string>, times array<long>")
    each = materialize(each.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    some = each.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    rest = some.join(counts.select("key", "pieces"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    total = F.col("base") + F.coalesce("more", F.lit(0))
    out = each.select("row", "doc_id", "n_bytes", "base").join(rest, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op12(spark, sf_dir: str) -> DataFrame:
    """word_bpe_49k.json, 2048 tokens."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
