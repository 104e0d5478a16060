"""Secret spans in texts, with multipart credential linking.

Three base kinds (assign, access, hex) are always reported. Parts that are weak by themselves, an account name (id), a long
mixed token (key) and a host or URL with a path or port (endpoint), are joined by interval: a scope is `reach` code points
around a part, cut at blank lines; a weak part is reported only if its scope reaches a part that complements it, of whatever
length. A base secret counts as a key, and an access identifier as an id, too. Sorted starts and ends and binary search find the
partners, so a text with many parts costs n log n.

Cases: null counts as empty, without spans; null doc_ids and repeated rows are rows like others; other columns are not read;
an empty table gives an empty result. Places are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, as a match starts at the first place that fits
_ID = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.I | re.A)
_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])", re.A)
_END = re.compile(r"\b(?:https?|postgres(?:ql)?|mysql|redis|amqp|mongodb|ftp)://[^\s\"'<>]{4,}", re.I | re.A)
_HINT = re.compile(r"user|login|account|client_?id", re.I | re.A)
_BLANK = re.compile(r"\n[ \t]*\n")
BASE = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate((*BASE, "id", "key", "endpoint"))}

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]]))


def linked_spans(text: str, base: list[Span], reach: int = 300) -> list[Span]:
    """The weak parts with complementary parts in their scope: an id needs a key; an endpoint an id or a key; a key an id, an
    access identifier or an endpoint."""
    ids = [(m.start(), m.end()) for m in _ID.finditer(text)] if _HINT.search(text) else []
    ends = [m.span() for m in _END.finditer(text)] if "://" in text else []
    access = [(s, e) for s, e, k in base if k == "access"]
    if not ids and not ends and not access:  # no key can be complemented
        return []
    keys = []
    strong = [(s, e) for s, e, _ in base]
    for m in _KEY.finditer(text):
        token = m.group()
        if re.search("[a-z]", token) and re.search("[A-Z]", token):
            keys.append(m.span())
    blanks = [m.start() for m in _BLANK.finditer(text)]

    def near(part: tuple[int, int], starts: list[int], stops: list[int]) -> bool:
        lo, hi = part[0] - reach, part[1] + reach
        if i := bisect_left(blanks, part[0]):
            lo = max(lo, blanks[i - 1])
        if (i := bisect_left(blanks, part[1])) < len(blanks):
            hi = min(hi, blanks[i])
        # the first part behind this one and the last one before it; parts that overlap it don't complement it
        i, j = bisect_left(starts, part[1]), bisect_right(stops, part[0])
        return (i < len(starts) and starts[i] < hi) or (j > 0 and stops[j - 1] > lo)

    def places(parts: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
        return sorted(s for s, _ in parts), sorted(e for _, e in parts)

    secrets = keys + strong
    to_id, to_key, to_end = places(secrets), places(ids + ends + access), places(ids + secrets)
    out = [(*x, "id") for x in ids if near(x, *to_id)]
    out += [(*x, "key") for x in keys if near(x, *to_key)]
    out += [(*x, "endpoint") for x in ends if near(x, *to_end)]
    starts, reached = [s for s, *_ in base], list(accumulate((e for _, e, _ in base), max))
    return [x for x in out if not ((i := bisect_right(starts, x[0])) and reached[i - 1] >= x[1])]


def spans_of(text: str, reach: int = 300) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans; each by start, then kind."""
    base = base_spans(text)
    weak = linked_spans(text, base, reach)
    return base, sorted(base + weak, key=lambda x: (x[0], ORDER[x[2]])) if weak else base


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _scan(reach: int):
    def run(batches):
        for b in batches:
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in b.column("text"):
                base, all_ = spans_of(text.as_py() or "", reach)
                for k in BASE:
                    out[f"n_{k}"].append(sum(x[2] == k for x in base))
                joined = _joined(base)
                out["base_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                out["spans"].append(joined if all_ is base else _joined(all_))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["doc_id", *out])

    return run


def scan_secrets(docs: DataFrame, reach: int = 300) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan(reach), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, reach: int = 300) -> str:
    """The text with each run of overlapping spans replaced by <kind> of its first one."""
    out, end = [], 0
    for s, e, kind in spans_of(text, reach)[1]:
        if s >= end:
            out += [text[end:s], f"<{kind}>"]
        end = max(end, e)
    return "".join([*out, text[end:]]) if out else text


def redact_secrets(docs: DataFrame, reach: int = 300) -> DataFrame:
    """docs with secrets redacted in text; n_chars, where there is one, follows. Null texts stay null."""

    def run(batches):
        for b in batches:
            new = [None if (t := x.as_py()) is None else redact(t, reach) for x in b.column("text")]
            columns = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            columns["text"] = pa.array(new, b.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        same = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(same)))
    return out


def op5(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
