"""What the training-data operators share: the shared folder, byte views of Arrow text, and 64-bit hashing."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20  # text bytes that a Python worker looks at together


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where the session names none (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = getattr(sc, "_factloom_dir", None)
        if named is None:
            named = sc._factloom_dir = "file://" + tempfile.mkdtemp(prefix="factloom-")
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._factloom_path = path
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As materialize(), but dealt into buckets by key: later joins on the key shuffle the other side alone."""
    spark = df.sparkSession
    table = f"factloom_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/factloom/{table}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one task for each bucket, so that each has one file
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._factloom_path, out._factloom_table = path, table
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() or bucketed() wrote and nobody reads any more."""
    spark = df.sparkSession
    if table := getattr(df, "_factloom_table", None):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    at = spark._jvm.org.apache.hadoop.fs.Path(df._factloom_path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the offsets of its rows in them; null counts as empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about `limit` bytes of text; a longer text comes alone."""
    for batch in batches:
        _, at = utf8(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            last = min(last, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words with good avalanche (the splitmix64 finaliser); works on a copy."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2^64
_pow = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["up"]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _pow[key] = np.cumprod(steps)
    return _pow["up"], _pow["down"]


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: a polynomial, but for long spans, whose structure could defeat it, a digest."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    for i in np.flatnonzero(ends - starts > 64).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix64(h ^ ((ends - starts).astype(np.uint64) * _M1))


def word_spans(data: np.ndarray, at: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes where gap[byte] is false, never across rows: starts, ends, row of each."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~gap[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:n]
    ends = word
    ends[:-1] &= gap[data[1:]] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(at, s, "right") - 1
