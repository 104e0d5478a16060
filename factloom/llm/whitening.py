"""Whitening of vectors by matrix-free block subspace iteration.

The covariance is never formed on an executor, and on the driver only as far as the block asks: each Spark pass computes X'(XQ) over
the centred rows for a block Q of directions, as a sum of small matrices. The driver orthonormalises the block (QR), rotates it to
its Ritz vectors and measures the residuals; passes go on until those of all k components are below `tolerance` times the largest
Ritz value. Where residuals shrink too slowly, as they do for spectra without a gap, the block is widened by new directions; a
block as wide as the space is exact after one pass, so that the iteration always ends.

Components are integers x = floor(scale c) + shift, sums of them are exact, and a row is centred before anything is multiplied:
n x - S is exact in whole numbers. Sent to the driver: dimensions x block numbers, summed on Spark before.

Cases: a null vector, or one with a null or non-finite entry, has no row and isn't fitted on. Repeated rows and null vec_ids are
rows like others. Shorter vectors count as filled up with c = 0. Directions without variance (fewer vectors than components, equal
vectors) are no components; a table without variance gives no rows, as an empty one does. A deviation beyond 63 bits is null. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_rows import filled, usable_rows

ROWS = 4096
#: Passes after which an iteration that hasn't been certified is an error; a block is widened long before.
PASSES = 500


def integers(rows: DataFrame, scale: int, shift: int) -> DataFrame:
    return rows.withColumn("embedding", F.transform("embedding", lambda x: (F.floor(x * F.lit(float(scale))) + shift).cast("long")))


class Fit:
    """What workers need of a fitted table: n, the sums S, how short rows are filled."""

    def __init__(self, n: int, sums: np.ndarray, fill: int):
        self.n, self.sums, self.fill = n, sums, fill

    def centred(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """n x - S in whole numbers, and x - S/n in doubles."""
        whole = filled(column, len(self.sums), self.fill) * self.n - self.sums
        return whole, whole / self.n


def _cells(batches: Iterator[pa.RecordBatch], shape: tuple[int, int], part: Callable[[pa.Array], np.ndarray]):
    """The sum of part(vectors) over a task's rows, a row for each line of the matrix."""
    total, some = np.zeros(shape), False
    for b in batches:
        for first in range(0, b.num_rows, ROWS):
            total += part(b.column("embedding").slice(first, ROWS))
            some = True
    if some:
        line = pa.ListArray.from_arrays(pa.array(np.arange(shape[0] + 1, dtype=np.int32) * shape[1], pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), line], ["i", "line"])


def _summed(rows: DataFrame, shape: tuple[int, int], part: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """Matrices of tasks, added up on Spark cell by cell."""
    lines = rows.select("embedding").mapInArrow(lambda batches: _cells(batches, shape, part), "i int, line array<double>")
    cells = lines.select("i", F.posexplode("line").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(shape)
    out[cells["i"], cells["j"]] = cells["v"]
    return out


def fit(rows: DataFrame, fill: int) -> Fit | None:
    """n and S in one pass; None without rows."""
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not head["n"] or not head["d"]:
        return None

    def sums(batches):
        total = np.zeros(head["d"], np.int64)
        for b in batches:
            for first in range(0, b.num_rows, ROWS):
                total += filled(b.column("embedding").slice(first, ROWS), len(total), fill).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "s"])

    each = rows.select("embedding").mapInArrow(sums, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(head["d"], np.int64)
    for r in each:
        total[r["i"]] = r["s"]
    return Fit(head["n"], total, fill)


def covariance_times(rows: DataFrame, f: Fit, q: np.ndarray) -> np.ndarray:
    """VQ: one pass over the rows, centred, with the divisor n."""

    def part(column):
        x = f.centred(column)[1]
        return x.T @ (x @ q)

    return _summed(rows, q.shape, part) / f.n


def components(rows: DataFrame, f: Fit, k: int, block: int | None = None, tolerance: float = 1e-11, patience: int = 12, seed: int = 5, watch: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns), k at most. block: directions iterated at first, twice k as a rule.
    watch: gets (block, largest residual) of each pass."""
    d = len(f.sums)
    k = min(k, d)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(d, min(d, max(k, block or 2 * k)))))[0]
    best, idle = np.inf, 0
    for _ in range(PASSES):
        z = covariance_times(rows, f, q)
        h = q.T @ z
        value, turn = np.linalg.eigh((h + h.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        q, z = q @ turn, z @ turn
        residual = float(np.linalg.norm(z[:, :k] - q[:, :k] * value[:k], axis=0).max())
        if watch is not None:
            watch.append((q.shape[1], residual))
        if residual <= tolerance * value[0] or value[0] <= 0:
            some = value[:k] > max(value[0], 0) * 1e-12
            q = q[:, :k][:, some]
            top = q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])]
            return value[:k][some], q * np.where(top < 0, -1.0, 1.0)
        best, idle = (residual, 0) if residual < best * 0.5 else (best, idle + 1)
        if idle >= patience and q.shape[1] < d:
            wider = min(d, 2 * q.shape[1])
            z = np.concatenate((z, rng.normal(size=(d, wider - z.shape[1])) * np.linalg.norm(z, axis=0).min()), axis=1)
            best, idle = np.inf, 0
        q = np.linalg.qr(z)[0]
    raise RuntimeError(f"not certified after {PASSES} passes: residual {residual}")


def _whiten(f: Fit, value: np.ndarray, axes: np.ndarray, explained: np.ndarray, error: float):
    scaled, k = axes / np.sqrt(value), len(value)

    def run(batches):
        for b in batches:
            for first in range(0, b.num_rows, ROWS):
                part = b.slice(first, ROWS)
                whole, x = f.centred(part.column("embedding"))
                if float(np.abs(whole).max(initial=0)) ** 2 * whole.shape[1] < 2**62:
                    deviation = pa.array((whole * whole).sum(axis=1))
                else:
                    sums = [sum(v * v for v in row) for row in whole.tolist()]
                    deviation = pa.array([s if s < 2**63 else None for s in sums], pa.int64())
                y, m = x @ scaled, part.num_rows
                row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n)), deviation.take(row),
                        pa.array(y.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(embeddings: DataFrame, k: int = 32, scale: int = 64, shift: int = 1_000_000, block: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: for each row its places on the first k components."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integers(usable_rows(embeddings), scale, shift)
    f = fit(rows, shift)
    value, axes = components(rows, f, k, block) if f else (np.zeros(0), None)
    if not len(value):
        return rows.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", ")[1:])])
    scaled, square = axes / np.sqrt(value), (len(value), len(value))

    def spread(column):
        y = f.centred(column)[1] @ scaled
        return y.T @ y

    def variance(column):
        x = f.centred(column)[1]
        return np.array([[(x * x).sum()]])

    # rows are centred over the fit list itself, so the whitened mean is 0 but for rounding
    error = float(np.abs(_summed(rows, square, spread) / f.n - np.eye(len(value))).max())
    trace = float(_summed(rows, (1, 1), variance)[0, 0]) / f.n
    return rows.mapInArrow(_whiten(f, value, axes, value / trace, error), schema)


def op13(spark, sf_dir: str) -> DataFrame:
    """32 components of floor(64 c) + 1000000."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
