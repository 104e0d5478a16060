"""Tables that a batch changes as a whole or not at all (ST2, IO17, IO18, IO24).

Rows lie in buckets by key. A commit writes the buckets that its batch touches into a folder of its own, then a manifest that says
in which commit each bucket lies now. Readers follow the newest manifest, which appears by a rename, so they see a commit
whole or not at all. A commit that is made again starts from the manifest before it and writes the same: a replayed batch changes
nothing. Buckets that a batch doesn't touch are neither read nor written.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        folder = self.hadoop.Path(f"{self.path}/manifests")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("_"))

    def _manifest(self, commit: int | None) -> dict[int, int]:
        """bucket: the commit it lies in. A line for each bucket, so its size is bounded."""
        if commit is None:
            return {}
        lines = self.spark.read.text(f"{self.path}/manifests/{commit}.json").collect()
        return {int(b): c for b, c in json.loads(lines[0][0]).items()}

    def _rows(self, manifest: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/{c}/bucket={b}" for b, c in sorted(manifest.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, commit: int | None = None) -> DataFrame:
        """The table as it is, or as a commit left it."""
        commits = self._commits()
        return self._rows(self._manifest(commit if commit is not None else commits[-1] if commits else None))

    def commit(self, number: int, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the buckets that `batch` touches by merge(their rows, batch). Numbers rise; a number given again is made again,
        if none follows it, and is left alone otherwise."""
        commits = self._commits()
        if commits and commits[-1] > number:
            return
        earlier = [c for c in commits if c < number]
        manifest = self._manifest(earlier[-1] if earlier else None)
        touched = [r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect()]  # at most `buckets` rows
        old = self._rows({b: c for b, c in manifest.items() if b in touched})
        merged = merge(old, batch).select(*self.schema.names).withColumn("bucket", self.bucket())
        merged.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{number}")
        for b in touched:
            there = self.fs.exists(self.hadoop.Path(f"{self.path}/data/{number}/bucket={b}"))
            manifest.pop(b, None)
            if there:
                manifest[b] = number
        self._publish(number, manifest)

    def _publish(self, number: int, manifest: dict[int, int]) -> None:
        folder = f"{self.path}/manifests"
        self.fs.mkdirs(self.hadoop.Path(folder))
        fresh, final = self.hadoop.Path(f"{folder}/_{number}.json"), self.hadoop.Path(f"{folder}/{number}.json")
        out = self.fs.create(fresh, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self.fs.exists(final):
            self.fs.delete(final, False)
        self.fs.rename(fresh, final)


def newest_of_each(key: str, sequence: str, most: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """ST2, IO24: the last `most` rows of a key; a row that comes again counts once."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        every = old.unionByName(new.select(*old.columns)).dropDuplicates([key, sequence])
        return every.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(sequence)))).where(F.col("__n") <= most).drop("__n")

    return merge


def capped_sink(table: BucketTable, sequence: str, most: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the newest `most` rows of each key; a batch that is played again leaves the same table."""
    return lambda batch, number: table.commit(number, batch, newest_of_each(table.key, sequence, most))


def next_versions(key: str, content: str, run: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """IO17, IO18: old has key, version, content, run. A key whose content isn't that of its last version gets the next number,
    linked with the run that brought it; a run that brings nothing new adds none. new: key, content, run, one row for each key."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        last = old.groupBy(key).agg(F.max_by(F.struct("version", content), "version").alias("__last"))
        j = new.select(key, content, run).join(last, key, "left")
        changed = j.where(F.col("__last").isNull() | ~F.col(f"__last.{content}").eqNullSafe(F.col(content)))
        added = changed.select(key, (F.coalesce("__last.version", F.lit(0)) + 1).cast("int").alias("version"), content, run)
        return old.unionByName(added)

    return merge
