"""Session and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "factloom", **conf: str) -> SparkSession:
    """A session with what the engine relies on: UTC, adaptive execution with skew handling."""
    builder = SparkSession.builder.appName(name)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints; one of our own only where the session names none (tests)."""
    import tempfile

    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = getattr(sc, "_factloom_folder", None)
        if named is None:
            named = sc._factloom_folder = "file://" + tempfile.mkdtemp(prefix="factloom-")
    return named.rstrip("/")


def reliable(spark: SparkSession) -> None:
    """Make checkpoint() write to the shared folder, unless the session has a place for it."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: what follows has a plan of its own, reads the columns it needs, and survives
    lost executors."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factloom_path = path
    return out


def unwritten(*tables: DataFrame) -> None:
    """Delete tables that written() made and nobody reads any more."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._factloom_path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """df for row work that outweighs a shuffle: a scan of fewer partitions than there are cores is dealt out over them. A large
    table's scan has more, and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def ship(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once for each application: nothing needs to be installed on a cluster."""
    import shutil
    import tempfile
    from pathlib import Path

    sc = spark.sparkContext
    if not getattr(sc, "_factloom_shipped", False):
        here = Path(__file__).parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='factloom-')}/factloom", "zip", here.parent, here.name)
        sc.addPyFile(archive)
        sc._factloom_shipped = True
    return spark
