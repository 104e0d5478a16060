"""Streams against the finished table: sliding logs, events once, durable fallback, capped sinks, versions."""

import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.sources import versions as VS
from factloom.streaming import events as EV
from factloom.streaming import keyed as K


def files(spark, folder, rows, schema, n):
    """n files, each written after the one before it, which is the order of the stream."""
    for i in range(n):
        spark.createDataFrame(rows[i::n], schema).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, at):
    q = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out")


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, K.ROCKSDB)
    yield spark
    spark.conf.set(name, before)


def test_sliding_log_on_a_stream_equals_the_table(rocks, tmp_path):
    spark, rng = rocks, random.Random(5)
    rows = [(f"u{rng.randrange(4)}", rng.randrange(0, 4000) / 10) for _ in range(300)]
    rng.shuffle(rows)
    files(spark, f"{tmp_path}/in", rows, "client string, at double", 4)
    files(spark, f"{tmp_path}/in", [("end", 1e6)], "client string, at double", 1)  # moves the watermark past all others
    s = stream_of(spark, f"{tmp_path}/in", "client string, at double")
    got = run(K.sliding_window_limit(s, "client", F.col("at"), 8, 60, "600 seconds"), tmp_path).where("client <> 'end'").collect()
    table = spark.createDataFrame(rows, "client string, at double")
    want = [tuple(r) for r in EV.rate_limited(table, "client", "at", 8, 60, sliding=True).select("client", "at", "allowed").collect()]
    assert sorted(map(tuple, got)) == sorted(want) and not all(r[2] for r in want)


def test_restart_gives_neither_loss_nor_repeats(spark, tmp_path):
    start = 1_700_000_000
    event = lambda i, body: ("r", i, i, body)
    to_rows = lambda xs: spark.createDataFrame([(r, n, start + 10 * s, b) for r, n, s, b in xs], "run string, no int, s long, body string").select("run", "no", F.timestamp_seconds("s").alias("at"), "body")
    live = [event(i, "live") for i in range(40) if i % 3]
    durable = [event(i, "kept") for i in range(40)]
    schema = to_rows(live).schema

    def add(part):
        for name, xs in (("live", live), ("kept", durable)):
            xs = [x for x in xs if (x[1] < 20) == part] if part is not None else [("end", 10_000, 10_000, "end")]
            to_rows(xs + xs[:3]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")  # and some events twice

    def query():
        a, b = (stream_of(spark, f"{tmp_path}/{name}", schema) for name in ("live", "kept"))
        return run(K.with_durable_fallback_on_stream(a, b, ["run", "no"], "at", "60 seconds"), f"{tmp_path}/q")

    for part in (True, False, None):
        add(part)
        got = query()  # each time from the checkpoint of the time before
    rows = [(r["no"], r["body"], r["from_durable"]) for r in got.where("run = 'r'").collect()]
    assert sorted(rows) == [(i, "live" if i % 3 else "kept", i % 3 == 0) for i in range(40)]


def test_a_batch_played_again_leaves_the_same_table(spark, tmp_path):
    rng = random.Random(6)
    schema = StructType.fromDDL("k string, n int, body string")
    rows = [(f"k{rng.randrange(5)}", i, f"b{i}") for i in range(200)]
    table = VS.BucketTable(spark, f"{tmp_path}/t", schema, "k", 4)
    sink = VS.capped_sink(table, "n", 7)
    want = lambda part: sorted(r for k in {r[0] for r in part} for r in sorted([x for x in part if x[0] == k], key=lambda x: -x[1])[:7])
    for b in range(4):
        batch = spark.createDataFrame(rows[b * 50 : b * 50 + 50] + rows[b * 50 : b * 50 + 5], schema)
        for _ in range(2):
            sink(batch, b)
            assert sorted(map(tuple, table.read().collect())) == want(rows[: b * 50 + 50])
    sink(spark.createDataFrame(rows[:50], schema), 0)  # long past
    assert sorted(map(tuple, table.read().collect())) == want(rows)
    assert sorted(map(tuple, table.read(1).collect())) == want(rows[:100])


def test_a_stream_into_the_capped_sink(spark, tmp_path):
    schema = StructType.fromDDL("k string, n int, body string")
    rows = [(f"k{i % 3}", i, "x") for i in range(60)]
    files(spark, f"{tmp_path}/in", rows, schema, 3)
    table = VS.BucketTable(spark, f"{tmp_path}/t", schema, "k", 4)
    q = stream_of(spark, f"{tmp_path}/in", schema).writeStream.foreachBatch(VS.capped_sink(table, "n", 4)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["k"], r["n"]) for r in table.read().collect()) == sorted((f"k{k}", n) for k in range(3) for n in [i for i in range(60) if i % 3 == k][-4:])


def test_a_rerun_adds_no_version(spark, tmp_path):
    schema = StructType.fromDDL("source string, version int, content string, run string")
    table = VS.BucketTable(spark, f"{tmp_path}/{uuid.uuid4().hex}", schema, "source", 3)
    runs = [("r1", {"a": "1", "b": "1", "c": None}), ("r2", {"a": "1", "b": "2", "c": None}), ("r2", {"a": "1", "b": "2", "c": None}), ("r3", {"b": "1", "d": "9"})]
    for n, (name, has) in enumerate(runs):
        table.commit(n, spark.createDataFrame([(k, v, name) for k, v in has.items()], "source string, content string, run string"), VS.next_versions("source", "content", "run"))
    got = sorted(map(tuple, table.read().collect()))
    assert got == [("a", 1, "1", "r1"), ("b", 1, "1", "r1"), ("b", 2, "2", "r2"), ("b", 3, "1", "r3"), ("c", 1, None, "r1"), ("d", 1, "9", "r3")]
