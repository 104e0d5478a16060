"""Event streams (ST1 to ST9): monotone logs, cursors, rate limits and state machines over keyed state.

The same row functions serve streams (keyed state, bounded to a few numbers for each key) and finished tables (one group's
rows in order). Rows of a micro-batch come in any order, so each group is sorted before its state moves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.runs import STATUS_ORDER, TERMINAL
from ..session import shared_folder


def monotone_rows(last: int, pdf: pd.DataFrame, sequence: str) -> tuple[int, pd.DataFrame]:
    """ST1: rows whose number is above all before them; the others are dropped, repeated and late ones alike."""
    pdf = pdf.sort_values(sequence, kind="stable").drop_duplicates(sequence)
    kept = pdf[pdf[sequence] > last]
    return (int(kept[sequence].max()) if len(kept) else last), kept


def fixed_window_rows(start: float, count: int, times: list[float], limit: int, seconds: float) -> tuple[float, int, list[bool]]:
    """ST7: a window opens with its first event; refused calls count, too."""
    allowed = []
    for t in times:
        if start < 0 or t >= start + seconds:
            start, count = t, 0
        count += 1
        allowed.append(count <= limit)
    return start, count, allowed


def sliding_log_rows(log: list[float], times: list[float], limit: int, seconds: float) -> tuple[list[float], list[bool]]:
    """ST8: a call is allowed if fewer than `limit` allowed ones lie in the last `seconds`; refused calls leave no trace. The log
    never holds more than `limit` entries."""
    allowed = []
    for t in times:
        log = [x for x in log if x > t - seconds]
        allowed.append(len(log) < limit)
        if allowed[-1]:
            log.append(t)
    return log, allowed


def transition_rows(place: int, ended: bool, stages: list[str]) -> tuple[int, bool, list[bool]]:
    """ST9: a run's status never moves backward, and nothing follows a terminal one."""
    order = {s: i for i, s in enumerate(STATUS_ORDER)}
    ok = []
    for s in stages:
        good = not ended and (s in ("FAILED", "CANCELLED") or order.get(s, -1) >= place)
        ok.append(good)
        if good:
            ended = s in TERMINAL
            place = max(place, order.get(s, place))
    return place, ended, ok


def _with_state(df: DataFrame, key: str, output: str, state: str, first: tuple, step, ttl_ms: int | None) -> DataFrame:
    def run(k, pdfs: Iterator[pd.DataFrame], held: GroupState):
        if held.hasTimedOut:
            held.remove()
            return
        now = held.get if held.exists else first
        now, out = step(now, pd.concat(list(pdfs)))
        held.update(tuple(now))
        if ttl_ms:
            held.setTimeoutDuration(ttl_ms)
        yield out

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(run, output, state, "append", timeout)


#: Fixed value: a day, as the stream's keys live.
DAY_MS = 86_400_000


def newest(log: DataFrame, key: str, sequence: str, most: int = 1000) -> DataFrame:
    """ST2: the last `most` events of each key, as a capped stream keeps them."""
    w = Window.partitionBy(key).orderBy(F.desc(sequence))
    return log.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def monotone_log(events: DataFrame, key: str, sequence: str, ttl_ms: int | None = None) -> DataFrame:
    """ST1, ST2 on a stream: one number of state for each key, dropped ttl_ms (DAY_MS in a service) after its last event. A
    time to live needs a trigger that goes on: with availableNow, batches without data would follow without end."""

    def step(now, pdf):
        last, kept = monotone_rows(now[0], pdf, sequence)
        return (last,), kept

    return _with_state(events, key, events.schema.simpleString()[7:-1].replace(":", " "), "last bigint", (-1,), step, ttl_ms)


def fixed_window_limit(events: DataFrame, key: str, at: str, limit: int, seconds: float, ttl_ms: int | None = None) -> DataFrame:
    """ST7 on a stream: key, at, allowed."""

    def step(now, pdf):
        pdf = pdf.sort_values(at, kind="stable")
        start, count, ok = fixed_window_rows(now[0], now[1], (pdf[at].astype("int64") / 1e6).tolist() if pdf[at].dtype.kind != "f" else pdf[at].tolist(), limit, seconds)
        return (start, count), pd.DataFrame({key: pdf[key], at: pdf[at], "allowed": ok})

    kind = dict(events.dtypes)
    e = events.select(key, F.col(at).cast("double").alias(at))
    return _with_state(e, key, f"{key} {kind[key]}, {at} double, allowed boolean", "start double, count bigint", (-1.0, 0), step, ttl_ms)


def transitions(events: DataFrame, key: str, sequence: str, stage: str) -> DataFrame:
    """ST9 on a stream: events with valid."""

    def step(now, pdf):
        pdf = pdf.sort_values(sequence, kind="stable")
        place, ended, ok = transition_rows(now[0], now[1], pdf[stage].tolist())
        return (place, ended), pdf.assign(valid=ok)

    kind = dict(events.dtypes)
    return _with_state(events.select(key, sequence, stage), key, f"{key} {kind[key]}, {sequence} {kind[sequence]}, {stage} string, valid boolean", "place bigint, ended boolean", (0, False), step, None)


def rate_limited(events: DataFrame, key: str, at: str, limit: int, seconds: float, sliding: bool = False) -> DataFrame:
    """ST7, ST8 on a finished table: key, at (seconds), n of allowed and refused events. A key's rows stream through a worker
    in order, in batches; state is a few numbers."""

    def run(batches):
        held: dict = {}
        for pdf in batches:
            out = []
            for k, rows in pdf.groupby(key, sort=False):
                times = rows[at].tolist()
                if sliding:
                    held_k, ok = sliding_log_rows(held.get(k, []), times, limit, seconds)
                else:
                    start, count = held.get(k, (-1.0, 0))
                    start, count, ok = fixed_window_rows(start, count, times, limit, seconds)
                    held_k = (start, count)
                held = {k: held_k}  # rows are sorted by key: only the last key goes on
                out.append(rows.assign(allowed=ok))
            yield pd.concat(out) if out else pdf.assign(allowed=pd.Series(dtype=bool))

    kind = dict(events.dtypes)
    e = events.select(key, F.col(at).cast("double").alias(at))
    return e.repartition(key).sortWithinPartitions(key, at).mapInPandas(run, f"{key} {kind[key]}, {at} double, allowed boolean")


def trailing_count(events: DataFrame, key: str, at: Column, seconds: int) -> DataFrame:
    """How many events of the key lie in the last seconds, the event included."""
    w = Window.partitionBy(key).orderBy("__s").rangeBetween(-seconds + 1, 0)
    return events.withColumn("__s", at.cast("long")).withColumn("recent", F.count(F.lit(1)).over(w)).drop("__s")


def after_cursor(events: DataFrame, cursors: DataFrame, key: str, sequence: str) -> DataFrame:
    """ST3: events strictly above their key's cursor; all of them where there is none."""
    c = cursors.select(key, F.col("cursor"))
    return events.join(c, key, "left").where(F.col("cursor").isNull() | (F.col(sequence) > F.col("cursor"))).drop("cursor")


def with_durable_fallback(stream: DataFrame, durable: DataFrame, key: str) -> DataFrame:
    """ST4, ST6: the stream's events, and the durable ones of keys that the stream has lost."""
    return stream.unionByName(durable.join(stream.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def once(events: DataFrame) -> DataFrame:
    """ST5."""
    return events.dropDuplicates(["created_at", "stage", "event_type"])


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream; a file of it is a batch. A table that is one file is found in its folder by name."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))


def run_to_end(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream over what is there now; its output is a table in `folder`, else in the shared one."""
    spark = stream.sparkSession
    at = f"{(folder or shared_folder(spark)).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
