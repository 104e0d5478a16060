"""Streams whose answers are those of the finished table, whatever the order of the micro-batches: a sliding log with timers (ST8),
events once and with a durable fallback (ST4 to ST6). Late rows, beyond the watermark, are left out; that is what bounds the state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .events import sliding_log_rows

#: The state store that keyed processors with timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _SlidingLog(StatefulProcessor):
    """A key's undecided calls and its log of allowed ones. A call is decided when the watermark has passed it, so that none before
    it is missing; entries leave the log with the window, and a key's state goes with its last entry."""

    def __init__(self, key: str, at: str, limit: int, seconds: float):
        self.key, self.at, self.limit, self.seconds = key, at, limit, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting, self.log = handle.getListState("waiting", "at double"), handle.getListState("log", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            times = pdf[self.at].astype(float).tolist()
            self.waiting.appendList([(t,) for t in times])
            for ms in {math.ceil(t * 1000) for t in times}:
                self.handle.registerTimer(ms)
        yield pd.DataFrame({self.key: pd.Series(dtype=object), self.at: pd.Series(dtype=float), "allowed": pd.Series(dtype=bool)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        waiting = sorted(t for (t,) in self.waiting.get())
        due = [t for t in waiting if t <= now]
        log, allowed = sliding_log_rows(sorted(t for (t,) in self.log.get()), due, self.limit, self.seconds)
        log = [t for t in log if t > now - self.seconds]
        self._keep(self.waiting, waiting[len(due) :])
        self._keep(self.log, log)
        if due and log:
            self.handle.registerTimer(math.ceil((log[-1] + self.seconds) * 1000))  # the entries' end
        yield pd.DataFrame({self.key: pd.Series([key[0]] * len(due), dtype=object), self.at: pd.Series(due, dtype=float), "allowed": pd.Series(allowed, dtype=bool)})

    @staticmethod
    def _keep(state, times: list[float]) -> None:
        if times:
            state.put([(t,) for t in times])
        else:
            state.clear()

    def close(self) -> None:
        pass


def sliding_window_limit(events: DataFrame, key: str, at: Column, limit: int, seconds: float, late: str) -> DataFrame:
    """ST8 on a stream: key, at (seconds), allowed; equal to rate_limited(sliding=True) over the whole table if no row comes later
    than `late`. Rows may come in any order; a call is answered once the watermark has passed it. The session needs ROCKSDB as its
    state store."""
    e = events.select(key, at.cast("timestamp").alias("__time"), at.cast("double").alias("at")).withWatermark("__time", late)
    kind = dict(e.dtypes)[key]
    return e.groupBy(key).transformWithStateInPandas(_SlidingLog(key, "at", limit, seconds), f"{key} {kind}, at double, allowed boolean", "Append", "EventTime")


def once_on_stream(events: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """ST5 on a stream: the first event of each combination of keys; a repeat that comes within `late` of it is dropped. State is
    bounded by the watermark, unlike with a plain dropDuplicates."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def with_durable_fallback_on_stream(stream: DataFrame, durable: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """ST4, ST6 on streams: each event once, the live copy where there is one, else the durable one, after the watermark has passed
    it. Both streams have the same columns; copies of an event have equal keys and times. Neither side is kept beyond `late`."""
    live, kept = (once_on_stream(df, at, [*keys, at], late) for df in (stream, durable))
    on = [F.col(f"live.{k}") == F.col(f"kept.{k}") for k in [*keys, at]]
    both = live.alias("live").join(kept.alias("kept"), on, "full_outer")
    return both.select(*[F.coalesce(f"live.{c}", f"kept.{c}").alias(c) for c in stream.columns], F.col(f"live.{at}").isNull().alias("from_durable"))
