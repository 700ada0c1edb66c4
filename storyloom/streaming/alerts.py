"""Alerts from a stream of events: a source that falls silent, a pipeline that stands still. Each is raised once and cleared on recovery.

Silence is a timer in a source's keyed state: every arrival sets it anew, and when event time passes it the source is silent. A stall is
seen in hourly counts, which the stream sums first, so the one state that watches the whole pipeline gets a few rows an hour. Event time
advances with the watermark; a tick (an event of no source) moves it when nothing else does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from storyloom import constants as K

HOUR_US = 3_600_000_000
SILENCE = "key string, kind string, since_us long, at_us long"


def _reduced(times: np.ndarray) -> np.ndarray:
    """The first and the last time of every hour, in order: a silence of an hour or more lies between two of them."""
    if not len(times):
        return times
    times = np.sort(times)
    hour = times // HOUR_US
    first = np.append(True, hour[1:] != hour[:-1])
    return np.unique(np.concatenate([times[first], times[np.append(first[1:], True)]]))


class _Silence(StatefulProcessor):
    """State of a source: its last arrival and whether its silence has been reported."""

    def __init__(self, span_us: int) -> None:
        self.span_us = span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, silent boolean")

    def _row(self, key: tuple, kind: str, since: int, at: int) -> tuple:
        return (key[0], kind, since, at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.zeros(0, dtype=np.int64)
        for b in rows:  # a hot source's rows come in chunks; two times an hour are kept
            times = _reduced(np.concatenate([times, b["t"].to_numpy(dtype=np.int64)]))
        last, silent = self.seen.get() if self.seen.exists() else (None, False)
        out = []
        for t in times.tolist():
            if last is not None and t <= last:
                continue
            if last is not None and not silent and t - last >= self.span_us:
                out.append(self._row(key, "silent", last, last + self.span_us))
                silent = True
            if silent:
                out.append(self._row(key, "recovered", last, t))
                silent = False
            last = t
        self.seen.update((last, silent))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if not silent:
            self.handle.registerTimer((last + self.span_us) // 1000)
        yield pd.DataFrame(out, columns=["key", "kind", "since_us", "at_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, silent = self.seen.get()
        out = [] if silent else [self._row(key, "silent", last, last + self.span_us)]
        self.seen.update((last, True))
        yield pd.DataFrame(out, columns=["key", "kind", "since_us", "at_us"])

    def close(self) -> None:
        return None


def _times(df: DataFrame) -> DataFrame:
    ntz = lambda x: F.timestamp_micros(x).cast("timestamp_ntz")
    return df.select("key", "kind", ntz("since_us").alias("since"), ntz("at_us").alias("at"))


def silence_stream(stream: DataFrame, hours: int = K.SILENCE_HOURS, late: str = "1 hour") -> DataFrame:
    """(key, kind, since, at) for `stream(key, ts)`: `silent` when a source has sent nothing for `hours` since `since`, `recovered` when it
    sends again. Rows with a NULL key are ticks. Needs the RocksDB state store."""
    rows = stream.select("key", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("t", F.unix_micros("ts"))
    out = rows.withColumn("key", F.coalesce("key", F.lit(""))).groupBy("key").transformWithStateInPandas(
        _Silence(hours * HOUR_US), outputStructType=SILENCE, outputMode="Append", timeMode="EventTime")
    return _times(out.filter("key <> ''"))


class _Stall(StatefulProcessor):
    """State of the pipeline: the last hour seen, what each of the last hours processed, what waits, whether a stall is reported."""

    def __init__(self, hours: int, min_pending: int) -> None:
        self.hours, self.min_pending = hours, min_pending

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "hour long, done array<long>, pending long, raised boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).groupby("hour", as_index=True)[["fetched", "processed"]].sum().sort_index()  # a row per hour
        if self.state.exists():
            hour, done, pending, raised = self.state.get()
            done = list(done)
        else:
            hour, done, pending, raised = int(found.index[0]) - 1, [], 0, False
        out = []
        for at, fetched, processed in zip(found.index.tolist(), found["fetched"].tolist(), found["processed"].tolist()):
            while hour < at:  # hours without any event count as well
                hour += 1
                now = (fetched, processed) if hour == at else (0, 0)
                done, pending = [*done, now[1]][-self.hours :], pending + now[0] - now[1]
                if sum(done) > 0:
                    if raised:
                        out.append(("recovered", hour, sum(done), pending))
                    raised = False
                elif pending >= self.min_pending and not raised:
                    out.append(("stalled", hour, 0, pending))
                    raised = True
        self.state.update((hour, done, pending, raised))
        yield pd.DataFrame(out, columns=["kind", "hour", "done", "pending"])

    def close(self) -> None:
        return None


def hourly_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, fetched, processed) of `stream(ts, kind)`, each hour once, when event time has passed it. Other kinds are ticks."""
    return (
        stream.select(F.col("ts").cast("timestamp").alias("ts"), "kind").withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour"))
        .agg(F.count_if(F.col("kind") == "fetched").alias("fetched"), F.count_if(F.col("kind") == "processed").alias("processed"))
        .select(F.col("window.start").alias("hour"), "fetched", "processed")
    )


def stall_stream(hours_closed: DataFrame, hours: int = K.STALL_HOURS, min_pending: int = K.STALL_MIN_PENDING) -> DataFrame:
    """(kind, hour, done, pending) for a stream of closed hours, the table that `hourly_counts` feeds."""
    rows = hours_closed.select(F.lit("pipeline").alias("key"), (F.unix_seconds(F.col("hour").cast("timestamp")) / 3600).cast("long").alias("hour"), "fetched", "processed")
    out = rows.groupBy("key").transformWithStateInPandas(
        _Stall(hours, min_pending), outputStructType="kind string, hour long, done long, pending long", outputMode="Append", timeMode="None")
    return out.withColumn("hour", F.timestamp_seconds(F.col("hour") * 3600).cast("timestamp_ntz"))
