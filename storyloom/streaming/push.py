"""Pushes to readers: what goes out, in the order in which items are processed.

A reader is a small state machine: the times of the last sends, for the cap in a trailing window, and the stories sent, so that another
member of a story stays quiet. An item is looked at once, when it is processed; the cap is tested first, then the story, and only a send
changes the state. Rules that need no state (score, area, quiet hours) are filters before it. The state of a reader grows by what is
sent, which the cap bounds, not by what is offered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from storyloom import constants as K
from storyloom.operators import scoring
from storyloom.streaming.limiter import MINUTE_US

SENT = "reader long, t long, id long, cluster_id long"


def offers(
    items: DataFrame, subscriptions: DataFrame, threshold: float = K.PUSH_THRESHOLD, tweet_threshold: float = K.TWEET_PUSH_THRESHOLD,
    quiet: str = K.QUIET_HOURS, at: str = "processed_at",
) -> DataFrame:
    """(reader, t, id, cluster_id) of the items that a reader of `subscriptions(reader, vertical)` may be sent, state aside. An item
    outside a story is a story of its own."""
    limit = F.when(F.col("feed_name").startswith("tw_"), min(threshold, tweet_threshold)).otherwise(threshold)
    fit = items.filter(
        F.col(at).isNotNull() & F.col("personal_score").isNotNull() & F.col("pushed_at").isNull()
        & (F.col("personal_score") >= limit) & ~scoring.in_quiet_hours(F.col(at), quiet))
    rows = fit.select("vertical", F.unix_micros(F.col(at).cast("timestamp")).alias("t"), "id", "cluster_id")
    return rows.join(subscriptions, "vertical").select("reader", "t", "id", "cluster_id")


class Reader:
    """One reader's state: `times` of the last sends, oldest first, and the stories sent."""

    def __init__(self, cap: int, window_us: int, times: list[int] | None = None) -> None:
        self.cap, self.window_us, self.times = cap, window_us, times or []

    def full(self, t: int) -> bool:
        return len(self.times) >= self.cap and self.times[-self.cap] >= t - self.window_us

    def send(self, t: int) -> None:
        self.times.append(t)
        del self.times[: -self.cap]


def pushes(candidates: DataFrame, cap: int = K.MAX_PUSH_PER_HOUR, minutes: int = 60) -> DataFrame:
    """The rows of `candidates(reader, t, id, cluster_id)` that are sent. A reader's rows arrive sorted in Arrow batches and are not
    held; readers spread over the tasks."""
    ordered = candidates.select("reader", "t", "id", "cluster_id").repartition("reader").sortWithinPartitions("reader", "t", "id")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, stories = None, None, set()
        for b in batches:
            keep = []
            for reader, t, story in zip(b["reader"].tolist(), b["t"].tolist(), b["cluster_id"].tolist()):
                if reader != key:
                    key, state, stories = reader, Reader(cap, minutes * MINUTE_US), set()
                alone = story is None or story != story
                ok = not state.full(t) and (alone or story not in stories)
                if ok:
                    state.send(t)
                    if not alone:
                        stories.add(story)
                keep.append(ok)
            yield b[keep]

    return ordered.mapInPandas(scan, SENT)


class _Pusher(StatefulProcessor):
    def __init__(self, cap: int, window_us: int) -> None:
        self.cap, self.window_us = cap, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "times array<long>")
        self.stories = handle.getMapState("stories", "cluster_id long", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = Reader(self.cap, self.window_us, list(self.times.get()[0]) if self.times.exists() else None)
        # a reader's rows of a micro-batch come in several chunks and in no order of time: three numbers a row are held
        batch = pd.concat(list(rows)).sort_values(["t", "id"])
        keep = []
        for t, story in zip(batch["t"].tolist(), batch["cluster_id"].tolist()):
            alone = story is None or story != story
            ok = not state.full(t) and (alone or not self.stories.containsKey((int(story),)))
            if ok:
                state.send(int(t))
                if not alone:
                    self.stories.updateValue((int(story),), (int(t),))
            keep.append(ok)
        self.times.update((state.times,))
        yield batch[keep][["reader", "t", "id", "cluster_id"]]

    def close(self) -> None:
        return None


def push_stream(stream: DataFrame, cap: int = K.MAX_PUSH_PER_HOUR, minutes: int = 60) -> DataFrame:
    """The streaming form of `pushes`: value state for the times, map state for the stories. Needs the RocksDB state store."""
    return stream.select("reader", "t", "id", "cluster_id").groupBy("reader").transformWithStateInPandas(
        _Pusher(cap, minutes * MINUTE_US), outputStructType=SENT, outputMode="Append", timeMode="None")
