"""Rate limit: at most `cap` sends in any trailing window, in order of time, per user.

The decision on a candidate depends on the last `cap` accepted ones, so a user's candidates are read in order, but never
held by the batch form, which streams over them and keeps `cap` times per user; the streaming form holds a user's times of one
micro-batch, whose size the source bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from storyloom import constants as K

MINUTE_US = 60_000_000


def accept(sent: list[int], t: int, cap: int, window_us: int) -> bool:
    """Whether a send at `t` is allowed after `sent` (ascending, at most `cap` kept); remembers it if so."""
    if len(sent) >= cap and sent[-cap] >= t - window_us:
        return False
    sent.append(t)
    del sent[:-cap]
    return True


def limited(candidates: DataFrame, cap: int = K.MAX_PUSH_PER_HOUR, minutes: int = 60) -> DataFrame:
    """Accepted rows of `candidates(user_id long, ts, id long)`. A user's rows arrive sorted in Arrow batches; a silence
    of a whole window forgets the past, so stretches between silences are independent groups of their own."""
    w = minutes * MINUTE_US
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = candidates.select("user_id", t.alias("t"), "id")
    stretch = _stretches(rows, w)
    ordered = stretch.repartition("user_id", "stretch").sortWithinPartitions("user_id", "stretch", "t", "id")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sent = None, []
        for b in batches:
            keep = []
            for user, part, at in zip(b["user_id"], b["stretch"], b["t"]):
                if (user, part) != key:
                    key, sent = (user, part), []
                keep.append(accept(sent, int(at), cap, w))
            yield b.loc[keep, ["user_id", "t", "id"]]

    out = ordered.mapInPandas(scan, "user_id long, t long, id long")
    return out.select("user_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"), "id")


def _stretches(rows: DataFrame, w: int) -> DataFrame:
    """`rows` plus `stretch`, the number of the window-aligned run of busy slots the row falls into. Slots are counted,
    not rows, so the scan over a user's history has one row per slot."""
    from pyspark.sql import Window

    slotted = rows.withColumn("slot", F.floor(F.col("t") / w))
    slots = slotted.groupBy("user_id", "slot").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("user_id").orderBy("slot")
    # an empty slot between two busy ones is a silence of at least one window
    gap = F.when(F.col("slot") - F.lag("slot").over(order) > 1, 1).otherwise(0)
    runs = slots.withColumn("_gap", gap).withColumn("stretch", F.sum("_gap").over(order)).select("user_id", "slot", "stretch")
    return slotted.join(runs, ["user_id", "slot"])


class _Limiter(StatefulProcessor):
    def __init__(self, cap: int, window_us: int) -> None:
        self.cap, self.window_us = cap, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getValueState("sent", StructType([StructField("times", ArrayType(LongType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sent = list(self.sent.get()[0]) if self.sent.exists() else []
        # a key's rows of a micro-batch come in several chunks and in no order of time: three numbers a row are held
        batch = pd.concat([b[["user_id", "t", "id"]] for b in rows]).sort_values(["t", "id"])
        keep = [accept(sent, int(at), self.cap, self.window_us) for at in batch["t"]]
        yield batch[keep]
        self.sent.update((sent,))

    def close(self) -> None:
        return None


def limited_stream(stream: DataFrame, cap: int = K.MAX_PUSH_PER_HOUR, minutes: int = 60) -> DataFrame:
    """The streaming form: keyed state of the last sends. Needs the RocksDB state store."""
    rows = stream.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "id")
    return rows.groupBy("user_id").transformWithStateInPandas(
        _Limiter(cap, minutes * MINUTE_US), outputStructType="user_id long, t long, id long", outputMode="Append", timeMode="None"
    )
