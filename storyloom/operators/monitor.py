"""Counts and boards for operation: totals, groups, health, queues, watch and skip boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.text import seconds_between, source_bucket


def _ago(as_of: Column, amount: int, unit: str) -> Column:
    return as_of - F.expr(f"INTERVAL {int(amount)} {unit}")


def totals(items: DataFrame, as_of: Column) -> DataFrame:
    p = F.col("processed_at")
    return items.agg(
        F.count_if(p.isNotNull() & F.col("vertical").isNotNull()).alias("processed"),
        F.count_if(p.isNull()).alias("pending"),
        F.count_if(F.col("pushed_at").isNotNull()).alias("pushed"),
        F.count_if(p > _ago(as_of, 60, "MINUTES")).alias("last_hour"),
        F.count_if(p > _ago(as_of, 10, "MINUTES")).alias("last_10m"),
        F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"),
    )


def group_counts(items: DataFrame, as_of: Column, top_feeds: int = 10, feeds: int = 30, skipped: int = 8) -> DataFrame:
    """(grouping, key, n) for all the panels: by area, by source bucket, busiest feeds of the last hour, processed per
    feed, skipped per source and per watch topic. Every row of the table is read once and expanded to the groups it
    belongs to; the counting combines on the map side."""
    p = F.col("processed_at")
    done = p.isNotNull()
    in_area = F.col("vertical").isNotNull()

    def member(name: str, cond: Column, key: Column) -> Column:
        return F.when(cond & key.isNotNull(), F.struct(F.lit(name).alias("grouping"), key.alias("key")))

    rows = F.array(
        member("vertical", in_area, F.col("vertical")),
        member("source", done & in_area, source_bucket(F.col("source_type"), F.col("feed_name"))),
        member("feed_last_hour", p > _ago(as_of, 60, "MINUTES"), F.col("feed_name")),
        member("feed", done, F.col("feed_name")),
        member("skipped", F.col("skip_reason").isNotNull(), F.coalesce("feed_name", "source_type")),
    )
    watch = F.transform(
        F.when(done, F.col("watch_topics")), lambda t: F.struct(F.lit("watch").alias("grouping"), t.alias("key"))
    )
    expanded = items.select(
        F.explode(F.concat(F.array_compact(rows), F.coalesce(watch, F.array().cast("array<struct<grouping:string,key:string>>")))).alias("m")
    )
    counts = expanded.groupBy("m.grouping", "m.key").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("grouping").orderBy(F.desc("n"), "key"))
    cap = (
        F.when(F.col("grouping") == "feed_last_hour", top_feeds)
        .when(F.col("grouping") == "feed", feeds)
        .when(F.col("grouping") == "skipped", skipped)
    )
    return counts.withColumn("rank", rank).filter(cap.isNull() | (F.col("rank") <= cap)).select("grouping", "key", "n")


def health(items: DataFrame, as_of: Column, hours: int = K.STALL_HOURS, min_pending: int = K.STALL_MIN_PENDING) -> DataFrame:
    p = F.col("processed_at")
    return items.agg(
        F.count_if(p > _ago(as_of, hours, "HOURS")).alias("done"), F.count_if(p.isNull()).alias("pending")
    ).withColumn("stalled", (F.col("done") == 0) & (F.col("pending") >= min_pending))


def silent_sources(items: DataFrame, prefixes, as_of: Column, hours: int = K.SILENCE_HOURS) -> DataFrame:
    """(prefix, recent, silent) for feed-name prefixes: nothing fetched in the last hours means silence."""
    fresh = F.col("fetched_at") > _ago(as_of, hours, "HOURS")
    aggs = [F.count_if(fresh & F.col("feed_name").startswith(p)).alias(f"c{i}") for i, p in enumerate(prefixes)]
    pairs = F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"c{i}").alias("recent")) for i, p in enumerate(prefixes)])
    return items.agg(*aggs).select(F.inline(pairs)).withColumn("silent", F.col("recent") == 0)


def silence_episodes(rows: DataFrame, until: Column, hours: int = K.SILENCE_HOURS) -> DataFrame:
    """(key, kind, since, at): what is to be reported of `rows(key, ts)` by the time `until`: `silent` when a source has sent nothing for
    `hours` since `since`, `recovered` when it sends again. Only the first and last arrival of an hour
    leave a map task, so a source with a third of the log is a few rows."""
    per_hour = rows.filter("key is not null").groupBy("key", F.date_trunc("HOUR", F.col("ts").cast("timestamp")).alias("h")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    order = Window.partitionBy("key").orderBy("h")
    span = F.expr(f"INTERVAL {int(hours)} HOURS")
    gaps = per_hour.select("key", F.col("last").alias("since"), F.lead("first").over(order).alias("again"))
    quiet = gaps.filter((F.coalesce("again", until) >= F.col("since") + span) & ((F.col("since") + span) <= until))
    both = F.array(
        F.struct(F.lit("silent").alias("kind"), "since", (F.col("since") + span).alias("at")),
        F.struct(F.lit("recovered").alias("kind"), "since", F.col("again").alias("at")))
    return quiet.select("key", F.inline(both)).filter("at is not null")


def pushed_since(items: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    return items.agg(F.count_if(F.col("pushed_at") >= _ago(as_of, minutes, "MINUTES")).alias("n"))


def learned_board(affinity: DataFrame, limit: int = 24) -> DataFrame:
    return (
        affinity.filter("n_pos > 0 or n_neg > 0")
        .orderBy(F.desc("weight"), "vertical", "tag")
        .limit(limit)
    )


def watch_board(items: DataFrame, as_of: Column, per_topic: int = 6) -> DataFrame:
    """(topic, n, rank, id, ...): count and newest items of each watch topic."""
    rows = items.filter("processed_at is not null").select(
        "id", "fetched_at", "vertical", "personal_score",
        source_bucket(F.col("source_type"), F.col("feed_name")).alias("bucket"),
        seconds_between(F.col("sort_ts"), as_of).alias("age_s"),
        F.explode("watch_topics").alias("topic"),
    )
    newest = Window.partitionBy("topic").orderBy(F.desc("fetched_at"), F.desc("id"))
    top = rows.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= per_topic)
    counts = rows.groupBy("topic").agg(F.count("*").alias("n"))
    return top.join(counts, "topic").drop("fetched_at")


def queue(items: DataFrame, as_of: Column, limit: int = 40) -> DataFrame:
    """Items that wait for processing, oldest first."""
    return (
        items.filter("processed_at is null")
        .orderBy("fetched_at", "id")
        .limit(limit)
        .select(
            "id", "title", source_bucket(F.col("source_type"), F.col("feed_name")).alias("bucket"), "feed_name",
            seconds_between(F.col("sort_ts"), as_of).alias("age_s"),
            seconds_between(F.col("fetched_at"), as_of).alias("lag_s"),
        )
    )


def skipped(items: DataFrame, as_of: Column, limit: int = 60) -> DataFrame:
    """What the gate and the mutes removed, newest first."""
    return (
        items.filter("skip_reason is not null")
        .orderBy(F.col("processed_at").desc_nulls_last(), F.desc("id"))
        .limit(limit)
        .select(
            "id", "title", source_bucket(F.col("source_type"), F.col("feed_name")).alias("bucket"), "feed_name",
            "skip_reason", seconds_between(F.col("sort_ts"), as_of).alias("age_s"),
        )
    )


def hourly_activity(items: DataFrame, as_of: Column, start: str) -> DataFrame:
    """(hour, fetched, processed) for every hour from `start` to `as_of`, empty hours included."""
    hours = items.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), as_of, F.expr("INTERVAL 1 HOUR"))).alias("hour")
    )
    seen = items.select(
        F.inline(
            F.array(
                F.struct(F.date_trunc("HOUR", "fetched_at").cast("timestamp_ntz").alias("hour"), F.lit(1).alias("f"), F.lit(0).alias("p")),
                F.struct(F.date_trunc("HOUR", "processed_at").cast("timestamp_ntz").alias("hour"), F.lit(0).alias("f"), F.lit(1).alias("p")),
            )
        )
    ).filter("hour is not null")
    counts = seen.groupBy("hour").agg(F.sum("f").alias("fetched"), F.sum("p").alias("processed"))
    return hours.join(counts, "hour", "left").na.fill(0, ["fetched", "processed"])


def stall_episodes(
    items: DataFrame, as_of: Column, start: str, hours: int = K.STALL_HOURS, min_pending: int = K.STALL_MIN_PENDING
) -> DataFrame:
    """(kind, hour, done, pending): one `stalled` per stall, at the first hour at which the last `hours` processed nothing while
    `min_pending` items waited, and `recovered` at the hour that processed something again. The hourly table has one row per hour of
    history, not per item."""
    timeline = Window.orderBy("hour")
    h = hourly_activity(items, as_of, start)
    h = h.withColumn("done", F.sum("processed").over(timeline.rowsBetween(-(hours - 1), 0))).withColumn(
        "pending", F.sum(F.col("fetched") - F.col("processed")).over(timeline.rowsBetween(Window.unboundedPreceding, 0))
    )
    # a stall stays raised until something is processed again
    episode = F.sum((F.col("done") > 0).cast("int")).over(timeline.rowsBetween(Window.unboundedPreceding, 0))
    h = h.withColumn("episode", episode).withColumn("stalled", (F.col("done") == 0) & (F.col("pending") >= min_pending))
    first = Window.partitionBy("episode", "stalled").orderBy("hour")
    own = h.withColumn("_rn", F.row_number().over(first))
    raised = own.filter("stalled and _rn = 1")
    ended = h.join(raised.select((F.col("episode") + 1).alias("episode")), "episode").filter("done > 0")
    return raised.select(F.lit("stalled").alias("kind"), "hour", "done", "pending").unionByName(
        ended.select(F.lit("recovered").alias("kind"), "hour", "done", "pending"))


def stall_alerts(
    items: DataFrame, as_of: Column, start: str, hours: int = K.STALL_HOURS, min_pending: int = K.STALL_MIN_PENDING
) -> DataFrame:
    """(hour, done, pending) of the alerts."""
    return stall_episodes(items, as_of, start, hours, min_pending).filter("kind = 'stalled'").drop("kind")
