"""The reaction log: toggles, current marks, learned affinities, taste, mutes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.operators.ordered import decayed_sum, running_sum
from storyloom.operators.vector_sums import vector_sums

MARK_KEY = ["item_id", "signal", "topic"]
LEARNABLE = ("up", "down", "save")
LIKES = ("up", "save")


def with_actions(events: DataFrame) -> DataFrame:
    """Each click with `nth` (its number among the clicks on the same item, signal and topic; NULL topics are equal)
    and `action`: odd clicks add a mark, even ones take it away."""
    n = running_sum(events, MARK_KEY, ["ts", "event_id"], F.lit(1), "nth")
    return n.withColumn("action", F.when(F.col("nth") % 2 == 1, "added").otherwise("removed"))


def current_marks(events: DataFrame) -> DataFrame:
    """(item_id, signal, topic, marked_at) of the marks that stand: keys clicked an odd number of times."""
    return (
        events.groupBy(*MARK_KEY)
        .agg(F.count("*").alias("clicks"), F.max("ts").alias("marked_at"))
        .filter(F.col("clicks") % 2 == 1)
        .drop("clicks")
    )


def counts_by_signal(marks: DataFrame) -> DataFrame:
    return marks.groupBy("signal").agg(F.count("*").alias("n"))


def precision(marks: DataFrame) -> DataFrame:
    up = F.count_if(F.col("signal").isin(*LIKES))
    down = F.count_if(F.col("signal") == "down")
    return marks.agg(
        up.alias("up"),
        down.alias("down"),
        F.count_if(F.col("signal") == "mute_topic").alias("muted"),
        F.when(up + down > 0, up / (up + down)).alias("precision"),
    )


def per_item(marks: DataFrame, signals=LIKES) -> DataFrame:
    """One row per marked item: last mark time and the distinct signals in order. Collapsing before any join keeps the
    item from being multiplied by its marks."""
    return (
        marks.filter(F.col("signal").isin(*signals))
        .groupBy("item_id")
        .agg(F.max("marked_at").alias("marked_at"), F.sort_array(F.collect_set("signal")).alias("signals"))
    )


def learning_steps(events: DataFrame, items: DataFrame) -> DataFrame:
    """Learnable clicks with direction (+1 / -1, flipped when the mark is taken away) and their item's facts."""
    sign = F.when(F.col("signal").isin(*LIKES), 1).otherwise(-1)
    steps = with_actions(events.filter(F.col("signal").isin(*LEARNABLE))).select(
        "event_id", "ts", "item_id", "signal", "action",
        F.when(F.col("action") == "added", sign).otherwise(-sign).alias("direction"),
    )
    facts = items.filter(F.col("vertical").isNotNull()).select(
        F.col("id").alias("item_id"), "vertical", "tags", "source_type",
        F.coalesce(F.nullif("feed_name", F.lit("")), "author", F.lit("")).alias("source_key"),
    )
    return steps.join(facts, "item_id")


def _seeded(learned: DataFrame, keys: list[str], seeds: DataFrame | None, rate: float) -> DataFrame:
    if seeds is None:
        return learned.select(*keys, F.col("w").alias("weight"), "n_pos", "n_neg")
    both = learned.join(seeds.select(*keys, F.col("weight").alias("seed")), keys, "full_outer")
    n = F.coalesce("n", F.lit(0))
    w = F.coalesce("seed", F.lit(0.0)) * F.pow(F.lit(1.0 - rate), n) + F.coalesce("w", F.lit(0.0))
    return both.select(
        *keys, w.alias("weight"), F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("n_neg", F.lit(0)).alias("n_neg")
    )


def tag_affinity(steps: DataFrame, seeds: DataFrame | None = None, rate: float = K.LEARNING_RATE) -> DataFrame:
    """(vertical, tag, weight, n_pos, n_neg): exponential average of the directions of all clicks on the tag."""
    rows = steps.withColumn("tag", F.explode("tags"))
    keys = ["vertical", "tag"]
    return _seeded(decayed_sum(rows, keys, ["ts", "event_id"], F.col("direction"), rate), keys, seeds, rate)


def source_affinity(steps: DataFrame, rate: float = K.LEARNING_RATE) -> DataFrame:
    keys = ["vertical", "source_type", "source_key"]
    return _seeded(decayed_sum(steps, keys, ["ts", "event_id"], F.col("direction"), rate), keys, None, rate)


def taste(marks: DataFrame, items: DataFrame, vectors: DataFrame) -> DataFrame:
    """(vertical, n_liked, vec): mean vector of the standing likes. A like that was taken away cancels exactly, so the
    running mean over the whole log equals the mean over the marks that stand."""
    likes = marks.filter(F.col("signal").isin(*LIKES)).groupBy("item_id").agg(F.count("*").alias("times"))
    areas = items.filter(F.col("vertical").isNotNull()).select(F.col("id").alias("item_id"), "vertical")
    liked = likes.join(areas, "item_id").join(vectors.select(F.col("id").alias("item_id"), "vec"), "item_id")
    sums = vector_sums(liked, ["vertical"], "vec", "times")
    return sums.select("vertical", F.col("n").alias("n_liked"), F.transform("total", lambda x: x / F.col("n")).alias("vec"))


def learned_mutes(events: DataFrame, items: DataFrame) -> DataFrame:
    """(vertical, tag) muted by button: the last mute click of the topic in that area added a mark."""
    mutes = with_actions(events.filter((F.col("signal") == "mute_topic") & F.col("topic").isNotNull()))
    areas = items.filter(F.col("vertical").isNotNull()).select(F.col("id").alias("item_id"), "vertical")
    return (
        mutes.join(areas, "item_id")
        .groupBy("vertical", F.col("topic").alias("tag"))
        .agg(F.max_by("action", F.struct("ts", "event_id")).alias("last_action"))
        .filter(F.col("last_action") == "added")
        .drop("last_action")
    )


def refine_triggers(events: DataFrame, items: DataFrame, every: int = K.REFINE_EVERY) -> DataFrame:
    """Clicks that bring the standing learnable marks of an area to a multiple of `every`."""
    steps = learning_steps(events, items).withColumn("delta", F.when(F.col("action") == "added", 1).otherwise(-1))
    n = running_sum(
        steps.select("event_id", "ts", "item_id", "vertical", "action", "delta"),
        ["vertical"], ["ts", "event_id"], F.col("delta"), "standing",
    )
    return n.filter((F.col("action") == "added") & (F.col("standing") > 0) & (F.col("standing") % every == 0)).select(
        "event_id", "vertical", "item_id", "standing"
    )


def learnable_counts(marks: DataFrame, items: DataFrame) -> DataFrame:
    rows = marks.filter(F.col("signal").isin(*LEARNABLE)).groupBy("item_id").agg(F.count("*").alias("n"))
    return (
        rows.join(items.select(F.col("id").alias("item_id"), "vertical"), "item_id")
        .filter(F.col("vertical").isNotNull())
        .groupBy("vertical")
        .agg(F.sum("n").alias("n"))
    )


def recent_reactions(marks: DataFrame, items: DataFrame, vertical: str, limit: int = 14) -> DataFrame:
    """The newest learnable marks of an area, split into liked and disliked."""
    rows = marks.filter(F.col("signal").isin(*LEARNABLE)).join(
        items.filter(F.col("vertical") == vertical).select(F.col("id").alias("item_id"), "title", "tags"), "item_id"
    )
    newest = rows.orderBy(F.desc("marked_at"), F.desc("item_id"), "signal").limit(limit)
    return newest.withColumn("liked", F.col("signal").isin(*LIKES))


SKETCH_BITS = 12  # registers of a sketch as a power of two: a standard error of 1.04 / sqrt(4096)
SKETCH_ERROR = 0.01625


def daily_sketches(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """(day, sketch): a sketch of the distinct values of `key` per day, a few kilobytes however many there are. Sketches of days merge
    into those of any window without the events."""
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.hll_sketch_agg(key, F.lit(SKETCH_BITS)).alias("sketch"))


def distinct_in(sketches: DataFrame, last: Column, days: int) -> DataFrame:
    """(days, estimate) for the `days` days that end with `last`."""
    window = sketches.filter((F.col("day") <= last) & (F.col("day") > F.date_sub(last, days)))
    merged = window.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    return merged.select(F.lit(days).alias("days"), F.coalesce("estimate", F.lit(0)).alias("estimate"))
