"""Base and personal scores, the mute rule, the relevance gate, and push / channel / star eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import lit_strings
from storyloom.functions import scores as S


def cluster_sizes(items: DataFrame) -> DataFrame:
    """(cluster_id, cluster_size), counted with map-side combine so that one giant cluster costs one row per task."""
    return items.filter(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))


def cluster_key() -> Column:
    """Join key of the item's cluster. Items outside clusters get keys of their own that match nothing, so that NULL
    keys do not meet in one task; whatever the ids, no such key is that of a cluster."""
    return F.struct(F.col("cluster_id").isNull().alias("alone"), F.coalesce("cluster_id", "id").alias("key"))


def _keyed(clusters: DataFrame) -> DataFrame:
    """A table with a row per `cluster_id`, under the key that its items have."""
    key = F.struct(F.lit(False).alias("alone"), F.col("cluster_id").alias("key"))
    return clusters.select(key.alias("_key"), *[c for c in clusters.columns if c != "cluster_id"])


def with_cluster_size(items: DataFrame) -> DataFrame:
    """Size of the item's cluster, 1 outside clusters."""
    joined = items.withColumn("_key", cluster_key()).join(_keyed(cluster_sizes(items)), "_key", "left").drop("_key")
    return joined.withColumn("cluster_size", F.coalesce("cluster_size", F.lit(1).cast("long")))


def base_scored(items: DataFrame, as_of: Column) -> DataFrame:
    return with_cluster_size(items).withColumn(
        "base_score", S.base_score(F.col("published_at"), F.col("raw_score"), F.col("cluster_size"), as_of)
    )


def tag_component(items: DataFrame, affinity: DataFrame) -> DataFrame:
    """(id, tag_aff): mean weight of the item's tags that have a row in its area; items without one are absent.

    A popular tag may sit on a third of all items, so the join is on (vertical, tag) against the weight table only,
    which is as small as the tag vocabulary, and items are summed back by id."""
    tags = items.filter(F.col("vertical").isNotNull()).select("id", "vertical", F.explode(F.array_distinct("tags")).alias("tag"))
    return (
        tags.join(affinity.select("vertical", "tag", "weight"), ["vertical", "tag"])
        .groupBy("id")
        .agg(F.avg("weight").alias("tag_aff"))
    )


def source_key() -> Column:
    return F.coalesce(F.nullif("feed_name", F.lit("")), "author", F.lit(""))


def with_source_component(items: DataFrame, affinity: DataFrame) -> DataFrame:
    aff = affinity.select("vertical", "source_type", "source_key", F.col("weight").alias("source_aff"))
    return (
        items.withColumn("source_key", source_key())
        .join(aff, ["vertical", "source_type", "source_key"], "left")
        .withColumn("source_aff", S.zero(F.col("source_aff")))
        .drop("source_key")
    )


def with_taste_component(items: DataFrame, taste: DataFrame) -> DataFrame:
    """Cosine of the item and its area's taste vector; 0 without a vector or without likes."""
    mine = F.try_element_at(F.col("_taste"), F.col("vertical"))
    usable = (F.coalesce(mine["n_liked"], F.lit(0)) > 0) & F.col("vec").isNotNull()
    return (
        items.withColumn("_taste", by_area(taste, "n_liked", "vec"))
        .withColumn("taste_cos", F.when(usable, S.cosine(F.col("vec"), mine["vec"])).otherwise(0.0))
        .withColumn("n_liked", F.coalesce(mine["n_liked"], F.lit(0)))
        .drop("_taste")
    )


def by_area(table: DataFrame, *columns: str) -> Column:
    """The rows of a table with one row per topic area as one map, in a scalar subquery: the few areas are looked up in
    place, and items are not shuffled on a key of so few values."""
    entry = F.struct("vertical", F.struct(*columns).alias("row"))
    return table.filter(F.col("vertical").isNotNull()).groupBy().agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()


def muted_by(items: DataFrame, muted: DataFrame) -> DataFrame:
    """(id, muted_tag): the first of the item's tags, in item order, that its area mutes."""
    tags = items.filter(F.col("vertical").isNotNull()).select("id", "vertical", F.posexplode("tags").alias("pos", "tag"))
    return (
        tags.join(muted, ["vertical", "tag"])
        .groupBy("id")
        .agg(F.min_by("tag", "pos").alias("muted_tag"))
    )


def apply_mutes(items: DataFrame, muted: DataFrame) -> DataFrame:
    """Mute reason set on muted items; a mute reason that no longer holds is cleared, other reasons stay."""
    hit = items.join(muted_by(items, muted), "id", "left")
    own = F.coalesce(F.col("skip_reason").startswith(K.MUTE_PREFIX), F.lit(False))
    reason = (
        F.when(F.col("vertical").isNull(), F.col("skip_reason"))
        .when(F.col("muted_tag").isNotNull(), F.concat(F.lit(K.MUTE_PREFIX), "muted_tag"))
        .when(own, None)
        .otherwise(F.col("skip_reason"))
    )
    return hit.withColumn("skip_reason", reason)


def scored(
    items: DataFrame, tag_aff: DataFrame, source_aff: DataFrame, taste: DataFrame, muted: DataFrame, as_of: Column,
    no_boost=(), weights: dict = K.WEIGHTS, ramp: int = K.TASTE_RAMP, boost: float = K.WATCH_BOOST,
) -> DataFrame:
    """Personal score of every item with its components. NULL outside the topic areas and for muted items; items that
    match a boosting watch topic gain `boost`, but end at 1 at most."""
    base = with_taste_component(with_source_component(apply_mutes(items, muted), source_aff), taste)
    base = base.join(tag_component(items, tag_aff), "id", "left").withColumn("tag_aff", S.zero(F.col("tag_aff")))
    base = base.withColumn("fresh", S.freshness(F.col("published_at"), as_of))
    plain = S.personal_score(
        F.col("llm_relevance"), F.col("taste_cos"), F.col("tag_aff"), F.col("source_aff"), F.col("fresh"),
        F.col("n_liked"), ramp, weights,
    )
    boosting = F.col("watch_topics")
    if no_boost:
        boosting = F.array_except(boosting, lit_strings(no_boost))
    lifted = F.when(F.coalesce(F.size(boosting), F.lit(0)) > 0, F.least(F.lit(1.0), plain + boost)).otherwise(plain)
    eligible = F.col("vertical").isNotNull() & F.col("muted_tag").isNull()
    return base.withColumn("personal_score", F.when(eligible, lifted))


def nearest_profile(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """Items with `best_vertical` and `best_sim`: the profile with the highest cosine, the first area on a tie.

    There is one profile per area, so all of them travel as a single scalar-subquery array; no join is needed and the
    comparison is one projection over the items."""
    refs = (
        profiles.groupBy()
        .agg(F.sort_array(F.collect_list(F.struct("vertical", "vec"))).alias("refs"))
        .scalar()
    )
    best = F.array_max(
        F.transform(
            F.col("_refs"),
            lambda p, i: F.struct(
                S.cosine(F.col("vec"), p["vec"]).alias("sim"), (-i).alias("order"), p["vertical"].alias("vertical")
            ),
        )
    )
    with_best = items.withColumn("_refs", refs).withColumn("_best", F.when(F.col("vec").isNotNull(), best))
    return with_best.select(
        *items.columns, F.col("_best.vertical").alias("best_vertical"), F.col("_best.sim").alias("best_sim")
    )


def gated(items: DataFrame, profiles: DataFrame, min_sim: float = K.GATE_MIN_SIMILARITY, enabled: bool = True) -> DataFrame:
    """Relevance gate: `gate` is pass or skip, `gate_reason` explains a skip. Watch topics, hand-added items and items
    without a vector pass."""
    if not enabled:
        return items.withColumn("gate", F.lit("pass")).withColumn("gate_reason", F.lit(None).cast("string"))
    near = nearest_profile(items, profiles)
    exempt = (
        (F.coalesce(F.size("watch_topics"), F.lit(0)) > 0)
        | F.col("source_type").eqNullSafe("manual")
        | F.col("best_sim").isNull()
    )
    skip = ~exempt & (F.col("best_sim") < min_sim)
    return (
        near.withColumn("gate", F.when(skip, "skip").otherwise("pass"))
        .withColumn("gate_reason", F.when(skip, F.format_string(K.GATE_REASON, "best_sim", "best_vertical")))
    )


def in_quiet_hours(ts: Column, quiet: str = K.QUIET_HOURS) -> Column:
    """Whether the hour falls in a "start-end" range, which may wrap around midnight; equal ends mean never."""
    parts = quiet.split("-")
    if len(parts) != 2 or not all(p.strip().isdigit() for p in parts):
        return F.lit(False)
    a, b = (int(p) for p in parts)
    h = F.hour(ts)
    if a == b:
        return F.lit(False)
    return (h >= a) & (h < b) if a < b else (h >= a) | (h < b)


def sent_clusters(items: DataFrame, field: str) -> DataFrame:
    """Per cluster that was sent: (cluster_id, n_sent, sent_id). A cluster was sent before an item when it holds a sent
    member other than that item."""
    return (
        items.filter(F.col("cluster_id").isNotNull() & F.col(field).isNotNull())
        .groupBy("cluster_id")
        .agg(F.count("*").alias("n_sent"), F.min("id").alias("sent_id"))
    )


def with_cluster_sent(items: DataFrame, field: str) -> DataFrame:
    s = sent_clusters(items, field)
    joined = items.withColumn("_key", cluster_key()).join(_keyed(s), "_key", "left")
    other = (F.coalesce("n_sent", F.lit(0)) > 1) | ((F.col("n_sent") == 1) & (F.col("sent_id") != F.col("id")))
    return joined.withColumn("cluster_sent", F.coalesce(other, F.lit(False))).drop("_key", "n_sent", "sent_id")


def first_of_story(items: DataFrame, at: str = "processed_at") -> DataFrame:
    """Items are looked at as they are processed and marked when sent, so of the eligible members of one cluster only the
    first goes out. The leading row per cluster is kept on the map side."""
    w = Window.partitionBy(F.col("cluster_id").isNull(), F.coalesce("cluster_id", "id")).orderBy(F.col(at).asc_nulls_last(), "id")
    return items.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def push_candidates(
    items: DataFrame, scope=(), threshold: float = K.PUSH_THRESHOLD, tweet_threshold: float = K.TWEET_PUSH_THRESHOLD,
    quiet: str = K.QUIET_HOURS, at: str = "processed_at",
) -> DataFrame:
    """Items that may be pushed at time `at`, before the hourly cap."""
    limit = F.when(F.col("feed_name").startswith("tw_"), min(threshold, tweet_threshold)).otherwise(threshold)
    ok = (
        F.col("personal_score").isNotNull() & F.col("pushed_at").isNull() & (F.col("personal_score") >= limit)
        & ~in_quiet_hours(F.col(at), quiet)
    )
    if scope:
        ok = ok & F.coalesce("vertical", F.lit("")).isin(*scope)
    return first_of_story(with_cluster_sent(items, "pushed_at").filter(ok & ~F.col("cluster_sent")), at)


def channel_candidates(items: DataFrame, scope=(), min_score: float = K.CHANNEL_MIN_SCORE) -> DataFrame:
    ok = (
        F.col("personal_score").isNotNull() & F.col("channel_posted_at").isNull()
        & (F.col("source_type") != "manual") & (F.col("personal_score") >= min_score)
    )
    if scope:
        ok = ok & F.coalesce("vertical", F.lit("")).isin(*scope)
    return first_of_story(with_cluster_sent(items, "channel_posted_at").filter(ok & ~F.col("cluster_sent")))


def star_candidates(actions: DataFrame, items: DataFrame, vertical: str = K.STAR_VERTICAL) -> DataFrame:
    """Items to publish because someone saved them: a `save` was added, not posted yet, in the wanted area unless the
    item was added by hand."""
    saves = actions.filter("signal = 'save' and action = 'added'").select(F.col("item_id").alias("id")).distinct()
    fits = (F.col("source_type") == "manual") | (F.coalesce("vertical", F.lit("")) == vertical)
    return items.filter(F.col("star_posted_at").isNull() & (fits if vertical else F.lit(True))).join(saves, "id", "left_semi")


def to_judge(items: DataFrame, active: DataFrame) -> DataFrame:
    """Items a relevance judge must look at: in an area with a profile, and not yet scored against its version."""
    version = F.try_element_at(F.col("_active"), F.col("vertical"))["version"]
    known = items.withColumn("_active", by_area(active, "version")).withColumn("active_version", version).drop("_active")
    stale = F.col("llm_relevance").isNull() | ~F.col("scored_profile_version").eqNullSafe(F.col("active_version"))
    return known.filter(F.col("active_version").isNotNull() & stale)
