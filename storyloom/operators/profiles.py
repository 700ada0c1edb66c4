"""Declared interests: active version, difference to the edited declaration, and applying it to learned weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom import constants as K


def active_profiles(profiles: DataFrame) -> DataFrame:
    newest = Window.partitionBy("vertical").orderBy(F.desc("version"))
    return profiles.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def topics_of(profiles: DataFrame) -> DataFrame:
    return profiles.select("vertical", F.explode("topics").alias("t")).select(
        "vertical", F.col("t.name").alias("tag"), F.coalesce("t.polarity", F.lit("like")).alias("polarity")
    ).filter(F.col("tag").isNotNull() & (F.col("tag") != ""))


def polarity_weight(p: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in K.POLARITY_WEIGHT.items() for x in kv])
    return F.coalesce(F.element_at(pairs, p), F.lit(0.0))


def topic_changes(applied: DataFrame, declared: DataFrame) -> DataFrame:
    """(vertical, tag, old_polarity, new_polarity, change): added, removed, changed or same."""
    old = topics_of(applied).withColumnRenamed("polarity", "old_polarity")
    new = topics_of(declared).withColumnRenamed("polarity", "new_polarity")
    change = (
        F.when(F.col("old_polarity").isNull(), "added")
        .when(F.col("new_polarity").isNull(), "removed")
        .when(F.col("old_polarity") != F.col("new_polarity"), "changed")
        .otherwise("same")
    )
    return old.join(new, ["vertical", "tag"], "full_outer").withColumn("change", change)


def declaration_diff(applied: DataFrame, declared: DataFrame) -> DataFrame:
    """What an edit would change: (vertical, kind, tag, old_polarity, new_polarity); descriptions compare with
    whitespace collapsed."""
    topics = topic_changes(applied, declared).filter("change <> 'same'").select(
        "vertical", F.col("change").alias("kind"), "tag", "old_polarity", "new_polarity"
    )

    def squeezed(c: str) -> Column:
        return F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))

    none = F.lit(None).cast("string")
    texts = (
        applied.select("vertical", F.col("description").alias("d_old"))
        .join(declared.select("vertical", F.col("description").alias("d_new")), "vertical")
        .filter(squeezed("d_old") != squeezed("d_new"))
        .select("vertical", F.lit("description").alias("kind"), none.alias("tag"), none.alias("old_polarity"), none.alias("new_polarity"))
    )
    return topics.unionByName(texts)


def apply_profile(affinity: DataFrame, applied: DataFrame, declared: DataFrame) -> DataFrame:
    """Tag weights after a declaration is applied: an unchanged topic keeps what was learned (and is seeded when it has
    no row), a new or changed one is set to its polarity weight, and rows that nothing was learned for and nobody
    declares any more are swept."""
    change = topic_changes(applied, declared).filter("new_polarity is not null")
    both = affinity.join(change, ["vertical", "tag"], "full_outer")
    seed = polarity_weight(F.col("new_polarity"))
    weight = (
        F.when(F.col("change").isNull(), F.col("weight"))
        .when(F.col("change") == "same", F.coalesce("weight", seed))
        .otherwise(seed)
    )
    n_pos, n_neg = F.coalesce("n_pos", F.lit(0)), F.coalesce("n_neg", F.lit(0))
    orphan = F.col("change").isNull() & (n_pos == 0) & (n_neg == 0)
    return both.filter(~orphan).select(
        "vertical", "tag", weight.alias("weight"), n_pos.alias("n_pos"), n_neg.alias("n_neg")
    )


def next_versions(profiles: DataFrame, declared: DataFrame) -> DataFrame:
    """The profile table after applying: old rows inactive, one new active version per declared area."""
    top = profiles.groupBy("vertical").agg(F.max("version").alias("v"))
    fresh = declared.join(top, "vertical", "left").select(
        "vertical", (F.coalesce("v", F.lit(0)) + 1).alias("version"), "description", "topics", F.lit(True).alias("active")
    )
    newest = active_profiles(profiles).select("vertical", "version").withColumn("_current", F.lit(True))
    old = (
        profiles.join(newest, ["vertical", "version"], "left")
        .join(declared.select("vertical", F.lit(True).alias("_replaced")), "vertical", "left")
        .select(
            "vertical", "version", "description", "topics",
            (F.col("_current").isNotNull() & F.col("_replaced").isNull()).alias("active"),
        )
    )
    return old.unionByName(fresh)


def by_polarity(profiles: DataFrame) -> DataFrame:
    """One row per area with the topic names of each polarity in columns."""
    rows = topics_of(profiles).groupBy("vertical").pivot("polarity", list(K.POLARITY_WEIGHT)).agg(
        F.array_join(F.sort_array(F.collect_list("tag")), ",")
    )
    return rows.select("vertical", *[F.coalesce(F.col(p), F.lit("")).alias(p) for p in K.POLARITY_WEIGHT])


def muted_tags(applied: DataFrame, learned: DataFrame) -> DataFrame:
    """Declared mutes and learned mutes, each pair once."""
    declared = topics_of(applied).filter("polarity = 'mute'").select("vertical", "tag")
    return declared.unionByName(learned.select("vertical", "tag")).distinct()


def orphan_weights(affinity: DataFrame, declared: DataFrame) -> DataFrame:
    """Untouched weights of topics that are no longer declared."""
    return affinity.filter("n_pos = 0 and n_neg = 0").join(
        topics_of(declared).select("vertical", "tag"), ["vertical", "tag"], "left_anti"
    )


def profile_seeds(profiles: DataFrame) -> DataFrame:
    return topics_of(profiles).select("vertical", "tag", polarity_weight(F.col("polarity")).alias("weight"))
