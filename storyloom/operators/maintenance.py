"""Queues of work to redo: stale vectors, retries, titles, summaries, short texts, muted items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.text import CYRILLIC, detect_lang


def stale_vectors(items: DataFrame, model: str, version: int, limit: int | None = None) -> DataFrame:
    """Processed items whose vector does not fit the text or the current model, newest ids first. A NULL model alone is
    not stale: the comparison stays three-valued."""
    v = F.col("embedding_version")
    stale = items.filter(
        F.col("processed_at").isNotNull() & (v.isNull() | (v < version) | (F.col("embedding_model") != model))
    ).select("id").orderBy(F.desc("id"))
    return stale.limit(limit) if limit else stale


def rewrite_texts(items: DataFrame, texts: DataFrame) -> DataFrame:
    """New texts put in place; a changed text marks the vector as stale."""
    joined = items.join(texts.select("id", F.col("text").alias("_new")), "id", "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("text"))
    return (
        joined.withColumn("embedding_version", F.when(~changed, F.col("embedding_version")))
        .withColumn("text", F.coalesce("_new", "text"))
        .drop("_new")
    )


def retry_backlog(items: DataFrame, as_of: Column) -> DataFrame:
    """(id, line, retry_after) of waiting items to send again: the normal line takes fresh failures, newest first; the
    recovery line takes exhausted ones that had a pause, oldest first. Selected items rest for half an hour."""

    def ago(minutes: int) -> Column:
        return as_of - F.expr(f"INTERVAL {minutes} MINUTES")

    waiting = items.filter(F.col("processed_at").isNull() & (F.col("fetched_at") < ago(K.STALE_MINUTES)))
    due = F.col("retry_after")
    normal = (
        waiting.filter((F.col("attempts") < K.MAX_ATTEMPTS) & (due.isNull() | (due < as_of)))
        .select("id", F.lit("normal").alias("line")).orderBy(F.desc("id")).limit(K.NORMAL_BATCH)
    )
    recovery = (
        waiting.filter(
            (F.col("attempts") >= K.MAX_ATTEMPTS) & (F.col("attempts") < K.RECOVERY_CAP)
            & (due.isNull() | (due < ago(K.RECOVERY_QUIET_MINUTES)))
        )
        .select("id", F.lit("recovery").alias("line")).orderBy("id").limit(K.RECOVERY_BATCH)
    )
    pause = as_of + F.expr(f"INTERVAL {K.REPUBLISH_PAUSE_MINUTES} MINUTES")
    return normal.unionByName(recovery).withColumn("retry_after", pause)


def failed(items: DataFrame, as_of: Column) -> DataFrame:
    """The state after one more failure: attempts counted up, next try after min(2^attempts, 60) minutes."""
    wait = F.least(F.pow(F.lit(2.0), F.col("attempts")), F.lit(60.0)).cast("int")
    return items.select(
        "id", (F.col("attempts") + 1).alias("attempts"),
        (as_of + F.make_dt_interval(F.lit(0), F.lit(0), wait)).alias("retry_after"),
        F.least(F.pow(F.lit(2.0), F.greatest(F.col("attempts"), F.lit(1))) * 30, F.lit(3600.0)).cast("long").alias("redelivery_s"),
    )


def language_mismatch(items: DataFrame) -> DataFrame:
    """Items with a Cyrillic text and a Latin summary."""
    cyr = F.lit(CYRILLIC)
    return items.filter(
        F.col("summary").isNotNull() & (F.trim("summary") != "")
        & (F.regexp_count("text", cyr) > 40) & (F.regexp_count("summary", cyr) < 5)
        & (detect_lang(F.col("text")) == "ru") & (detect_lang(F.col("summary")) == "en")
    )


def short_repo_texts(items: DataFrame, as_of: Column, days: int = 60, limit: int = 500, max_chars: int = 400) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    return (
        items.filter(
            F.col("feed_name").startswith("gh_") & F.contains("url", F.lit("github.com/")) & (n < max_chars)
            & (F.col("fetched_at") > as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
        )
        .orderBy(F.desc("fetched_at"), F.desc("id"))
        .limit(limit)
        .select("id", "url", n.alias("n_chars"))
    )


def missing_titles(items: DataFrame, mode: str = "empty") -> DataFrame:
    """Processed items that need a title: `empty`, `regen` (also sources that never give one) or `fallbacks`."""
    empty = F.col("title").isNull() | (F.trim("title") == "")
    untitled_source = F.col("source_type").eqNullSafe("telegram") | F.coalesce(F.col("feed_name").startswith("tw_"), F.lit(False))
    cond = {
        "regen": empty | untitled_source,
        "fallbacks": F.col("title").startswith(K.TITLE_FALLBACK_PREFIX + "@"),
    }.get(mode, empty)
    return items.filter("processed_at is not null").filter(cond)


def mute_victims(items: DataFrame) -> DataFrame:
    """Scored once, now without a score, and not for the gate's reasons: candidates to revive when a mute is lifted."""
    own = F.col("skip_reason").isNull() | F.col("skip_reason").startswith(K.MUTE_PREFIX)
    return items.filter(
        "processed_at is not null and personal_score is null and vertical is not null and llm_relevance is not null"
    ).filter(own)
