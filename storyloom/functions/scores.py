"""Scores as Column arithmetic: freshness, base score, personal score, trend strength, vector products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import clip
from storyloom.functions.text import seconds_between


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def freshness(published_at: Column, as_of: Column) -> Column:
    hours = F.coalesce(seconds_between(published_at, as_of) / 3600.0, F.lit(K.UNDATED_AGE_HOURS))
    return F.exp(-F.greatest(hours, F.lit(0.0)) / K.FRESHNESS_TAU_HOURS)


def base_score(published_at: Column, raw_score: Column, cluster_size: Column, as_of: Column) -> Column:
    size = F.greatest(F.coalesce(cluster_size, F.lit(1)), F.lit(1))
    return freshness(published_at, as_of) * (1 + zero(raw_score)) * (1 + F.log(size.cast("double")))


def personal_score(
    relevance: Column, taste_cos: Column, tag_aff: Column, source_aff: Column, fresh: Column, n_liked: Column,
    ramp: int = K.TASTE_RAMP, weights: dict = K.WEIGHTS,
) -> Column:
    share = F.least(F.lit(1.0), F.coalesce(n_liked, F.lit(0)) / float(ramp)) if ramp > 0 else F.lit(1.0)
    return (
        weights["llm"] * zero(relevance)
        + weights["taste"] * share * zero(taste_cos)
        + weights["tag"] * zero(tag_aff)
        + weights["source"] * zero(source_aff)
        + weights["fresh"] * zero(fresh)
    )


def growth(count: Column, prev: Column) -> Column:
    return F.when(prev > 0, (count - prev) / prev).otherwise(F.when(count > 0, 2.0).otherwise(0.0))


def strength(count: Column, prev: Column, avg_score: Column) -> Column:
    momentum = F.pow(clip(1.0 + growth(count, prev), 0.1, 4.0), F.lit(1.5))
    return F.pow(count.cast("double"), F.lit(0.6)) * momentum * (0.4 + 0.6 * zero(avg_score))


def direction(count: Column, prev: Column) -> Column:
    g = growth(count, prev)
    return F.when(g >= 0.25, "↑").when(g <= -0.25, "↓").otherwise("→")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when a side is missing or has no length."""
    length = norm(a) * norm(b)
    return F.when(F.coalesce(length, F.lit(0.0)) > 0, dot(a, b) / length).otherwise(0.0)
