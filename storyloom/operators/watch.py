"""Watch topics: which named topics an item's title and text touch."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WATCH_CHARS = 4000


def _quote(s: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", s)


def topic_pattern(aliases) -> str:
    """One pattern per topic: a single word matches from a word boundary on, a phrase with a blank or slash anywhere."""
    parts = []
    for a in aliases:
        a = a.lower().strip()
        parts.append(_quote(a) if (" " in a or "/" in a) else r"\b" + _quote(a))
    return "(?U)(?:" + "|".join(parts) + ")"


def match_topics(title: Column, text: Column, topics) -> Column:
    """Names of the matched topics, in topic order; `topics` is a list of (name, aliases)."""
    none = F.lit("")
    hay = F.lower(F.substring(F.concat(F.coalesce(title, none), F.lit(" "), F.coalesce(text, none)), 1, WATCH_CHARS))
    hits = [F.when(F.regexp_like(hay, F.lit(topic_pattern(al))), F.lit(name)) for name, al in topics if name and al]
    if not hits:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*hits))


def topic_counts(items: DataFrame, topics) -> DataFrame:
    rows = items.select(F.explode(match_topics(F.col("title"), F.col("text"), topics)).alias("topic"))
    return rows.groupBy("topic").agg(F.count("*").alias("n"))
