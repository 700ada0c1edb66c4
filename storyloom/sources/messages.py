"""JSON message lines to items, with malformed lines set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import constants as K

MESSAGE_SCHEMA = (
    "source_id string, url string, title string, text string, media array<string>, author string, category string, "
    "published_at string"
)


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """`lines` plus `m` (the message struct) and `ok`. A line is malformed when it is no JSON object, has no source id
    or an unreadable time; blank lines are dropped."""
    m = F.from_json(F.col(column), MESSAGE_SCHEMA + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    df = lines.filter(F.trim(column) != "").withColumn("m", m)
    time_ok = F.col("m.published_at").isNull() | F.col("m.published_at").try_cast("timestamp").isNotNull()
    ok = F.col("m").isNotNull() & F.col("m._corrupt").isNull() & F.col("m.source_id").isNotNull() & time_ok
    return df.withColumn("ok", F.coalesce(ok, F.lit(False)))


def category_of(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in K.MESSAGE_CATEGORIES.items() for x in kv])
    return F.coalesce(F.element_at(known, c), c)


def items(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Items of the well-formed messages; the channel is the feed. `keep` names columns of the lines to carry along."""
    m = messages.filter("ok").select("m.*", *keep)
    return m.select(
        F.lit("telegram").alias("source_type"), "source_id", "url", "title",
        F.nullif("text", F.lit("")).alias("text"),
        F.coalesce("media", F.array().cast("array<string>")).alias("media"),
        "author", F.col("author").alias("feed_name"), F.lit(None).cast("double").alias("raw_score"),
        category_of(F.col("category")).alias("category"),
        F.col("published_at").try_cast("timestamp").alias("published_at"),
        *keep,
    )


def malformed(messages: DataFrame, column: str = "value") -> DataFrame:
    return messages.filter("not ok").select(column)
