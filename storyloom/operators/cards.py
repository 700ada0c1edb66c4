"""Published cards: drop fragments that their source does not support, and the evaluation set of saved items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.grounding import SOURCE_COLUMNS, card_of, with_reject_reason, with_source_facts
from storyloom.functions.text import card_mode
from storyloom.session import spread


def fragments(cards: DataFrame) -> DataFrame:
    """`cards(id, line, points, ...)` as one row per headline and point: (id, kind, pos, fragment, ...)."""
    parts = F.concat(
        F.array(F.struct(F.lit("line").alias("kind"), F.lit(0).alias("pos"), F.col("line").alias("fragment"))),
        F.transform("points", lambda p, i: F.struct(F.lit("point").alias("kind"), (i + 1).alias("pos"), p.alias("fragment"))),
    )
    rest = [c for c in cards.columns if c not in ("line", "points")]
    return cards.select(*rest, F.inline(parts)).filter("fragment is not null")


def grounded(cards: DataFrame) -> DataFrame:
    """(id, mode, line, points, dropped): unsupported or foreign-script fragments removed one by one. A card that loses
    its headline is bare. A card has at most four fragments, so its groups are tiny."""
    known = with_source_facts(spread(cards), "source").withColumn("mode", card_mode(F.col("source"))).drop("source")
    f = with_reject_reason(fragments(known), "fragment", "why").drop(*SOURCE_COLUMNS)
    note = F.concat(F.col("kind"), F.lit(": "), F.col("why"))

    def ordered(cond, value):
        return F.transform(
            F.sort_array(F.collect_list(F.when(cond, F.struct("pos", value.alias("v"))))), lambda s: s["v"]
        )

    kept = f.groupBy("id").agg(
        F.max(F.when((F.col("kind") == "line") & F.col("why").isNull(), F.col("fragment"))).alias("line"),
        ordered((F.col("kind") == "point") & F.col("why").isNull(), F.col("fragment")).alias("points"),
        ordered(F.col("why").isNotNull(), note).alias("dropped"),
    )
    empty = F.array().cast("array<string>")
    has_line = F.col("line").isNotNull()
    return (
        cards.select("id", card_mode(F.col("source")).alias("mode"))
        .join(kept, "id", "left")
        .select(
            "id",
            F.when(has_line, F.col("mode")).otherwise("bare").alias("mode"),
            "line",
            F.when(has_line, F.col("points")).otherwise(empty).alias("points"),
            F.coalesce("dropped", empty).alias("dropped"),
        )
    )


def parsed_cards(answers: DataFrame) -> DataFrame:
    """`answers(id, answer, source)` from a model → `cards(id, line, points, source)`."""
    return answers.select("id", card_of(F.col("answer")).alias("c"), "source").select("id", "c.line", "c.points", "source")


def evaluation_set(marks: DataFrame, items: DataFrame, vertical: str, n: int | None = 12) -> DataFrame:
    """The newest saves of an area with the card mode their text allows."""
    saves = marks.filter("signal = 'save'").select(F.col("item_id").alias("id"), "marked_at")
    rows = items.filter(F.col("vertical") == vertical).select(
        "id", "feed_name", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), card_mode(F.col("text")).alias("mode")
    )
    picked = saves.join(rows, "id").orderBy(F.desc("marked_at"), F.desc("id"))
    return picked.limit(n) if n else picked


def mode_counts(evaluation: DataFrame) -> DataFrame:
    return evaluation.groupBy("mode").agg(F.count("*").alias("n"))
