"""Linked knowledge tables grown from saved items: pages, dated mentions, source pages, lint, and page search.

A page's mentions stay rows of their own table. A concept that a third of all saved items mention is therefore many
rows with one key, never one huge value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import blank_to_null
from storyloom.functions.text import slugify, strip_html, tokens
from storyloom.session import materialize

PAGE_HEAD = "## Упоминания"


def source_ref() -> Column:
    return F.concat(
        F.lit("sources/"), F.col("id").cast("string"), F.lit("-"), slugify(F.coalesce(F.nullif("title", F.lit("")), F.lit("source")))
    )


def source_pages(items: DataFrame, *more: Column) -> DataFrame:
    """(id, source_ref, title, feed, tags, url, body), and `more`: one page per saved item."""
    body = F.coalesce(F.nullif("summary", F.lit("")), strip_html(F.col("text")), F.lit(""))
    return items.select(
        "id",
        source_ref().alias("source_ref"),
        F.coalesce(F.nullif("title", F.lit("")), F.lit(K.UNTITLED)).alias("title"),
        F.coalesce(F.nullif("feed_name", F.lit("")), F.nullif("source_type", F.lit("")), F.lit("—")).alias("feed"),
        F.array_join(F.transform(F.slice("tags", 1, 6), lambda t: F.concat(F.lit("#"), t)), " ").alias("tags"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.trim(body).alias("body"),
        *more,
    )


def source_bodies(items: DataFrame, date: Column) -> DataFrame:
    """(kind, slug, title, note, mentions, piece): the pages of the saved items themselves, one piece each. Mentions are
    dated bullets in the text, which a source has only if its own text holds some."""
    p = source_pages(items, date.alias("date"))
    head = F.concat(F.lit("# "), "title", F.lit("\n\n" + K.WIKI_SAVED), "date", F.lit(K.WIKI_FROM), "feed", F.lit("\n"))
    link = F.when(F.col("url") != "", F.concat(F.lit("- "), "url")).otherwise("")
    tags = F.when(F.col("tags") != "", F.concat("tags", F.lit("\n"))).otherwise("")
    text = F.regexp_replace(F.concat(head, link, F.lit("\n"), tags, F.lit("\n"), "body"), r"\s+$", "")
    bullets = F.size(F.split(text, "\n- \\[")).cast("long") - 1
    return p.select(
        F.lit("sources").alias("kind"), F.substring_index("source_ref", "/", -1).alias("slug"), "title",
        F.lit(None).cast("string").alias("note"), bullets.alias("mentions"), text.alias("piece"),
    )


def mentions(extracted: DataFrame) -> DataFrame:
    """(kind, slug, name, note, source_ref, date, seq) from `extracted(source_ref, date, seq, concepts, entities)`, where
    concepts and entities are array<struct<name, note>>: at most five of each, blank names dropped, and one mention per
    page and source (the first)."""
    def entries(kind: str) -> Column:
        def entry(e: Column, i: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), i.alias("pos"), e["name"].alias("name"), e["note"].alias("note"))

        return F.transform(F.slice(kind, 1, 5), entry)

    parts = [entries("concepts"), entries("entities")]
    rows = extracted.select("source_ref", "date", "seq", F.inline(F.concat(*parts)))
    named = rows.withColumn("name", blank_to_null(F.col("name"))).filter("name is not null")
    named = named.withColumn("slug", slugify(F.col("name"))).withColumn("note", F.trim(F.coalesce("note", F.lit(""))))
    # a source links a page once: its first entry for that page wins
    return named.groupBy("kind", "slug", "source_ref").agg(
        F.min(F.struct("date", "seq", "pos", "name", "note")).alias("m")
    ).select("kind", "slug", "source_ref", "m.date", "m.seq", "m.pos", "m.name", "m.note")


def merge_mentions(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Known mentions plus those of new sources; a source already linked on a page is not added again."""
    new = fresh.join(known.select("kind", "slug", "source_ref"), ["kind", "slug", "source_ref"], "left_anti")
    return known.unionByName(new)


def pages(all_mentions: DataFrame) -> DataFrame:
    """(kind, slug, title, note, mentions): title and note come from the first mention. Aggregates only, so a popular
    page costs one partial row per task."""
    first = F.struct("date", "seq", "pos")
    return all_mentions.groupBy("kind", "slug").agg(
        F.min_by("name", first).alias("title"), F.min_by("note", first).alias("note"), F.count("*").alias("mentions")
    )


def listing(page_table: DataFrame) -> DataFrame:
    """Pages of each kind by number of mentions, then title."""
    order = Window.partitionBy("kind").orderBy(F.desc("mentions"), F.lower("title"), "slug")
    return page_table.withColumn("rank", F.row_number().over(order))


def lint(page_table: DataFrame) -> DataFrame:
    """(kind, pages, weak): weak pages have one mention or none; sources are never weak."""
    weak = F.col("kind").isin("concepts", "entities") & (F.col("mentions") <= 1)
    return page_table.groupBy("kind").agg(F.count("*").alias("pages"), F.count_if(weak).alias("weak"))


def page_lines(all_mentions: DataFrame) -> DataFrame:
    """(kind, slug, piece): the text of each page as pieces: its head, then one line per mention."""
    head = pages(all_mentions).select(
        "kind", "slug", F.concat(F.lit("# "), "title", F.lit("\n\n"), "note", F.lit("\n\n" + PAGE_HEAD)).alias("piece")
    )
    lines = all_mentions.select(
        "kind", "slug",
        F.concat(F.lit("- ["), "date", F.lit("] "), "note", F.lit(" — [["), "source_ref", F.lit("]]")).alias("piece"),
    )
    return head.unionByName(lines)


def question_words(query: Column) -> Column:
    words = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit("([0-9a-zA-Zа-яёА-ЯЁ]{3,})"), F.lit(1))
    return F.array_distinct(F.transform(words, lambda w: F.lower(w)))


def _trigrams(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: c.substr(i, F.lit(3)))


def find_pages(queries: DataFrame, lines: DataFrame, max_pages: int = K.WIKI_MAX_PAGES, budget: int = K.WIKI_MAX_CONTEXT) -> DataFrame:
    """(query_id, kind, slug, score, rank, in_context) of `lines(kind, slug, piece)` for `queries(query_id, query)`.

    The score is the number of occurrences of the query's words in the page, plus 3 if its slug holds one. Words count
    inside longer words too, so they are matched to the vocabulary through shared trigrams (an equi-join) and then
    checked; the texts are written once and reduced to the words that match. Context takes pages in order until the budget is exceeded."""
    q = materialize(queries.select("query_id", F.explode(question_words(F.col("query"))).alias("word")), "question-words")
    lines = materialize(lines.select("kind", "slug", "piece", F.length("piece").alias("chars")), "page-lines")
    held = lines.select("kind", "slug", F.explode(tokens(F.col("piece"))).alias("token")).filter(F.length("token") >= 3)
    # slugs are part of the vocabulary, each counted as one token that holds the word or not
    slugs = lines.select("kind", "slug").distinct()
    vocabulary = (
        held.select("token")
        .unionByName(slugs.select(F.lower("slug").alias("token")))
        .filter(F.length("token") >= 3)
        .distinct()
    )
    grams = vocabulary.select("token", F.explode(F.array_distinct(_trigrams(F.col("token")))).alias("gram"))
    matched = materialize(
        q.select("word").distinct().withColumn("gram", F.substring("word", 1, 3))
        .join(grams, "gram")
        .filter(F.contains("token", F.col("word")))
        .select(
            "word", "token",
            ((F.length("token") - F.length(F.replace("token", F.col("word"), F.lit("")))) / F.length("word")).cast("long").alias("occurrences"),
        ),
        "matched-words",
    )
    # only words that a question holds are moved: a row per page and word, combined on the map side
    in_text = held.join(matched, "token").groupBy("kind", "slug", "word").agg(F.sum("occurrences").alias("score"), F.lit(False).alias("in_slug"))
    in_slug = (
        slugs.withColumn("token", F.lower("slug")).join(matched, "token")
        .select("kind", "slug", "word", F.lit(0).cast("long").alias("score"), F.lit(True).alias("in_slug"))
    )
    # a page's words lie together, so its scores are summed where they are, and only the best pages of a question leave a task
    scored = (
        in_text.unionByName(in_slug)
        .repartition("kind", "slug")
        .join(q, "word")
        .groupBy("query_id", "kind", "slug")
        .agg((F.sum("score") + F.when(F.max("in_slug"), 3).otherwise(0)).alias("score"))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "kind", "slug")
    top = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max_pages)
    # pieces are joined by line breaks; the frame around a page is "\n\n=== kind/slug ===\n"
    sizes = lines.groupBy("kind", "slug").agg(
        (F.sum("chars") + F.count("*") - 1).alias("body_chars")
    )
    frame = F.length("kind") + F.length("slug") + F.lit(len("\n\n=== / ===\n"))
    so_far = best.rowsBetween(Window.unboundedPreceding, 0)
    return (
        top.join(sizes, ["kind", "slug"])
        .withColumn("_so_far", F.sum(F.col("body_chars") + frame).over(so_far))
        .withColumn("in_context", F.col("_so_far") <= budget)
        .drop("_so_far", "body_chars")
    )
