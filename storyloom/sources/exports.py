"""Feeds out: RSS 2.0 files and JSON Feed 1.1 documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import constants as K

JSON_FEED_VERSION = "https://jsonfeed.org/version/1.1"


def rss_fields() -> dict[str, Column]:
    return {
        "title": F.coalesce(F.nullif("title", F.lit("")), F.lit(K.UNTITLED)),
        "link": F.nullif("url", F.lit("")),
        "description": F.nullif("text", F.lit("")),
        "author": F.nullif("author", F.lit("")),
        "guid": F.coalesce(F.col("id").cast("string"), "source_id"),
        "pubDate": F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss '+0000'"),
    }


def rss_rows(page: DataFrame) -> DataFrame:
    """Items in the shape of RSS elements; empty elements are left out by the writer."""
    return page.select(*(c.alias(name) for name, c in rss_fields().items()))


def write_rss(page: DataFrame, path: str) -> None:
    """RSS item files below `path`, one per partition; a channel file is their concatenation."""
    rss_rows(page).write.format("xml").option("rootTag", "channel").option("rowTag", "item").mode("overwrite").save(path)


def rss_document(page: DataFrame, title: str, base_url: str, description: str) -> DataFrame:
    """One RSS 2.0 document for a page of a feed, its channel head included; bounded, as a page is, by the request limit."""
    def escaped(c: Column) -> Column:
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(plain), F.lit(entity))
        return c

    def element(tag: str, c: Column) -> Column:
        return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"<{tag}>"), escaped(c), F.lit(f"</{tag}>")))

    fields = rss_fields()
    item = F.concat(F.lit("<item>"), *(element(name, c) for name, c in fields.items()), F.lit("</item>"))
    items = page.select("rank", item.alias("item"))
    head = F.concat(*(element(t, F.lit(v)) for t, v in (("title", title), ("link", base_url.rstrip("/") + "/"), ("description", description))))
    listed = items.groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda r: r["item"]), "").alias("items"))
    return listed.select(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel>'), head, "items", F.lit("</channel></rss>")).alias("document"))


def json_items(page: DataFrame) -> DataFrame:
    """(rank, id, entry) with one JSON Feed item each; keys without a value are omitted."""
    entry = F.to_json(
        F.struct(
            F.coalesce(F.col("id").cast("string"), "source_id").alias("id"),
            F.nullif("url", F.lit("")).alias("url"),
            F.nullif("title", F.lit("")).alias("title"),
            F.nullif("text", F.lit("")).alias("content_text"),
            F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("date_published"),
            F.when(F.size("tags") > 0, F.col("tags")).alias("tags"),
            F.when(F.length("author") > 0, F.array(F.struct(F.col("author").alias("name")))).alias("authors"),
        )
    )
    return page.select("rank", "id", entry.alias("entry"), "next_cursor")


def json_feed(page: DataFrame, title: str, base_url: str, path: str = "/feed.json") -> DataFrame:
    """One JSON Feed document for a page of a feed. A page is bounded by its request limit (200 at most), so the
    document is too."""
    base = base_url.rstrip("/")
    rows = json_items(page).groupBy().agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "entry"))), lambda e: e["entry"]), ",").alias("items"),
        F.max("next_cursor").alias("next_cursor"),
    )

    def quoted(c: Column) -> Column:
        # JSON string literal of a column: a one-element array without its brackets
        return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")

    tail = F.when(
        F.col("next_cursor").isNotNull(),
        F.concat(F.lit(',"next_url":'), quoted(F.concat(F.lit(f"{base}{path}?cursor="), "next_cursor"))),
    ).otherwise("")
    doc = F.concat(
        F.lit('{"version":'), quoted(F.lit(JSON_FEED_VERSION)), F.lit(',"title":'), quoted(F.lit(title)),
        F.lit(',"home_page_url":'), quoted(F.lit(base + "/")), F.lit(',"feed_url":'), quoted(F.lit(base + path)),
        F.lit(',"items":['), F.col("items"), F.lit("]"), tail, F.lit("}"),
    )
    return rows.select(doc.alias("document"))
