"""Feed files to items: RSS / Atom XML, nested API entries, repository listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import lit_strings
from storyloom.functions.pages import LISTING_LINK
from storyloom.functions.text import clean_title, strip_html

# tags with a prefix keep it in the name; attributes start with '_'
RSS_SCHEMA = (
    "title string, link string, guid struct<_VALUE:string,_isPermaLink:string>, pubDate string, `dc:date` string, "
    "description string, `content:encoded` string, author string, `dc:creator` string, "
    "`media:content` array<struct<_url:string>>, enclosure array<struct<_url:string>>"
)
ATOM_SCHEMA = (
    "id string, title string, link array<struct<_href:string,_rel:string>>, published string, updated string, "
    "summary string, content string, author struct<name:string>"
)


def _time(c: str) -> Column:
    text = F.trim(c)
    rfc = F.regexp_replace(text, "^[A-Za-z]{3}, *", "")
    rfc = F.regexp_replace(rfc, "(GMT|UT|UTC|Z)$", "+0000")
    return F.coalesce(
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm Z")),
        text.try_cast("timestamp"),
    )


def _urls(c: str) -> Column:
    return F.coalesce(F.filter(F.transform(c, lambda m: m["_url"]), lambda u: u.isNotNull() & (u != "")), F.array().cast("array<string>"))


def _filled(*cols) -> Column:
    return F.coalesce(*[F.nullif(c if isinstance(c, Column) else F.col(c), F.lit("")) for c in cols])


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed RSS files. `feed_name` is the file name without extension."""
    raw = (
        spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").schema(RSS_SCHEMA).load(path)
        .withColumn("feed_name", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1))
    )
    return raw.select(
        F.lit("rss").alias("source_type"),
        _filled("guid._VALUE", "link", "title").alias("source_id"),
        F.col("link").alias("url"),
        clean_title(F.col("title")).alias("title"),
        strip_html(_filled("content:encoded", "description")).alias("text"),
        F.concat(_urls("media:content"), _urls("enclosure")).alias("media"),
        _filled("author", "dc:creator", "feed_name").alias("author"),
        "feed_name",
        F.lit(None).cast("double").alias("raw_score"),
        F.lit(None).cast("string").alias("category"),
        F.coalesce(_time("pubDate"), _time("dc:date")).alias("published_at"),
    )


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    raw = (
        spark.read.format("xml").option("rowTag", "entry").option("mode", "PERMISSIVE").schema(ATOM_SCHEMA).load(path)
        .withColumn("feed_name", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1))
    )
    plain = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    enclosed = F.filter("link", lambda x: x["_rel"] == "enclosure")
    url = F.get(plain, F.lit(0))["_href"]
    return raw.select(
        F.lit("rss").alias("source_type"),
        _filled("id", url, "title").alias("source_id"),
        url.alias("url"),
        clean_title(F.col("title")).alias("title"),
        strip_html(_filled("content", "summary")).alias("text"),
        F.coalesce(F.transform(enclosed, lambda x: x["_href"]), F.array().cast("array<string>")).alias("media"),
        _filled("author.name", "feed_name").alias("author"),
        "feed_name",
        F.lit(None).cast("double").alias("raw_score"),
        F.lit(None).cast("string").alias("category"),
        F.coalesce(_time("published"), _time("updated")).alias("published_at"),
    )


def cutoff(cursor: Column, interval_s: Column, now: Column, factor: float = K.INGEST_AGE_FACTOR, floor_h: float = K.INGEST_MIN_WINDOW_HOURS) -> Column:
    """Oldest publish time worth taking: the cursor, but no older than the larger of interval x factor and the floor. A
    missing or broken cursor counts as none."""
    window = F.greatest(interval_s * factor, F.lit(floor_h * 3600.0))
    horizon = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), window.cast("decimal(18,6)"))
    return F.greatest(cursor.try_cast("timestamp"), horizon)


def with_cutoff(entries: DataFrame, feeds: DataFrame, now: Column) -> DataFrame:
    """Entries with their feed's `cutoff`. `feeds(feed_name, cursor, interval_s)` has one row per known feed; a feed met
    for the first time, or an entry without a feed, has no cursor and the default interval."""
    limits = feeds.select("feed_name", "cursor", "interval_s")
    joined = entries.join(limits, "feed_name", "left")
    interval = F.coalesce("interval_s", F.lit(K.DEFAULT_INTERVAL_SECONDS))
    return joined.withColumn("cutoff", cutoff(F.col("cursor"), interval, now)).drop("cursor", "interval_s")


def since_cutoff(entries: DataFrame, feeds: DataFrame, now: Column, ts: str = "published_at") -> DataFrame:
    """Entries newer than their feed's cutoff; undated entries pass."""
    return with_cutoff(entries, feeds, now).filter(F.col(ts).isNull() | (F.col(ts) > F.col("cutoff")))


def new_cursors(entries: DataFrame, feeds: DataFrame, now: Column, ts: str = "published_at") -> DataFrame:
    """(feed_name, new_cursor) after a poll: the newest time taken from each feed of `entries`, its cutoff if none was."""
    seen = with_cutoff(entries, feeds, now).groupBy("feed_name").agg(F.greatest(F.max("cutoff"), F.max(ts)).alias("new_cursor"))
    return seen.filter(F.col("feed_name").isNotNull())


ENTRIES_SCHEMA = (
    "entries array<struct<id:long,url:string,title:string,content:string,author:string,published_at:string,"
    "feed:struct<title:string,category:struct<title:string>>>>"
)


def api_entries(payloads: DataFrame) -> DataFrame:
    """`payloads(entries)` exploded to one row per entry."""
    e = payloads.select(F.explode("entries").alias("e"))
    return e.select("e.*").withColumn("category_title", F.lower(F.coalesce("feed.category.title", F.lit(""))))


def api_items(entries: DataFrame, allowed=()) -> DataFrame:
    kept = entries.filter(F.col("category_title").isin(*allowed)) if allowed else entries
    return kept.select(
        F.lit("miniflux").alias("source_type"),
        F.col("id").cast("string").alias("source_id"),
        "url",
        clean_title(F.col("title")).alias("title"),
        strip_html(F.col("content")).alias("text"),
        F.array().cast("array<string>").alias("media"),
        _filled("author", "feed.title").alias("author"),
        F.coalesce(F.nullif("feed.title", F.lit("")), F.lit("miniflux")).alias("feed_name"),
        F.lit(None).cast("double").alias("raw_score"),
        F.nullif("category_title", F.lit("")).alias("category"),
        F.col("published_at").try_cast("timestamp").alias("published_at"),
    )


def api_cursor(entries: DataFrame, after: int = 0) -> DataFrame:
    """Largest entry id seen, rows dropped by the category list included."""
    return entries.agg(F.greatest(F.coalesce(F.max("id"), F.lit(after)), F.lit(after)).alias("cursor"))


def listing_links(listings: DataFrame) -> DataFrame:
    """(topic, slug, pos) from `listings(topic, list_no, html)`: repository links in page order, first list first, each
    once; service paths are not repositories. Matching is per page, the first position per slug is a grouped minimum."""
    found = F.regexp_extract_all("html", F.lit(LISTING_LINK), F.lit(1))
    rows = listings.select("topic", "list_no", F.posexplode(found).alias("pos", "slug"))
    reserved = F.exists(lit_strings(K.LISTING_RESERVED_PREFIXES), lambda p: F.startswith(F.lower(F.col("slug")), p))
    return rows.filter(~reserved).groupBy("topic", "slug").agg(F.min(F.struct("list_no", "pos")).alias("first_at"))


def checked_not_empty(listings: DataFrame, links: DataFrame) -> DataFrame:
    """The links, failing the job when a topic gave none: silence would look like an empty topic."""
    n = links.groupBy("topic").agg(F.count("*").alias("n"))
    checked = listings.select("topic").distinct().join(n, "topic", "left").select(
        "topic", F.when(F.coalesce("n", F.lit(0)) > 0, True).otherwise(
            F.raise_error(F.concat(F.lit("no repository links for topic "), F.col("topic")))
        ).alias("_ok")
    )
    return links.join(checked.filter("_ok"), "topic").drop("_ok")


def listing_items(links: DataFrame, now: Column) -> DataFrame:
    owner = F.substring_index("slug", "/", 1)
    url = F.concat(F.lit("https://github.com/"), F.col("slug"))
    return links.select(
        F.lit("rss").alias("source_type"), url.alias("source_id"), url.alias("url"),
        F.regexp_replace("slug", "^[^/]*/", "").alias("title"), F.lit(None).cast("string").alias("text"),
        F.array().cast("array<string>").alias("media"), owner.alias("author"),
        F.concat(F.lit("gh_topic_"), F.replace("topic", F.lit("-"), F.lit("_"))).alias("feed_name"),
        F.lit(None).cast("double").alias("raw_score"), F.lit("tech").alias("category"), now.alias("published_at"),
    )
