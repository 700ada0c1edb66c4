"""Ranked and paged reads of the item table: feeds, digests, saved lists, trends, drill-downs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import scores as S
from storyloom.operators import reactions

VISIBLE = "processed_at is not null and skip_reason is null"


MAX_PAGE = 200  # rows of a page of the API


@dataclass(frozen=True)
class FeedRequest:
    """Filters, order and page of a feed read. `min_score` tests the raw source score, `since` the publish time."""

    category: str | None = None
    source_types: tuple = field(default_factory=tuple)
    feed_name: str | None = None
    feed_prefix: str | None = None
    vertical: str | None = None
    since: str | None = None
    min_score: float | None = None
    min_insight: float | None = None
    watch_topic: str | None = None
    has_watch: bool = False
    sort: str = "recent"
    limit: int = 50
    cursor: str | None = None
    collapse: bool = True

    @property
    def page_size(self) -> int:
        """A page has 1 to 200 rows, whatever is asked."""
        return max(1, min(self.limit, MAX_PAGE))


def feed_filter(items: DataFrame, q: FeedRequest) -> DataFrame:
    df = items.filter(VISIBLE)
    for name in ("category", "feed_name", "vertical"):
        if getattr(q, name):
            df = df.filter(F.col(name) == getattr(q, name))
    if q.source_types:
        df = df.filter(F.col("source_type").isin(*q.source_types))
    if q.feed_prefix:
        df = df.filter(F.col("feed_name").startswith(q.feed_prefix))
    if q.since:
        df = df.filter(F.col("published_at") >= F.lit(q.since).cast("timestamp_ntz"))
    if q.min_score is not None:
        df = df.filter(F.col("raw_score") >= q.min_score)
    if q.min_insight is not None:
        df = df.filter(F.col("insight_score") >= q.min_insight)
    if q.watch_topic:
        df = df.filter(F.array_contains("watch_topics", q.watch_topic))
    if q.has_watch:
        df = df.filter(F.size("watch_topics") > 0)
    if q.sort == "personal":
        df = df.filter("personal_score is not null")
    if q.sort == "insight":
        df = df.filter("insight_score is not null")
    return df


def kind_filter(kind: str) -> Column:
    """Named selections of the dashboards; an unknown kind selects everything."""
    if kind == "twitter":
        return F.coalesce(F.col("feed_name").startswith("tw_"), F.lit(False))
    if kind in K.VERTICALS:
        return F.coalesce(F.col("vertical") == kind, F.lit(False))
    if kind == "watch":
        return F.coalesce(F.size("watch_topics") > 0, F.lit(False))
    return F.lit(True)


def feed_order(sort: str) -> list[Column]:
    last = F.col("id").desc()
    if sort == "personal":
        return [F.col("personal_score").desc_nulls_last(), last]
    if sort == "insight":
        return [F.col("insight_score").desc_nulls_last(), F.col("personal_score").desc_nulls_last(), last]
    if sort == "score":
        return [F.col("score").desc_nulls_last(), last]
    return [F.col("sort_ts").desc(), last]


def collapse(df: DataFrame, order: list[Column], by: tuple = ()) -> DataFrame:
    """The first row of each cluster under `order`; rows outside clusters stand for themselves.

    Spark keeps only the leading row per cluster on the map side before it shuffles, so a cluster that holds a third of
    the table costs each task one row."""
    w = Window.partitionBy(*by, F.col("cluster_id").isNull(), F.coalesce("cluster_id", "id")).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def encode_cursor(ts: Column, id_: Column) -> Column:
    raw = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("|"), id_.cast("string"))
    return F.translate(F.base64(raw.cast("binary")), "+/", "-_")


def decode_cursor(cursor: Column) -> tuple[Column, Column]:
    raw = F.unbase64(F.translate(cursor, "-_", "+/")).cast("string")
    return F.substring_index(raw, "|", 1).cast("timestamp_ntz"), F.substring_index(raw, "|", -1).cast("long")


def feed(items: DataFrame, q: FeedRequest) -> DataFrame:
    """One page of a feed, best first, with `rank` and, on the last row of a recent page that has a successor,
    `next_cursor`."""
    df = feed_filter(items, q)
    order = feed_order(q.sort)
    keyset = q.sort not in ("personal", "insight", "score")
    if keyset and q.cursor:
        ts, id_ = decode_cursor(F.lit(q.cursor))
        df = df.filter((F.col("sort_ts") < ts) | ((F.col("sort_ts") == ts) & (F.col("id") < id_)))
    if q.collapse:
        df = collapse(df, order)
    page = df.orderBy(*order).limit(q.page_size + 1)
    # at most limit + 1 rows are left, so one task may number them
    rn = Window.orderBy(*order)
    page = page.withColumn("rank", F.row_number().over(rn)).withColumn("_more", F.lead("id").over(rn).isNotNull())
    ends = (F.col("rank") == q.page_size) & F.col("_more") & F.lit(keyset)
    return (
        page.withColumn("next_cursor", F.when(ends, encode_cursor(F.col("sort_ts"), F.col("id"))))
        .filter(F.col("rank") <= q.page_size)
        .drop("_more")
    )


def since_hours(as_of: Column, hours: int, ts: str = "sort_ts") -> Column:
    return F.col(ts) > as_of - F.expr(f"INTERVAL {int(hours)} HOURS")


def top_of_period(
    items: DataFrame, as_of: Column, hours: int, limit: int = 12, vertical: str | None = None, exclude: DataFrame | None = None
) -> DataFrame:
    """Best stories of the last hours, one per cluster, without ids already shown (`exclude(id)`)."""
    df = items.filter(VISIBLE).filter(F.col("personal_score").isNotNull() & since_hours(as_of, hours))
    if vertical:
        df = df.filter(F.col("vertical") == vertical)
    if exclude is not None:
        df = df.join(exclude.select("id"), "id", "left_anti")
    order = feed_order("personal")
    return collapse(df, order).orderBy(*order).limit(limit)


def next_seen(top: DataFrame, seen: DataFrame, keep: int = K.DIGEST_SEEN_KEEP) -> DataFrame:
    """The new memory of shown ids: the digest just sent, then what was remembered before, `keep` in all."""
    fresh = top.select("id", F.lit(0).alias("age"), F.row_number().over(Window.orderBy(*feed_order("personal"))).alias("pos"))
    both = fresh.unionByName(seen.select("id", F.lit(1).alias("age"), F.col("pos").cast("int").alias("pos")))
    return both.orderBy("age", "pos").limit(keep).select("id", "age", "pos")


def unpushed_top(items: DataFrame, limit: int = 10) -> DataFrame:
    return items.filter("personal_score is not null and pushed_at is null").orderBy(*feed_order("personal")).limit(limit)


def windowed_top(items: DataFrame, as_of: Column, hours: int = 72, limit: int = 8) -> DataFrame:
    """Per area the best visible stories of the window; an area with none in the window shows its all-time best."""
    df = items.filter(VISIBLE).filter("personal_score is not null and vertical is not null")
    fresh = F.coalesce(F.col("published_at") >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS"), F.lit(False))
    df = df.withColumn("tier", F.when(fresh, 0).otherwise(1))
    order = feed_order("personal")
    best = collapse(df, order, by=("vertical", "tier"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("vertical", "tier").orderBy(*order)))
    top = ranked.filter(F.col("rank") <= limit)
    # the all-time list of an area without fresh stories consists of tier-1 rows only
    has_fresh = top.filter("tier = 0").select("vertical").distinct()
    return top.filter("tier = 0").unionByName(top.filter("tier = 1").join(has_fresh, "vertical", "left_anti"))


def saved(
    items: DataFrame, marks: DataFrame, signals=("save",), kind: str = "all", tag: str | None = None, hours: int = 0,
    as_of: Column | None = None, since: str | None = None, min_score: float | None = None, sort: str = "saved",
    limit: int | None = 50, offset: int = 0,
) -> DataFrame:
    """Marked items with mark time and signals; `since` is on the mark time. No visibility filter: a mark is a
    decision."""
    m = reactions.per_item(marks, signals).withColumnRenamed("item_id", "id")
    if since is not None:
        m = m.filter(F.col("marked_at") > F.lit(since).cast("timestamp_ntz"))
    df = items.filter(kind_filter(kind))
    if tag:
        df = df.filter(F.array_contains("tags", tag))
    if hours > 0:
        df = df.filter(since_hours(as_of, hours))
    if min_score is not None:
        df = df.filter(F.col("personal_score") >= min_score)
    df = df.join(m, "id")
    order = {
        "score": [F.col("personal_score").desc_nulls_last(), F.desc("marked_at")],
        "time": [F.desc("sort_ts")],
    }.get(sort, [F.desc("marked_at")]) + [F.desc("id")]
    df = df.orderBy(*order)
    return df.offset(offset).limit(limit) if limit is not None else df


def saved_watermark(items: DataFrame, marks: DataFrame, signals=("save",), since: str | None = None) -> DataFrame:
    """What an incremental client needs to remember: rows in this batch, all marked items, the newest mark time."""
    rows = saved(items, marks, signals, since=since, limit=None)
    total = reactions.per_item(marks, signals).agg(F.count("*")).scalar()
    return rows.groupBy().agg(F.count("*").alias("n"), F.max("marked_at").alias("latest_saved_at")).withColumn("total", total)


def dashboard_feed(
    items: DataFrame, marks: DataFrame, as_of: Column, kind: str = "all", sort: str = "time", hours: int = 0, limit: int = 50
) -> DataFrame:
    """Visible items of a kind, one per cluster, with the signals that stand on each."""
    df = items.filter(VISIBLE).filter(kind_filter(kind))
    if hours > 0:
        df = df.filter(since_hours(as_of, hours))
    order = [F.col("sort_ts").desc(), F.col("id").desc()]
    if sort == "score":
        order = [F.col("personal_score").desc_nulls_last(), *order]
    page = collapse(df, order).orderBy(*order).limit(max(1, min(limit, MAX_PAGE)))
    return attach_signals(page, marks)


def attach_signals(page: DataFrame, marks: DataFrame) -> DataFrame:
    on_page = marks.join(page.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    per_item = on_page.groupBy(F.col("item_id").alias("id")).agg(F.sort_array(F.collect_list("signal")).alias("feedback"))
    return page.join(per_item, "id", "left").withColumn(
        "feedback", F.coalesce("feedback", F.array().cast("array<string>"))
    )


# --- trends -----------------------------------------------------------------------------------------------------


def tag_windows(items: DataFrame, as_of: Column, period: str = "day", vertical: str | None = None) -> DataFrame:
    """(tag, count, prev, avg_score): the current window against the typical earlier one, both in one pass over the
    exploded tags. Only scored items count as current; the base has no such rule."""
    hours, base_hours, divisor, _ = K.TREND_PERIODS.get(period, K.TREND_PERIODS["day"])
    df = items.filter(VISIBLE).filter(since_hours(as_of, hours + base_hours))
    if vertical in K.VERTICALS:
        df = df.filter(F.col("vertical") == vertical)
    current = since_hours(as_of, hours) & F.col("personal_score").isNotNull()
    rows = df.select(
        F.explode("tags").alias("tag"), "personal_score", current.alias("current"), (~since_hours(as_of, hours)).alias("earlier")
    )
    return rows.groupBy("tag").agg(
        F.count_if("current").alias("count"),
        (F.count_if("earlier") / float(divisor)).alias("prev"),
        F.avg(F.when(F.col("current"), F.col("personal_score"))).alias("avg_score"),
    )


def trends(items: DataFrame, as_of: Column, period: str = "day", vertical: str | None = None, limit: int = 8) -> DataFrame:
    return trends_of(tag_windows(items, as_of, period, vertical), period, limit)


def trends_of(windows: DataFrame, period: str = "day", limit: int = 8) -> DataFrame:
    """The strongest of `windows(tag, count, prev, avg_score)`."""
    min_count = K.TREND_PERIODS.get(period, K.TREND_PERIODS["day"])[3]
    c, p, s = F.col("count"), F.col("prev"), F.col("avg_score")
    rows = windows.filter((c >= min_count) & (F.col("tag") != "") & ~F.lower("tag").isin(*K.BROAD_TAGS))
    return (
        rows.select(
            "tag", "count", "prev",
            F.round(F.least(S.growth(c, p), F.lit(9.99)), 2).alias("growth"),
            F.round(s, 3).alias("avg_score"),
            S.direction(c, p).alias("direction"),
            S.strength(c, p, s).alias("strength"),
        )
        .orderBy(F.desc("strength"), "tag")
        .limit(limit)
    )


def tag_tiles(items: DataFrame, ts: str = "sort_ts") -> DataFrame:
    """(tile, vertical, tag, n, scored, score_sum) of visible items: one row per day, area and tag. A tile is named by the midnight that
    ends it, which belongs to it, so that windows of whole days before a midnight are sums of tiles."""
    instant = F.expr("INTERVAL 1 MICROSECOND")
    tile = (F.date_trunc("DAY", F.col(ts) - instant) + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    rows = items.filter(VISIBLE).filter(F.col(ts).isNotNull()).select(tile.alias("tile"), "vertical", F.explode("tags").alias("tag"), "personal_score")
    return rows.groupBy("tile", "vertical", "tag").agg(
        F.count("*").alias("n"), F.count("personal_score").alias("scored"), F.coalesce(F.sum("personal_score"), F.lit(0.0)).alias("score_sum"))


def tile_windows(tiles: DataFrame, as_of: Column, period: str = "day", vertical: str | None = None) -> DataFrame:
    """`tag_windows` from daily tiles, for an `as_of` at midnight."""
    hours, base_hours, divisor, _ = K.TREND_PERIODS.get(period, K.TREND_PERIODS["day"])
    back = lambda h: as_of - F.expr(f"INTERVAL {int(h)} HOURS")
    df = tiles.filter(F.col("tile") > back(hours + base_hours))
    if vertical in K.VERTICALS:
        df = df.filter(F.col("vertical") == vertical)
    now = F.col("tile") > back(hours)
    scored = F.coalesce(F.sum(F.when(now, F.col("scored"))), F.lit(0))
    return df.groupBy("tag").agg(
        scored.alias("count"),
        (F.coalesce(F.sum(F.when(~now, F.col("n"))), F.lit(0)) / float(divisor)).alias("prev"),
        F.when(scored > 0, F.sum(F.when(now, F.col("score_sum"))) / scored).alias("avg_score"),
    )


def trend_items(
    items: DataFrame, as_of: Column, tag: str, period: str = "day", vertical: str | None = None, limit: int = 10
) -> DataFrame:
    hours = K.TREND_PERIODS.get(period, K.TREND_PERIODS["day"])[0]
    return top_of_period(items.filter(F.array_contains("tags", tag)), as_of, hours, limit, vertical if vertical in K.VERTICALS else None)


def top_tags(items: DataFrame, as_of: Column, vertical: str, limit: int = 60, days: int = 30) -> DataFrame:
    recent = F.col("processed_at") > as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    return (
        items.filter((F.col("vertical") == vertical) & recent)
        .select(F.explode("tags").alias("tag"))
        .groupBy("tag")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "tag")
        .limit(limit)
    )
