"""Registered queries: sources, sinks, upsert and streams. Input files are written by Spark from the given tables to the
shared folder and read back through the source under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import text as X
from storyloom.functions.urls import normalize_url
from storyloom.operators import feeds as R
from storyloom.operators import maintenance, monitor, profiles, reactions, scoring
from storyloom.plans import stages
from storyloom.plans import tables as T
from storyloom.plans.catalog_items import _GATE_MIN, NO_BOOST, WATCH, _marks, _muted, _trends_sql
from storyloom.plans.catalog_text import _derived
from storyloom.plans.registry import AS_OF, query
from storyloom.session import materialize, scratch_path
from storyloom.sources import exports, feeds, messages, tail
from storyloom.sources import tables as S
from storyloom.streaming import alerts, flow, limiter, push
from storyloom.streaming.state import KeyedTable

c = F.col
_THIRDS = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")  # where the log is cut into three stretches


def _ntz(col: str):
    return c(col).cast("timestamp_ntz").alias(col)


# --- feed files ------------------------------------------------------------------------------------------------------

_FLAT = "nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


@query(
    "a1_rss_scan",
    f"""SELECT id::VARCHAR AS source_id, url, coalesce({_FLAT.format(x='title')}, '{K.UNTITLED}') AS title, md5({_FLAT.format(x='text')}) AS text_digest, published_at FROM items""",
)
def a1(spark, d):
    path = scratch_path(spark, "rss")
    exports.write_rss(T.items(spark, d), path)
    rows = feeds.read_rss(spark, path)
    return rows.select("source_id", "url", "title", F.md5("text").alias("text_digest"), _ntz("published_at"))


_FEED_STATE = """SELECT feed_name, CASE WHEN starts_with(feed_name, 'tw_') THEN NULL WHEN starts_with(feed_name, 'gh_') THEN NULL ELSE TIMESTAMP '2024-01-20 00:00:00' END AS cur,
  (len(feed_name) % 5 + 1) * 345600 AS interval_s FROM items WHERE NOT starts_with(feed_name, '@') GROUP BY feed_name"""


@query(
    "a2_incremental_cutoff",
    f"""SELECT i.id FROM items i LEFT JOIN ({_FEED_STATE}) f USING (feed_name)
        WHERE published_at IS NULL OR published_at > greatest(cur, {AS_OF} - to_seconds(greatest(coalesce(interval_s, {K.DEFAULT_INTERVAL_SECONDS}) * 1.5, 86400)))""",
)
def a2(spark, d):
    i, state, now = _polled(spark, d)
    return feeds.since_cutoff(i, state, now).select("id")


@query(
    "a2_new_cursors",
    f"""SELECT feed_name, greatest(max(greatest(cur, {AS_OF} - to_seconds(greatest(coalesce(interval_s, {K.DEFAULT_INTERVAL_SECONDS}) * 1.5, 86400)))), max(published_at)) AS new_cursor
        FROM items i LEFT JOIN ({_FEED_STATE}) f USING (feed_name) GROUP BY feed_name""",
)
def a2_cursors(spark, d):
    return feeds.new_cursors(*_polled(spark, d)).select("feed_name", _ntz("new_cursor"))


def _polled(spark, d):
    """Entries, the state of the feeds polled before (feeds of messages are new), and the time of the poll."""
    i = T.items(spark, d).withColumn("published_at", c("published_at").cast("timestamp"))
    cursor = F.when(c("feed_name").startswith("tw_"), "not a date").when(c("feed_name").startswith("gh_"), None).otherwise("2024-01-20T00:00:00")
    state = i.filter(~c("feed_name").startswith("@")).groupBy("feed_name").agg(F.count("*").alias("_n")).select(
        "feed_name", cursor.alias("cursor"), ((F.length("feed_name") % 5 + 1) * 345600).alias("interval_s")
    )
    return i, state, F.lit(T.AS_OF_TEXT).cast("timestamp")


def _api_entries(spark, d):
    i = T.items(spark, d)
    entry = F.struct(
        c("id"), c("url"), F.concat(F.lit("<b>"), "title", F.lit("</b>")).alias("title"), c("text").alias("content"),
        F.lit("").alias("author"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        F.struct(c("feed_name").alias("title"), F.struct(F.upper("lang").alias("title")).alias("category")).alias("feed"),
    )
    raw = i.select(F.to_json(F.struct(F.array(entry).alias("entries"))).alias("value"))
    path = scratch_path(spark, "api")
    raw.write.text(path)
    return feeds.api_entries(spark.read.schema(feeds.ENTRIES_SCHEMA).json(path))


@query(
    "a3_api_items",
    f"""SELECT id::VARCHAR AS source_id, {_FLAT.format(x='title')} AS title, md5({_FLAT.format(x='text')}) AS text_digest, feed_name AS author, feed_name, lang AS category, published_at
        FROM items WHERE lang IN ('en', 'fr')""",
)
def a3(spark, d):
    rows = feeds.api_items(_api_entries(spark, d), ("en", "fr"))
    return rows.select("source_id", "title", F.md5("text").alias("text_digest"), "author", "feed_name", "category", _ntz("published_at"))


@query("a3_api_cursor", "SELECT max(id) AS cursor FROM items")
def a3_cursor(spark, d):
    return feeds.api_cursor(_api_entries(spark, d))


# --- messages ----------------------------------------------------------------------------------------------------------


def _message_lines(spark, d) -> str:
    """A folder of message lines made from the conversations; every seventh turn is broken."""
    t = T.table(spark, d, "conversations")
    msg = F.to_json(
        F.struct(
            F.concat_ws(":", "conv_id", "turn").alias("source_id"), c("text"), c("role").alias("author"),
            F.when(c("turn") % 3 == 0, "news_ai").when(c("turn") % 3 == 1, "news_tech").otherwise("other").alias("category"),
            F.lit("2024-01-05T10:00:00Z").alias("published_at"),
        )
    )
    broken = (c("conv_id") * 3 + c("turn")) % 7 == 6
    line = F.when(broken & (c("turn") % 2 == 0), F.concat(F.lit("{oops "), "role")).when(broken, F.lit('{"text": "no id"}')).otherwise(msg)
    path = scratch_path(spark, "outbox")
    t.select(line.alias("value")).write.text(path)
    return path


_MSG_SQL = """SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS source_id, role AS feed_name, md5(text) AS text_digest,
  CASE turn % 3 WHEN 0 THEN 'ai' WHEN 1 THEN 'tech' ELSE 'other' END AS category FROM conversations WHERE (conv_id * 3 + turn) % 7 <> 6"""


@query("a4_line_tail", _MSG_SQL)
def a4(spark, d):
    tail.register(spark)
    lines = spark.readStream.format("line_tail").option("path", _message_lines(spark, d)).load()
    out = scratch_path(spark, "tailed")
    flow.run_to_table(lines, out, flow.checkpoint_for(spark, "tail"))
    rows = messages.items(messages.parsed(spark.read.schema(tail.SCHEMA).parquet(out)))
    return rows.select("source_id", "feed_name", F.md5("text").alias("text_digest"), "category")


@query("a5_messages", _MSG_SQL)
def a5(spark, d):
    rows = messages.items(messages.parsed(spark.read.text(_message_lines(spark, d))))
    return rows.select("source_id", "feed_name", F.md5("text").alias("text_digest"), "category")


@query(
    "a6_listing_links",
    """SELECT topic, slug, min({'list_no': list_no, 'pos': pos}).list_no AS list_no FROM (
         SELECT source AS topic, doc_id % 2 AS list_no, unnest([lang || '/Repo-' || (doc_id % 50)::VARCHAR, source || '/tool.' || (doc_id % 20)::VARCHAR]) AS slug, unnest([1, 2]) AS pos FROM documents)
       GROUP BY topic, slug""",
)
def a6(spark, d):
    t = T.table(spark, d, "documents")
    one = F.concat("lang", F.lit("/Repo-"), (c("doc_id") % 50).cast("string"))
    two = F.concat("source", F.lit("/tool."), (c("doc_id") % 20).cast("string"))
    link = lambda x: F.concat(F.lit('<h3><a href="/'), x, F.lit('" class="b" data-view-component="true">x</a></h3>'))
    html = F.concat(link(F.lit("Topics/python")), link(one), link(two), link(one), F.lit('<a href="/plain/link">y</a>'))
    pages = t.select(c("source").alias("topic"), (c("doc_id") % 2).cast("int").alias("list_no"), html.alias("html"))
    links = feeds.checked_not_empty(pages, feeds.listing_links(pages))
    return links.select("topic", "slug", c("first_at.list_no").cast("long").alias("list_no"))


# --- upsert and state -----------------------------------------------------------------------------------------------------


def _target_and_batch(spark, d):
    """Even items are stored; the batch brings every third item twice, the later arrival with a changed title."""
    i = T.items(spark, d).withColumn("media", F.array().cast("array<string>"))
    source = ["source_type", "source_id", "url", "title", "text", "media", "author", "feed_name", "raw_score", "category", "published_at"]
    target = i.filter("id % 2 = 0").select(*source, "id", "score", "fetched_at", "attempts").withColumn("url_normalized", normalize_url(c("url")))
    base = i.filter("id % 3 = 0").select(*source, c("id").alias("arrival"))
    later = base.withColumn("title", F.concat(F.lit("New "), F.coalesce("title", F.lit("")))).withColumn("arrival", c("arrival") + 1_000_000_000)
    return target, base.unionByName(later)


_UPSERT_SQL = f"""
  SELECT source_type, source_id, CASE WHEN id % 3 = 0 THEN 'New ' || coalesce(title, '') ELSE title END AS title,
    CASE WHEN id % 2 = 0 THEN score END AS score, CASE WHEN id % 2 = 0 THEN fetched_at ELSE {AS_OF} END AS fetched_at,
    CASE WHEN id % 2 = 0 THEN attempts ELSE 0 END AS attempts, id % 2 <> 0 AS was_new FROM items WHERE id % 2 = 0 OR id % 3 = 0"""


@query("a7_upsert", f"SELECT source_type, source_id, title, round(score, 6) AS score, fetched_at, attempts, was_new FROM ({_UPSERT_SQL})")
def a7(spark, d):
    target, batch = _target_and_batch(spark, d)
    out = S.upsert(target, batch, T.as_of())
    return out.select("source_type", "source_id", "title", F.round("score", 6).alias("score"), "fetched_at", "attempts", "was_new")


@query(
    "a8_cursor_state",
    """SELECT source_name, max(last_run_at) AS last_run_at, max_by(cursor, last_run_at) AS cursor, max_by(last_error, last_run_at) AS last_error FROM (
         SELECT event_type || (user_id % 50)::VARCHAR AS source_name, ts AS last_run_at, event_id::VARCHAR AS cursor, CASE WHEN value > 15 THEN 'timeout' ELSE '' END AS last_error FROM events) GROUP BY source_name""",
)
def a8(spark, d):
    e = T.table(spark, d, "events")
    runs = e.select(
        F.concat("event_type", (c("user_id") % 50).cast("string")).alias("source_name"), c("ts").alias("last_run_at"),
        c("event_id").cast("string").alias("cursor"), F.when(c("value") > 15, "timeout").alias("last_error"),
    )
    return S.latest_cursors(runs)


@query("a9_stage_handoff", _MSG_SQL)
def a9(spark, d):
    """Messages ingested from a stream; the hand-off holds first arrivals only."""
    tail.register(spark)
    lines = spark.readStream.format("line_tail").option("path", _message_lines(spark, d)).load()
    store = flow.ingest_messages(lines, scratch_path(spark, "store"), scratch_path(spark, "bad"), flow.checkpoint_for(spark, "ingest"))
    return store.new_items().select("source_id", "feed_name", F.md5("text").alias("text_digest"), "category")


@query("a10_retention", f"SELECT event_id FROM events WHERE ts > {AS_OF} - INTERVAL 14 DAY")
def a10(spark, d):
    return S.retained(T.table(spark, d, "events"), T.as_of()).select("event_id")


# --- exports -----------------------------------------------------------------------------------------------------------------


@query(
    "a11_rss_rows",
    f"""SELECT coalesce(nullif(title, ''), '{K.UNTITLED}') AS title, nullif(url, '') AS link, md5(text) AS digest, id::VARCHAR AS guid,
          strftime(published_at, '%a, %d %b %Y %H:%M:%S +0000') AS "pubDate" FROM visible""",
)
def a11(spark, d):
    rows = exports.rss_rows(T.items(spark, d).filter(R.VISIBLE))
    return rows.select("title", "link", F.md5("description").alias("digest"), "guid", "pubDate")


_JSON_ENTRY = """json_merge_patch('{}', json_object('id', id::VARCHAR, 'url', url, 'title', title, 'content_text', text,
  'date_published', strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00'), 'tags', tags))::VARCHAR"""


@query(
    "a12_json_feed_items",
    f"SELECT id, {_JSON_ENTRY} AS entry FROM visible",
)
def a12(spark, d):
    page = T.items(spark, d).filter(R.VISIBLE)
    page = page.withColumn("rank", F.lit(0)).withColumn("next_cursor", F.lit(None).cast("string"))
    return exports.json_items(page).select("id", "entry")


def _element(tag: str, value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '' ELSE '<{tag}>' || replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</{tag}>' END"


_RSS_ITEMS = " || ".join(_element(t, v) for t, v in (
    ("title", f"coalesce(nullif(title, ''), '{K.UNTITLED}')"), ("link", "nullif(url, '')"), ("description", "nullif(text, '')"), ("guid", "id::VARCHAR"),
    ("pubDate", "strftime(published_at, '%a, %d %b %Y %H:%M:%S +0000')")))


@query(
    "a11_rss_document",
    f"""SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<rss version="2.0"><channel><title>Stories</title><link>https://feeds.example.com/</link><description>Recent stories</description>'
          || coalesce(string_agg('<item>' || {_RSS_ITEMS} || '</item>', '' ORDER BY sort_ts DESC, id DESC), '') || '</channel></rss>' AS document
        FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id IS NULL, coalesce(cluster_id, id) ORDER BY sort_ts DESC, id DESC) = 1 AS first FROM visible)
          WHERE first ORDER BY sort_ts DESC, id DESC LIMIT 20)""",
)
def a11_document(spark, d):
    page = R.feed(T.items(spark, d, clusters=True), R.FeedRequest(limit=20))
    return exports.rss_document(page, "Stories", "https://feeds.example.com", "Recent stories")


_KEY_SQL = "CASE WHEN url IS NULL THEN id::VARCHAR WHEN url LIKE 'https://github%' THEN url ELSE text_digest END"


@query(
    "j5_vector_clusters",
    f"""WITH RECURSIVE k AS (SELECT id, min(id) OVER (PARTITION BY {_KEY_SQL}) AS first FROM items),
        near AS (SELECT a.id AS a, b.id AS b FROM vecs a JOIN vecs b ON a.id <> b.id WHERE list_cosine_similarity(a.vec, b.vec) >= 0.42 AND a.id IN (SELECT id FROM k) AND b.id IN (SELECT id FROM k)),
        links AS (SELECT a, b FROM near UNION SELECT id, first FROM k WHERE id <> first UNION SELECT first, id FROM k WHERE id <> first),
        reach(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT k.id, least(k.id, coalesce(min(r.other), k.id)) AS cluster_id FROM k LEFT JOIN reach r ON r.id = k.id GROUP BY k.id""",
)
def j5_vectors(spark, d):
    vectors = T.vectors(spark, d).select(c("id"), c("vec").cast("array<float>").alias("vec"))
    return _stories(spark, d, T.items(spark, d).join(vectors, "id", "left"), "vec", min_cos=0.42).select("id", "cluster_id")


def _stories(spark, d, items, *more, min_cos=None):
    """Items in three stretches by arrival, each joined to the stories known by then. The texts that URLs are made of are read once."""
    rows = materialize(items.select("id", normalize_url(c("url")).alias("url_normalized"), "fetched_at", *more), "arrived")
    path, mark = scratch_path(spark, "clusters"), flow.checkpoint_for(spark, "clusters")
    for folder in _arrivals(spark, rows, "fetched_at", _THIRDS, "items"):
        stories = flow.assign_clusters(flow.file_stream(spark, folder, rows.schema), path, mark, min_cos=min_cos)
    return stories.read()


_NEXT = "replace(replace(to_base64(encode(strftime(sort_ts, '%Y-%m-%dT%H:%M:%S.%f') || '|' || id::VARCHAR)), '+', '-'), '/', '_')"


@query(
    "a12_json_feed_page",
    f"""SELECT '{{"version":"https://jsonfeed.org/version/1.1","title":"Stories","home_page_url":"https://feeds.example.com/","feed_url":"https://feeds.example.com/feed.json","items":['
          || string_agg(entry, ',' ORDER BY rank) FILTER (WHERE rank <= 20) || ']'
          || coalesce(',"next_url":"https://feeds.example.com/feed.json?cursor=' || max(CASE WHEN rank = 20 AND more THEN {_NEXT} END) || '"', '') || '}}' AS document
        FROM (SELECT *, {_JSON_ENTRY} AS entry, row_number() OVER w AS rank, lead(id) OVER w IS NOT NULL AS more
          FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id IS NULL, coalesce(cluster_id, id) ORDER BY sort_ts DESC, id DESC) = 1 AS first FROM visible) WHERE first
          WINDOW w AS (ORDER BY sort_ts DESC, id DESC))""",
)
def a12_page(spark, d):
    page = R.feed(T.items(spark, d, clusters=True), R.FeedRequest(limit=20))
    return exports.json_feed(page, "Stories", "https://feeds.example.com")


# --- streams ------------------------------------------------------------------------------------------------------------------


def _stream(spark, d, name):
    """A table as a stream, be it one file or a folder of files: a pattern that only its name fits leads to both."""
    schema = T.table(spark, d, name).schema
    return flow.file_stream(spark, f"{d}/{name}.parque[t]", schema)


def _finished(spark, stream, label, mode="append"):
    out = scratch_path(spark, label)
    flow.run_to_table(stream, out, flow.checkpoint_for(spark, label), mode)
    return spark.read.schema(stream.schema).parquet(out)


@query("a13_live_feed", "SELECT id, source_type, title, url, category, published_at FROM visible WHERE category IS NULL OR category = 'en'")
def a13(spark, d):
    return _finished(spark, flow.processed_feed(T.item_columns(_stream(spark, d, "documents")), "en"), "live")


@query(
    "a14_flow_events",
    """SELECT 'ingested' AS kind, id, source_type, NULL AS title, NULL AS vertical, NULL AS tags FROM items
       UNION ALL SELECT 'processed', id, NULL, title, vertical, array_to_string(tags[1:3], ',') FROM visible""",
)
def a14(spark, d):
    items = T.item_columns(_stream(spark, d, "documents"))
    rows = _finished(spark, flow.flow_events(items, items.filter(R.VISIBLE)), "flow")
    return rows.withColumn("tags", F.array_join("tags", ","))


def _enriched(spark, d):
    items = T.item_columns(_stream(spark, d, "documents")).select(
        "id", "source_type", "feed_name", "url", "title", "text", "tags", "vertical", "skip_reason", "summary", "watch_topics"
    )
    steps = [
        stages.summary_stage(), stages.title_stage(), stages.watch_stage(WATCH), stages.url_stage(),
        stages.model_stage("tagger", 4, ["feed_name"], lambda b: ['{"vertical":"it"}' if f.startswith("gh_") else None for f in b["feed_name"]], "answer"),
    ]
    out = flow.enrich(items, steps, scratch_path(spark, "enriched"), flow.checkpoint_for(spark, "enrich"))
    return out.read()


@query(
    "j1_enrichment",
    f"""SELECT id, title, url_normalized, topics AS watch_topics, md5(coalesce(summary, CASE WHEN starts_with(feed_name, 'tw_') OR (len(trim(text, ' ' || chr(10) || chr(9))) < 280 AND coalesce(title, '') <> '')
            THEN trim(text, ' ' || chr(10) || chr(9)) END)) AS summary_digest, CASE WHEN skip_reason IS NULL AND starts_with(feed_name, 'gh_') THEN '{{"vertical":"it"}}' END AS answer
        FROM (SELECT i.* EXCLUDE (title), i.title AS own_title, CASE WHEN trim(coalesce(i.title, '')) <> '' THEN i.title ELSE coalesce({_derived("i.text")}, '{K.TITLE_FALLBACK_PREFIX}' || feed_name) END AS title,
            CASE WHEN url LIKE 'https://www.Feeds%' THEN 'https://feeds.example.com/item/' || text_digest || '?a=1&b=2' ELSE url END AS url_normalized FROM items i) x
        JOIN (SELECT id AS tid, array_to_string(list_filter([CASE WHEN regexp_matches(h, '(^|[^\\p{{L}}\\p{{N}}_])inging') OR contains(h, 'oned the') THEN 'Ing' END,
            CASE WHEN regexp_matches(h, '(^|[^\\p{{L}}\\p{{N}}_])éau') OR contains(h, 'eau/x') THEN 'Éau' END,
            CASE WHEN contains(h, 'of the') OR contains(h, 'de la') THEN 'Of the' END,
            CASE WHEN regexp_matches(h, '(^|[^\\p{{L}}\\p{{N}}_])ent') THEN 'Ent' END], lambda t: t IS NOT NULL), ',') AS topics
          FROM (SELECT id, lower(substring(coalesce(title, '') || ' ' || text, 1, 4000)) AS h FROM items)) w ON w.tid = x.id""",
)
def j1(spark, d):
    return _enriched(spark, d).select("id", "title", "url_normalized", F.array_join("watch_topics", ",").alias("watch_topics"), F.md5("summary").alias("summary_digest"), "answer")


_STRETCH = f"(fetched_at >= TIMESTAMP '{_THIRDS[0]}')::INTEGER + (fetched_at >= TIMESTAMP '{_THIRDS[1]}')::INTEGER"


@query(
    "j1_scored_stream",
    f"""WITH g AS (SELECT i.id, CASE WHEN coalesce(len(watch_topics) = 0 AND source_type <> 'manual' AND b.sim < {_GATE_MIN}, false)
            THEN 'низкая близость к профилям: ' || printf('%.2f', sim) || ' (ближе всего ' || b.vertical || ')' END AS reason
          FROM items i LEFT JOIN (SELECT v.id, max(list_cosine_similarity(v.vec, p.vec)) AS sim, max_by(p.vertical, list_cosine_similarity(v.vec, p.vec)) AS vertical
            FROM vecs v, profile_vecs p GROUP BY v.id) b ON b.id = i.id),
        k AS (SELECT id, min(id) OVER (PARTITION BY story ORDER BY stretch) AS cluster_id, count(*) OVER (PARTITION BY story ORDER BY stretch) AS size
          FROM (SELECT id, {_KEY_SQL} AS story, {_STRETCH} AS stretch FROM items))
        SELECT i.id, k.cluster_id, k.size, coalesce(g.reason, '{K.MUTE_PREFIX}' || h.muted_tag) AS skip_reason,
          CASE WHEN g.reason IS NULL THEN round(exp(-greatest(coalesce(date_diff('second', published_at, {AS_OF}) / 3600::DOUBLE, 24), 0) / 48) * (1 + coalesce(raw_score, 0)) * (1 + ln(size)), 6) END AS base_score,
          CASE WHEN g.reason IS NULL AND i.vertical IS NOT NULL THEN s.llm_relevance END AS llm_relevance, CASE WHEN g.reason IS NULL THEN round(ps, 6) END AS personal_score
        FROM items i JOIN g ON g.id = i.id JOIN k ON k.id = i.id JOIN scored s ON s.id = i.id LEFT JOIN muted_hits h ON h.id = i.id""",
)
def j1_scored(spark, d):
    """Items in three stretches through gate, stories, tagger, base score, judge, mutes and personal score. Stand-in models answer from
    columns of the items; what a reader has taught is learned from the reaction log."""
    labels = T.table(spark, d, "labels").select(c("doc_id").alias("id"), c("quality").alias("verdict"))
    vectors = T.vectors(spark, d)
    rows = T.items(spark, d).join(vectors, "id", "left").join(labels, "id", "left").select(
        "id", "source_type", "feed_name", "author", normalize_url(c("url")).alias("url_normalized"), "title", "text", "tags", "vertical", "raw_score", "published_at", "fetched_at",
        "watch_topics", "vec", "verdict", F.lit(None).cast("string").alias("skip_reason"), F.lit(None).cast("double").alias("llm_relevance"), F.lit(None).cast("long").alias("scored_profile_version"))
    bare = T.items(spark, d)
    steps = materialize(reactions.learning_steps(T.feedback_events(spark, d), bare), "steps")
    muted = _muted(spark, d)
    learned = [materialize(x, "learned") for x in (
        reactions.tag_affinity(steps), reactions.source_affinity(steps), reactions.taste(_marks(spark, d), bare, vectors), muted)]
    active = profiles.active_profiles(T.declared_profiles(spark))
    clusters = flow.StoryClusters(spark, scratch_path(spark, "stories"))
    chain = [
        stages.personal_stage(*learned, T.as_of(), NO_BOOST), stages.base_score_stage(T.as_of()), stages.story_stage(clusters),
        stages.gate_stage(materialize(T.profile_vectors(spark, d), "profiles"), _GATE_MIN), stages.tagger_stage(lambda b: [None] * len(b)),
        stages.judge_stage(active, ["verdict"], lambda b: [None if v != v else f'{{"score": {v}}}' for v in b["verdict"]]),
    ]
    path, mark = scratch_path(spark, "processed"), flow.checkpoint_for(spark, "processed")
    for folder in _arrivals(spark, rows, "fetched_at", _THIRDS, "incoming"):
        done = flow.enrich(flow.file_stream(spark, folder, rows.schema), chain, path, mark)
    return done.read().select(
        "id", "cluster_id", c("cluster_size").alias("size"), "skip_reason", F.round("base_score", 6).alias("base_score"), "llm_relevance", F.round("personal_score", 6).alias("personal_score"))


@query("j2_dedup_ingest", "SELECT DISTINCT source_type, source_id FROM items")
def j2(spark, d):
    """Every item arrives twice; the time of an undated one is that of its arrival."""
    items = T.item_columns(_stream(spark, d, "documents"))
    twice = items.select("source_type", "source_id", c("sort_ts").cast("timestamp").alias("ts")).unionByName(
        items.select("source_type", "source_id", (c("sort_ts").cast("timestamp") + F.expr("INTERVAL 1 MINUTE")).alias("ts"))
    )
    return _finished(spark, flow.deduplicated(twice, "ts"), "deduplicated").select("source_type", "source_id")


@query(
    "j3_quarantine",
    """SELECT CASE WHEN turn % 2 = 0 THEN '{oops ' || role ELSE '{"text": "no id"}' END AS value, count(*) AS n FROM conversations WHERE (conv_id * 3 + turn) % 7 = 6 GROUP BY 1""",
)
def j3(spark, d):
    tail.register(spark)
    lines = spark.readStream.format("line_tail").option("path", _message_lines(spark, d)).load()
    bad = messages.malformed(messages.parsed(lines))
    return _finished(spark, bad, "quarantine").groupBy("value").agg(F.count("*").alias("n"))


def _arrivals(spark, rows, ts, edges, label):
    """A folder that grows by one stretch of the log at a time, in order of time: what a stream sees poll by poll."""
    folder = scratch_path(spark, label)
    edges = [F.lit(e).cast("timestamp_ntz") for e in edges]
    for a, b in zip([None, *edges], [*edges, None]):
        part = rows if a is None else rows.filter(c(ts) >= a)
        (part if b is None else part.filter(c(ts) < b)).write.mode("append").parquet(folder)
        yield folder


def _learned(spark, d, *parts):
    """The reaction log in three stretches, each learned by a run that resumes where the last one stopped."""
    events = T.table(spark, d, "events")
    path, checkpoint = scratch_path(spark, "learner"), flow.checkpoint_for(spark, "learner")
    for folder in _arrivals(spark, events, "ts", _THIRDS, "clicks"):
        clicks = T.click_columns(flow.file_stream(spark, folder, events.schema))
        learner = flow.learn(clicks, T.items(spark, d), path, checkpoint, T.vectors(spark, d), parts)
    return learner


@query("j4_streaming_learner", "SELECT vertical, tag, round(weight, 6) AS weight, n_pos, n_neg FROM tag_aff")
def j4(spark, d):
    return _learned(spark, d, "tags").affinity().withColumn("weight", F.round("weight", 6))


@query("j4_source_weights", "SELECT vertical, source_type, source_key, round(weight, 6) AS weight, n_pos, n_neg FROM source_aff")
def j4_sources(spark, d):
    return _learned(spark, d, "sources").source_affinity().withColumn("weight", F.round("weight", 6))


@query("j4_taste", "SELECT vertical, n_liked, pos - 1 AS pos, round(vec[pos], 6) AS v FROM (SELECT vertical, n_liked, vec, unnest(range(1, len(vec) + 1)) AS pos FROM taste)")
def j4_taste(spark, d):
    t = _learned(spark, d, "taste").taste()
    return t.select("vertical", "n_liked", F.posexplode("vec").alias("pos", "v")).withColumn("v", F.round("v", 6))


@query("j4_mutes", "SELECT vertical, tag FROM mutes_learned")
def j4_mutes(spark, d):
    return _learned(spark, d, "mutes").mutes()


@query(
    "j4_refine_triggers",
    """SELECT event_id, vertical, item_id, standing FROM (SELECT *, sum(CASE WHEN action = 'added' THEN 1 ELSE -1 END)
         OVER (PARTITION BY vertical ORDER BY ts, event_id)::BIGINT AS standing FROM steps) WHERE action = 'added' AND standing > 0 AND standing % 10 = 0""",
)
def j4_triggers(spark, d):
    return _learned(spark, d, "triggers").triggers()


@query(
    "j5_streaming_clusters",
    """SELECT id, min(id) OVER (PARTITION BY CASE WHEN url IS NULL THEN id::VARCHAR WHEN url LIKE 'https://github%' THEN url ELSE text_digest END) AS cluster_id FROM items""",
)
def j5(spark, d):
    return _stories(spark, d, T.items(spark, d)).select("id", "cluster_id")


@query(
    "j5_story_sizes",
    """SELECT cluster_id, count(*) AS size FROM (SELECT min(id) OVER (PARTITION BY CASE WHEN url IS NULL THEN id::VARCHAR WHEN url LIKE 'https://github%' THEN url ELSE text_digest END) AS cluster_id
       FROM items) GROUP BY cluster_id""",
)
def j5_sizes(spark, d):
    return _stories(spark, d, T.items(spark, d)).select("cluster_id", "size").distinct()


@query(
    "j6_rate_limited",
    f"""WITH RECURSIVE c AS (SELECT user_id, ts, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM clicks),
        w AS (SELECT user_id, ts, id, n, true AS sent, [ts] AS past FROM c WHERE n = 1
          UNION ALL SELECT user_id, ts, id, n, ok, CASE WHEN ok THEN list_append(past, ts) ELSE past END FROM (
            SELECT c.user_id, c.ts, c.id, c.n, w.past, len(w.past) < {K.MAX_PUSH_PER_HOUR} OR w.past[-{K.MAX_PUSH_PER_HOUR}] < c.ts - INTERVAL 1 HOUR AS ok
            FROM w JOIN c ON c.user_id = w.user_id AND c.n = w.n + 1))
        SELECT user_id, ts, id FROM w WHERE sent""",
)
def j6(spark, d):
    """Every click is a wish to push to its user; at most eight an hour go out."""
    return limiter.limited(T.feedback_events(spark, d).select("user_id", "ts", c("event_id").alias("id")))


_CAP, _CAP_MINUTES = 3, 24 * 60
_PUSH_SQL = f"""WITH RECURSIVE subs AS (SELECT DISTINCT user_id % 20 AS reader, vertical FROM clicks JOIN items ON items.id = clicks.item_id WHERE signal IN ('up', 'save') AND vertical IS NOT NULL),
        o AS (SELECT reader, processed_at AS t, id, cluster_id, row_number() OVER (PARTITION BY reader ORDER BY processed_at, id) AS n FROM items JOIN subs USING (vertical)
          WHERE processed_at IS NOT NULL AND pushed_at IS NULL AND personal_score >= CASE WHEN starts_with(feed_name, 'tw_') THEN 0.50 ELSE 0.55 END
            AND NOT (hour(processed_at) >= 22 OR hour(processed_at) < 7)),
        w AS (SELECT reader, t, id, n, true AS sent, [t] AS past, CASE WHEN cluster_id IS NULL THEN [] ELSE [cluster_id] END AS stories FROM o WHERE n = 1
          UNION ALL SELECT reader, t, id, n, ok, CASE WHEN ok THEN list_append(past, t) ELSE past END, CASE WHEN ok AND cluster_id IS NOT NULL THEN list_append(stories, cluster_id) ELSE stories END FROM (
            SELECT o.*, w.past, w.stories, (len(w.past) < {_CAP} OR w.past[-{_CAP}] < o.t - INTERVAL {_CAP_MINUTES} MINUTE) AND (o.cluster_id IS NULL OR NOT list_contains(w.stories, o.cluster_id)) AS ok
            FROM w JOIN o ON o.reader = w.reader AND o.n = w.n + 1))
        SELECT reader, id, t AS sent_at FROM w WHERE sent"""


def _offers(spark, d):
    """A reader follows the areas in which they ever liked something."""
    items = T.items(spark, d, clusters=True)
    liked = T.feedback_events(spark, d).filter(c("signal").isin(*reactions.LIKES)).select(c("item_id").alias("id"), (c("user_id") % 20).alias("reader"))
    subs = liked.join(items.filter("vertical is not null").select("id", "vertical"), "id").select("reader", "vertical").distinct()
    return push.offers(items, subs, quiet="22-7")


def _sent(df):
    return df.select("reader", "id", F.timestamp_micros("t").cast("timestamp_ntz").alias("sent_at"))


@query("c6_push_sequence", _PUSH_SQL)
def c6_sequence(spark, d):
    return _sent(push.pushes(_offers(spark, d), _CAP, _CAP_MINUTES))


@query("c6_push_stream", _PUSH_SQL)
def c6_stream(spark, d):
    """The same offers in three stretches of time, the readers' state carried by the checkpoint."""
    rows = _offers(spark, d).withColumn("ts", F.timestamp_micros("t").cast("timestamp_ntz"))
    out, mark = scratch_path(spark, "pushes"), flow.checkpoint_for(spark, "pushes")
    for folder in _arrivals(spark, rows, "ts", _THIRDS, "offers"):
        stream = push.push_stream(flow.file_stream(spark, folder, rows.schema), _CAP, _CAP_MINUTES)
        flow.run_to_table(stream, out, mark)
    return _sent(spark.read.schema(stream.schema).parquet(out))


_OUTAGE = ("TIMESTAMP '2024-01-05 06:00:00'", "TIMESTAMP '2024-01-05 13:00:00'")


@query(
    "j8_stall_alerts",
    f"""WITH hours AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', {AS_OF}, INTERVAL 1 HOUR)) AS hour),
        f AS (SELECT date_trunc('hour', fetched_at) AS hour, count(*) AS n FROM items GROUP BY 1),
        p AS (SELECT date_trunc('hour', processed_at) AS hour, count(*) AS n FROM items WHERE NOT processed_at BETWEEN {_OUTAGE[0]} AND {_OUTAGE[1]} GROUP BY 1),
        t AS (SELECT hours.hour, coalesce(f.n, 0) AS fetched, coalesce(p.n, 0) AS processed FROM hours LEFT JOIN f USING (hour) LEFT JOIN p USING (hour)),
        s AS (SELECT *, sum(processed) OVER (ORDER BY hour ROWS 1 PRECEDING) AS done, sum(fetched - processed) OVER (ORDER BY hour) AS pending FROM t),
        e AS (SELECT *, sum((done > 0)::INTEGER) OVER (ORDER BY hour) AS episode FROM s)
        SELECT hour, done::BIGINT AS done, pending::BIGINT AS pending FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY hour) AS r FROM e WHERE done = 0 AND pending >= 2) WHERE r = 1""",
)
def j8(spark, d):
    """The log with an outage: nothing was processed for some hours."""
    lost = c("processed_at").between(*(F.expr(x.replace("TIMESTAMP", "TIMESTAMP_NTZ")) for x in _OUTAGE))
    items = T.items(spark, d).withColumn("processed_at", F.when(~F.coalesce(lost, F.lit(False)), c("processed_at")))
    return monitor.stall_alerts(items, T.as_of(), "2024-01-01 00:00:00", min_pending=2)


_STALL_SQL = f"""WITH hours AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', {AS_OF}, INTERVAL 1 HOUR)) AS hour),
        f AS (SELECT date_trunc('hour', fetched_at) AS hour, count(*) AS n FROM items GROUP BY 1),
        p AS (SELECT date_trunc('hour', processed_at) AS hour, count(*) AS n FROM items WHERE NOT processed_at BETWEEN {_OUTAGE[0]} AND {_OUTAGE[1]} GROUP BY 1),
        t AS (SELECT hours.hour, coalesce(f.n, 0) AS fetched, coalesce(p.n, 0) AS processed FROM hours LEFT JOIN f USING (hour) LEFT JOIN p USING (hour)),
        s AS (SELECT *, sum(processed) OVER (ORDER BY hour ROWS 1 PRECEDING) AS done, sum(fetched - processed) OVER (ORDER BY hour) AS pending FROM t),
        e AS (SELECT *, sum((done > 0)::INTEGER) OVER (ORDER BY hour) AS episode FROM s),
        r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY hour) AS r FROM e WHERE done = 0 AND pending >= 2) WHERE r = 1)
        SELECT 'stalled' AS kind, hour, done::BIGINT AS done, pending::BIGINT AS pending FROM r
        UNION ALL SELECT 'recovered', e.hour, e.done::BIGINT, e.pending::BIGINT FROM e JOIN r ON e.episode = r.episode + 1 WHERE e.done > 0"""


@query("j8_stall_stream", _STALL_SQL)
def j8_stall(spark, d):
    """The log with an outage as it comes in, in three stretches: hours are summed by one stream and watched by another."""
    lost = c("processed_at").between(*(F.expr(x.replace("TIMESTAMP", "TIMESTAMP_NTZ")) for x in _OUTAGE))
    items = T.items(spark, d)
    log = items.select(c("fetched_at").alias("ts"), F.lit("fetched").alias("kind")).unionByName(
        items.filter("processed_at is not null").filter(~lost).select(c("processed_at").alias("ts"), F.lit("processed").alias("kind")))
    ticks = [(T.AS_OF_TEXT, "tick"), ("2024-01-31 02:00:00", "tick")]
    log = log.unionByName(spark.createDataFrame(ticks, "ts string, kind string").select(c("ts").cast("timestamp_ntz").alias("ts"), "kind"))
    hours, out = scratch_path(spark, "hours"), scratch_path(spark, "stalls")
    marks = [flow.checkpoint_for(spark, x) for x in ("hours", "stalls")]
    for folder in _arrivals(spark, log, "ts", _THIRDS, "log"):
        counts = alerts.hourly_counts(flow.file_stream(spark, folder, log.schema))
        flow.run_to_table(counts, hours, marks[0])
        stalls = alerts.stall_stream(flow.file_stream(spark, hours, counts.schema), min_pending=2)
        flow.run_to_table(stalls, out, marks[1])
    return spark.read.schema(stalls.schema).parquet(out)


@query(
    "j8_silence_stream",
    f"""WITH a AS (SELECT feed_name AS key, fetched_at AS since, lead(fetched_at) OVER (PARTITION BY feed_name ORDER BY fetched_at) AS again FROM items),
        q AS (SELECT *, since + INTERVAL {K.SILENCE_HOURS} HOUR AS due FROM a WHERE since + INTERVAL {K.SILENCE_HOURS} HOUR <= least(coalesce(again, {AS_OF}), {AS_OF}))
        SELECT key, 'silent' AS kind, since, due AS at FROM q UNION ALL SELECT key, 'recovered', since, again FROM q WHERE again IS NOT NULL""",
)
def j8_silence(spark, d):
    """Arrivals of every feed in three stretches; a tick an hour after the end lets event time reach it."""
    tick = spark.createDataFrame([("2024-01-31 01:00:00",)], "ts string").select(F.lit(None).cast("string").alias("key"), c("ts").cast("timestamp_ntz").alias("ts"))
    log = T.items(spark, d).select(c("feed_name").alias("key"), c("fetched_at").alias("ts")).unionByName(tick)
    out, mark = scratch_path(spark, "silences"), flow.checkpoint_for(spark, "silences")
    for folder in _arrivals(spark, log, "ts", _THIRDS, "arrivals"):
        stream = alerts.silence_stream(flow.file_stream(spark, folder, log.schema))
        flow.run_to_table(stream, out, mark)
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "e12_silence_episodes",
    f"""WITH a AS (SELECT feed_name AS key, fetched_at AS since, lead(fetched_at) OVER (PARTITION BY feed_name ORDER BY fetched_at) AS again FROM items),
        q AS (SELECT *, since + INTERVAL {K.SILENCE_HOURS} HOUR AS due FROM a WHERE since + INTERVAL {K.SILENCE_HOURS} HOUR <= least(coalesce(again, {AS_OF}), {AS_OF}))
        SELECT key, 'silent' AS kind, since, due AS at FROM q UNION ALL SELECT key, 'recovered', since, again FROM q WHERE again IS NOT NULL""",
)
def e12_episodes(spark, d):
    rows = T.items(spark, d).select(c("feed_name").alias("key"), c("fetched_at").alias("ts"))
    return monitor.silence_episodes(rows, T.as_of()).select("key", "kind", _ntz("since"), _ntz("at"))


_POLLS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00", "2024-01-31 00:00:00")


def _poll_sql() -> str:
    """Each poll's cutoffs follow from the cursors that the poll before it left."""
    out = """f AS (SELECT DISTINCT feed_name, CASE WHEN starts_with(feed_name, 'gh_') THEN TIMESTAMP '2024-01-05 00:00:00' END AS cursor, (len(feed_name) % 3) * 259200 AS interval_s FROM items),
        r0 AS (SELECT feed_name, cursor FROM f)"""
    for k, now in enumerate(_POLLS, 1):
        since = f"TIMESTAMP '{_POLLS[k - 2]}' - INTERVAL 2 DAY" if k > 1 else "TIMESTAMP '2000-01-01'"
        out += f""",
        c{k} AS (SELECT f.feed_name, greatest(p.cursor, TIMESTAMP '{now}' - to_seconds(greatest(f.interval_s * {K.INGEST_AGE_FACTOR}, {K.INGEST_MIN_WINDOW_HOURS} * 3600)::BIGINT)) AS cutoff FROM f JOIN r{k - 1} p USING (feed_name)),
        s{k} AS (SELECT {k} AS poll, feed_name, cutoff, count(*) FILTER (WHERE published_at IS NULL OR published_at > cutoff) AS taken, count(*) FILTER (WHERE published_at <= cutoff) AS late,
          greatest(cutoff, max(published_at)) AS new_cursor FROM items JOIN c{k} USING (feed_name) WHERE fetched_at < TIMESTAMP '{now}' AND fetched_at >= {since} GROUP BY feed_name, cutoff),
        r{k} AS (SELECT r{k - 1}.feed_name, coalesce(s{k}.new_cursor, r{k - 1}.cursor) AS cursor FROM r{k - 1} LEFT JOIN s{k} USING (feed_name))"""
    return f"WITH {out} " + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(1, len(_POLLS) + 1))


@query("j7_late_window", _poll_sql())
def j7(spark, d):
    """Three polls ten days apart, each delivering the last two days of the poll before it again, and every entry twice."""
    items = T.items(spark, d).select("feed_name", "source_type", "source_id", c("published_at").cast("timestamp").alias("published_at"), "fetched_at")
    known = items.select("feed_name").distinct().select(
        "feed_name", F.when(c("feed_name").startswith("gh_"), "2024-01-05T00:00:00").when(c("feed_name").startswith("tw_"), "broken").alias("cursor"),
        (F.length("feed_name") % 3 * 259200).cast("int").alias("interval_s"))
    path, mark, folder = scratch_path(spark, "polls"), flow.checkpoint_for(spark, "polls"), scratch_path(spark, "entries")
    before = None
    for now in _POLLS:
        seen = items.filter(c("fetched_at") < F.lit(now).cast("timestamp_ntz"))
        if before:
            seen = seen.filter(c("fetched_at") >= F.lit(before).cast("timestamp_ntz") - F.expr("INTERVAL 2 DAYS"))
        entries = seen.drop("fetched_at").withColumn("polled_at", F.lit(now).cast("timestamp"))
        entries.unionByName(entries).write.mode("append").parquet(folder)
        stream = flow.file_stream(spark, folder, entries.schema)
        if before is None:
            flow.PolledFeeds(spark, path, entries.schema).declare(known)
        polled = flow.poll_feeds(stream, path, mark)
        before = now
    number = F.array_position(F.array(*[F.lit(x).cast("timestamp") for x in _POLLS]), c("polled_at")).cast("int")
    return polled.polls.read().select(number.alias("poll"), "feed_name", _ntz("cutoff"), "taken", "late", _ntz("new_cursor"))


@query(
    "j11_daily_tag_windows",
    """SELECT date_trunc('day', sort_ts)::TIMESTAMP AS day, tag, count(*) AS n, round(avg(personal_score), 6) AS avg_score
       FROM (SELECT sort_ts, unnest(tags) AS tag, personal_score FROM visible) GROUP BY 1, 2""",
)
def j11(spark, d):
    items = T.item_columns(_stream(spark, d, "documents")).filter(R.VISIBLE)
    rows = items.select(c("sort_ts").cast("timestamp").alias("sort_ts"), "tags", "personal_score")
    done = flow.latest_windows(flow.daily_tag_counts(rows), scratch_path(spark, "windows"), flow.checkpoint_for(spark, "windows"), ["day", "tag"])
    return done.select(_ntz("day"), "tag", "n", F.round("avg_score", 6).alias("avg_score"))


_LIFTED_SQL = f"""WITH declared AS (SELECT vertical, tag FROM topics WHERE polarity = 'mute'),
        hits AS (SELECT DISTINCT id FROM (SELECT id, vertical, unnest(tags) AS tag FROM items WHERE vertical IS NOT NULL) JOIN declared USING (vertical, tag)),
        v AS (SELECT *, 0.5 * coalesce(llm_relevance, 0) + 0.2 * least(1.0, n_liked / 20::DOUBLE) * taste_cos + 0.15 * tag_aff + 0.1 * source_aff + 0.05 * fresh AS plain FROM scored_parts),
        j AS (SELECT v.id, CASE WHEN len(list_filter(v.watch_topics, lambda x: x <> 'Природные явления')) > 0 THEN least(1.0::DOUBLE, plain + 0.15) ELSE plain END AS ps FROM v
          JOIN judged i ON i.id = v.id WHERE i.processed_at IS NOT NULL AND i.personal_score IS NULL AND i.vertical IS NOT NULL AND i.llm_relevance IS NOT NULL
            AND (i.skip_reason IS NULL OR starts_with(i.skip_reason, '{K.MUTE_PREFIX}')) AND v.id NOT IN (SELECT id FROM hits))
        SELECT i.id, CASE WHEN processed_at IS NOT NULL AND (title IS NULL OR trim(title) = '') THEN 'Title of ' || feed_name ELSE title END AS title,
          round(coalesce(j.ps, i.personal_score), 6) AS personal_score, CASE WHEN j.id IS NULL THEN skip_reason END AS skip_reason, j.id IS NOT NULL AS revived FROM items i LEFT JOIN j ON j.id = i.id"""


@query("k5_jobs_write_back", _LIFTED_SQL)
def k5_jobs(spark, d):
    """The reader took back every mute made by button: items that only those muted come back, and titles that were missing are filled in,
    each job writing its columns into the table of items."""
    table = KeyedTable(spark, scratch_path(spark, "stored-items"), "id long, title string, personal_score double, skip_reason string", ["id"])
    items = T.items(spark, d, labels=True, vectors=True)
    table.merge(items.select(*table.columns), 0, lambda old, rows: rows)
    named = stages.infer(maintenance.missing_titles(items).select("id", "feed_name"), ["feed_name"], lambda b: ["Title of " + f for f in b["feed_name"]], "title")
    flow.write_back(table, named.select("id", "title"), 1)
    steps = materialize(reactions.learning_steps(T.feedback_events(spark, d), T.items(spark, d)), "steps")
    declared = profiles.muted_tags(profiles.active_profiles(T.declared_profiles(spark)), T.declared_profiles(spark).limit(0).select("vertical", F.lit("").alias("tag")))
    scores = scoring.scored(
        maintenance.mute_victims(items), reactions.tag_affinity(steps), reactions.source_affinity(steps), reactions.taste(_marks(spark, d), items, T.vectors(spark, d)), declared, T.as_of(), NO_BOOST)
    back = materialize(scores.filter("personal_score is not null").select("id", "personal_score", F.lit(None).cast("string").alias("skip_reason")), "revived")
    flow.write_back(table, back, 2)
    return table.read().join(back.select("id", F.lit(True).alias("_back")), "id", "left").select(
        "id", "title", F.round("personal_score", 6).alias("personal_score"), "skip_reason", c("_back").isNotNull().alias("revived"))


def _rolling(spark, d, period, vertical):
    """Items in three stretches by arrival, each added to the tiles; the windows end at the report's midnight."""
    rows = T.items(spark, d).select("vertical", "tags", "personal_score", "sort_ts", "fetched_at", "processed_at", "skip_reason")
    path, mark = scratch_path(spark, "tiles"), flow.checkpoint_for(spark, "tiles")
    for folder in _arrivals(spark, rows, "fetched_at", _THIRDS, "tagged"):
        tiles = flow.tile_tags(flow.file_stream(spark, folder, rows.schema), path, mark)
    t = tiles.trends(T.as_of(), period, vertical)
    return t.withColumn("strength", F.round("strength", 6)).withColumn("prev", F.round("prev", 6))


for _period, _vertical in (("day", None), ("week", "it"), ("month", None)):
    query(f"j11_rolling_{_period}", _trends_sql(_period, _vertical))(lambda spark, d, p=_period, v=_vertical: _rolling(spark, d, p, v))


_WINDOWS = (1, 7, 30)


@query(
    "e11_distinct_sketch",
    " UNION ALL ".join(
        f"SELECT {n} AS days, count(DISTINCT item_id) AS n, true AS close FROM clicks WHERE signal IN ('up', 'save') AND ts::DATE <= DATE '2024-01-30' AND ts::DATE > DATE '2024-01-30' - INTERVAL {n} DAY"
        for n in _WINDOWS),
)
def e11_sketch(spark, d):
    """Distinct items liked in the last days: exact, and whether the merged sketches are within three standard errors of it."""
    liked = T.feedback_events(spark, d).filter(c("signal").isin(*reactions.LIKES))
    sketches = materialize(reactions.daily_sketches(liked, "item_id"), "sketches")
    last, out = F.lit("2024-01-30").cast("date"), None
    for n in _WINDOWS:
        day = F.to_date("ts")
        exact = liked.filter((day <= last) & (day > F.date_sub(last, n))).agg(F.countDistinct("item_id").alias("n"))
        near = F.abs(c("estimate") - c("n")) <= F.greatest(F.lit(1.0), 3 * reactions.SKETCH_ERROR * c("n"))
        row = reactions.distinct_in(sketches, last, n).withColumn("n", exact.scalar()).select("days", "n", near.alias("close"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "d9_wiki_replay",
    "SELECT i.id FROM items i WHERE i.id IN (SELECT item_id FROM marks WHERE signal IN ('up', 'save')) AND (coalesce(title, '') <> '' OR coalesce(text, '') <> '')",
)
def wiki_replay(spark, d):
    liked = reactions.per_item(_marks(spark, d)).select(c("item_id").alias("id"))
    has_text = (F.coalesce("title", F.lit("")) != "") | (F.coalesce("text", F.lit("")) != "")
    return T.items(spark, d).filter(has_text).join(liked, "id", "left_semi").select("id")


@query(
    "k4_batch_inference",
    "SELECT id, len(text) AS answer FROM items WHERE title IS NULL AND processed_at IS NOT NULL",
)
def k4(spark, d):
    """A stand-in model that measures its input, called once per Arrow batch for the items that need it."""
    todo = T.items(spark, d).filter("title is null and processed_at is not null").select("id", "text")
    return stages.infer(todo, ["text"], lambda b: [len(t) for t in b["text"]], "answer", "long").select("id", "answer")
