"""Registered queries: filters, joins, aggregates, windows, ranking and monitoring over the item and reaction tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import scores as S
from storyloom.functions import text as X
from storyloom.functions import urls as U
from storyloom.operators import cards, dedup, feeds, maintenance, monitor, profiles, reactions, retrieval, scoring, watch
from storyloom.operators.feeds import FeedRequest
from storyloom.plans import tables as T
from storyloom.plans.catalog_text import BUCKET_SQL
from storyloom.plans.registry import AS_OF, query
from storyloom.session import materialize

c = F.col
NO_BOOST = ("Природные явления",)
# every page is asked for over the whole table; the limits below are those of the feeds themselves
PAGE = 50


def joined(col: str):
    return F.array_join(col, ",").alias(col)


# --- filters -----------------------------------------------------------------------------------------------------

_FILTERS = FeedRequest(
    category="en", source_types=("rss", "manual"), feed_prefix="src", vertical="it", since="2024-01-03 00:00:00",
    min_score=0.2, min_insight=0.1, has_watch=True,
)


@query(
    "c1_feed_filters",
    """SELECT id FROM visible WHERE category = 'en' AND source_type IN ('rss', 'manual') AND starts_with(feed_name, 'src')
       AND vertical = 'it' AND published_at >= TIMESTAMP '2024-01-03 00:00:00' AND raw_score >= 0.2 AND insight_score >= 0.1 AND len(watch_topics) > 0""",
)
def c1(spark, d):
    return feeds.feed_filter(T.items(spark, d), _FILTERS).select("id")


@query(
    "c2_kind_counts",
    """SELECT kind, count(*) AS n FROM (SELECT unnest(list_filter(['all', 'other',
         CASE WHEN starts_with(feed_name, 'tw_') THEN 'twitter' END, vertical, CASE WHEN len(watch_topics) > 0 THEN 'watch' END], lambda x: x IS NOT NULL)) AS kind FROM items) GROUP BY kind""",
)
def c2(spark, d):
    kinds = ["all", "twitter", *K.VERTICALS, "watch", "other"]
    hits = F.array_compact(F.array(*[F.when(feeds.kind_filter(k), F.lit(k)) for k in kinds]))
    return T.items(spark, d).select(F.explode(hits).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


WATCH = [("Ing", ["inging", "oned the"]), ("Éau", ["éau", "eau/x"]), ("Of the", ["of the", "de la"]), ("None", ["zzz9"]), ("Ent", ["ent"])]


@query(
    "c3_watch_topics",
    """SELECT id, array_to_string(list_filter([CASE WHEN regexp_matches(h, '(^|[^\\p{L}\\p{N}_])inging') OR contains(h, 'oned the') THEN 'Ing' END,
         CASE WHEN regexp_matches(h, '(^|[^\\p{L}\\p{N}_])éau') OR contains(h, 'eau/x') THEN 'Éau' END,
         CASE WHEN contains(h, 'of the') OR contains(h, 'de la') THEN 'Of the' END,
         CASE WHEN regexp_matches(h, '(^|[^\\p{L}\\p{N}_])ent') THEN 'Ent' END], lambda x: x IS NOT NULL), ',') AS topics
       FROM (SELECT id, lower(substring(coalesce(title, '') || ' ' || text, 1, 4000)) AS h FROM items)""",
)
def c3(spark, d):
    return T.items(spark, d).select("id", F.array_join(watch.match_topics(c("title"), c("text"), WATCH), ",").alias("topics"))


_GATE_MIN = 0.1


@query(
    "c4_relevance_gate",
    f"""SELECT id, CASE WHEN skip THEN 'skip' ELSE 'pass' END AS gate, CASE WHEN skip THEN 'низкая близость к профилям: ' || printf('%.2f', sim) || ' (ближе всего ' || vertical || ')' END AS reason
       FROM (SELECT i.id, b.sim, b.vertical, coalesce(len(watch_topics) = 0 AND source_type <> 'manual' AND b.sim < {_GATE_MIN}, false) AS skip
         FROM items i LEFT JOIN (SELECT v.id, max(list_cosine_similarity(v.vec, p.vec)) AS sim, max_by(p.vertical, list_cosine_similarity(v.vec, p.vec)) AS vertical
           FROM vecs v, profile_vecs p GROUP BY v.id) b ON b.id = i.id)""",
)
def c4(spark, d):
    g = scoring.gated(T.items(spark, d, vectors=True), T.profile_vectors(spark, d), _GATE_MIN)
    return g.select("id", "gate", c("gate_reason").alias("reason"))


def _muted(spark, d):
    return profiles.muted_tags(profiles.active_profiles(T.declared_profiles(spark)), reactions.learned_mutes(T.feedback_events(spark, d), T.items(spark, d)))


@query(
    "c5_hard_mute",
    f"""SELECT i.id, CASE WHEN i.vertical IS NULL THEN skip_reason WHEN h.muted_tag IS NOT NULL THEN '{K.MUTE_PREFIX}' || h.muted_tag
          WHEN starts_with(skip_reason, '{K.MUTE_PREFIX}') THEN NULL ELSE skip_reason END AS skip_reason
        FROM items i LEFT JOIN muted_hits h ON h.id = i.id""",
)
def c5(spark, d):
    return scoring.apply_mutes(T.items(spark, d), _muted(spark, d)).select("id", "skip_reason")


# a story goes out once: the first of its eligible members to be processed marks it as sent
_FIRST_SQL = "QUALIFY row_number() OVER (PARTITION BY cluster_id IS NULL, coalesce(cluster_id, id) ORDER BY processed_at NULLS LAST, id) = 1"
_SENT_SQL = "EXISTS (SELECT 1 FROM items o WHERE o.cluster_id = i.cluster_id AND o.id <> i.id AND o.{f} IS NOT NULL)"


@query(
    "c6_push_candidates",
    f"""SELECT id FROM items i WHERE personal_score IS NOT NULL AND pushed_at IS NULL AND vertical IN ('it', 'medical')
        AND personal_score >= CASE WHEN starts_with(feed_name, 'tw_') THEN 0.50 ELSE 0.55 END AND processed_at IS NOT NULL
        AND NOT (hour(processed_at) >= 22 OR hour(processed_at) < 7) AND NOT {_SENT_SQL.format(f='pushed_at')} {_FIRST_SQL}""",
)
def c6(spark, d):
    return scoring.push_candidates(T.items(spark, d, clusters=True), ("it", "medical"), quiet="22-7").select("id")


@query(
    "c7_channel_candidates",
    f"""SELECT id FROM items i WHERE personal_score >= 0.60 AND channel_posted_at IS NULL AND source_type <> 'manual'
        AND NOT {_SENT_SQL.format(f='channel_posted_at')} {_FIRST_SQL}""",
)
def c7(spark, d):
    return scoring.channel_candidates(T.items(spark, d, clusters=True)).select("id")


@query(
    "c8_star_candidates",
    """SELECT id FROM items WHERE star_posted_at IS NULL AND (source_type = 'manual' OR vertical = 'it')
       AND id IN (SELECT item_id FROM actions WHERE signal = 'save' AND action = 'added')""",
)
def c8(spark, d):
    return scoring.star_candidates(reactions.with_actions(T.feedback_events(spark, d)), T.items(spark, d)).select("id")


_STALE_SQL = "processed_at IS NOT NULL AND (embedding_version IS NULL OR embedding_version < 1 OR embedding_model <> 'm1')"


@query("c9_stale_vectors", f"SELECT id FROM items WHERE {_STALE_SQL} ORDER BY id DESC LIMIT 300")
def c9(spark, d):
    return maintenance.stale_vectors(T.items(spark, d), "m1", 1, 300)


@query("c9_stale_vector_count", f"SELECT count(*) AS n FROM items WHERE {_STALE_SQL}")
def c9_count(spark, d):
    return maintenance.stale_vectors(T.items(spark, d), "m1", 1).agg(F.count("*").alias("n"))


@query(
    "c10_text_rewrite",
    """SELECT i.id, CASE WHEN p.page_id IS NULL OR p.html = i.text THEN embedding_version END AS embedding_version,
         len(coalesce(p.html, i.text)) AS n_chars FROM items i LEFT JOIN pages p ON p.page_id = i.id""",
)
def c10(spark, d):
    new = T.table(spark, d, "pages").select(c("page_id").alias("id"), c("html").alias("text"))
    return maintenance.rewrite_texts(T.items(spark, d), new).select("id", "embedding_version", F.length("text").alias("n_chars"))


@query(
    "c11_retry_backlog",
    f"""WITH w AS (SELECT * FROM items WHERE processed_at IS NULL AND fetched_at < {AS_OF} - INTERVAL 5 MINUTE)
        SELECT id, line, {AS_OF} + INTERVAL 30 MINUTE AS retry_after FROM (
          (SELECT id, 'normal' AS line FROM w WHERE attempts < 5 AND (retry_after IS NULL OR retry_after < {AS_OF}) ORDER BY id DESC LIMIT 500)
          UNION ALL (SELECT id, 'recovery' FROM w WHERE attempts >= 5 AND attempts < 20 AND (retry_after IS NULL OR retry_after < {AS_OF} - INTERVAL 30 MINUTE) ORDER BY id LIMIT 50))""",
)
def c11(spark, d):
    return maintenance.retry_backlog(T.items(spark, d), T.as_of())


@query(
    "c12_failure_backoff",
    f"""SELECT id, attempts + 1 AS attempts, {AS_OF} + to_minutes(least(pow(2, attempts), 60)::INTEGER) AS retry_after,
          least(pow(2, greatest(attempts, 1)) * 30, 3600)::BIGINT AS redelivery_s FROM items WHERE processed_at IS NULL""",
)
def c12(spark, d):
    return maintenance.failed(T.items(spark, d).filter("processed_at is null"), T.as_of())


@query(
    "c13_manual_items",
    """SELECT id, 'https://feeds.example.com/item/' || text_digest || '?a=1&b=2' AS item_key FROM items
       WHERE source_type = 'manual' AND url LIKE 'https://www.Feeds%'
       UNION ALL SELECT id, url FROM items WHERE source_type = 'manual' AND url NOT LIKE 'https://www.Feeds%'""",
)
def c13(spark, d):
    m = T.items(spark, d).filter("source_type = 'manual' and url is not null")
    return m.select("id", F.coalesce(U.normalize_url(c("url")), "url").alias("item_key"))


_CYR_TEXT_SQL = "CASE WHEN id % 3 = 0 THEN repeat('привет мир ', 60) || text ELSE text END"


@query(
    "c14_language_mismatch",
    f"""SELECT id FROM (SELECT id, summary, {_CYR_TEXT_SQL} AS t FROM items) WHERE trim(summary) <> ''
        AND len(regexp_replace(t, '[^а-яёА-ЯЁ]', '', 'g')) > 40 AND len(regexp_replace(summary, '[^а-яёА-ЯЁ]', '', 'g')) < 5
        AND len(regexp_replace(t, '[^а-яёА-ЯЁ]', '', 'g')) * 3 >= len(regexp_replace(t, '[^a-zA-Z]', '', 'g'))""",
)
def c14(spark, d):
    t = F.when(c("id") % 3 == 0, F.concat(F.repeat(F.lit("привет мир "), F.lit(60)), "text")).otherwise(c("text"))
    return maintenance.language_mismatch(T.items(spark, d).withColumn("text", t)).select("id")


@query(
    "c15_short_repo_texts",
    f"""SELECT id, url, len(text) AS n_chars FROM items WHERE starts_with(feed_name, 'gh_') AND url LIKE '%github.com/%' AND len(text) < 400
        AND fetched_at > {AS_OF} - INTERVAL 60 DAY ORDER BY fetched_at DESC, id DESC LIMIT 500""",
)
def c15(spark, d):
    return maintenance.short_repo_texts(T.items(spark, d), T.as_of())


@query(
    "c16_missing_titles",
    """SELECT id, title IS NULL OR trim(title) = '' AS is_empty FROM items WHERE processed_at IS NOT NULL
       AND (title IS NULL OR trim(title) = '' OR source_type = 'telegram' OR starts_with(feed_name, 'tw_'))""",
)
def c16(spark, d):
    m = maintenance.missing_titles(T.items(spark, d), "regen")
    return m.select("id", (c("title").isNull() | (F.trim("title") == "")).alias("is_empty"))


@query(
    "c17_mute_victims",
    f"""SELECT id FROM judged WHERE processed_at IS NOT NULL AND personal_score IS NULL AND vertical IS NOT NULL AND llm_relevance IS NOT NULL
        AND (skip_reason IS NULL OR starts_with(skip_reason, '{K.MUTE_PREFIX}'))""",
)
def c17(spark, d):
    return maintenance.mute_victims(T.items(spark, d, labels=True)).select("id")


# --- joins --------------------------------------------------------------------------------------------------------


@query(
    "d1_url_clusters",
    """SELECT id, min(id) OVER w AS cluster_id, first_value(id) OVER (w ORDER BY fetched_at, id) AS representative_id, count(*) OVER w AS size
       FROM (SELECT *, CASE WHEN url IS NULL THEN id::VARCHAR WHEN url LIKE 'https://github%' THEN url ELSE text_digest END AS k FROM items)
       WINDOW w AS (PARTITION BY k)""",
)
def d1(spark, d):
    return dedup.assign_by(T.items(spark, d), U.normalize_url(c("url"))).select("id", "cluster_id", "representative_id", "size")


@query(
    "d4_nearest_profile",
    """SELECT v.id, round(max(list_cosine_similarity(v.vec, p.vec)), 6) AS best_sim, max_by(p.vertical, list_cosine_similarity(v.vec, p.vec)) AS best_vertical
       FROM vecs v, profile_vecs p GROUP BY v.id""",
)
def d4(spark, d):
    n = scoring.nearest_profile(T.vectors(spark, d), T.profile_vectors(spark, d))
    return n.select("id", F.round("best_sim", 6).alias("best_sim"), "best_vertical")


def _steps(spark, d):
    return reactions.learning_steps(T.feedback_events(spark, d), T.items(spark, d))


@query("d5_tag_affinity_lookup", "SELECT id, round(coalesce(tag_aff, 0), 6) AS tag_aff FROM items LEFT JOIN tag_parts USING (id)")
def d5(spark, d):
    i = T.items(spark, d)
    part = scoring.tag_component(i, reactions.tag_affinity(_steps(spark, d)))
    return i.select("id").join(part, "id", "left").select("id", F.round(S.zero(c("tag_aff")), 6).alias("tag_aff"))


@query(
    "d6_source_affinity_lookup",
    """SELECT i.id, round(coalesce(s.weight, 0), 6) AS source_aff FROM items i LEFT JOIN source_aff s
       ON s.vertical = i.vertical AND s.source_type = i.source_type AND s.source_key = i.feed_name""",
)
def d6(spark, d):
    w = scoring.with_source_component(T.items(spark, d), reactions.source_affinity(_steps(spark, d)))
    return w.select("id", F.round("source_aff", 6).alias("source_aff"))


def _marks(spark, d):
    return reactions.current_marks(T.feedback_events(spark, d))


@query("d7_taste_lookup", "SELECT id, round(taste_cos, 6) AS taste_cos, n_liked FROM scored_parts")
def d7(spark, d):
    t = reactions.taste(_marks(spark, d), T.items(spark, d), T.vectors(spark, d))
    return scoring.with_taste_component(T.items(spark, d, vectors=True), t).select("id", F.round("taste_cos", 6).alias("taste_cos"), "n_liked")


_SAVED_SQL = """
  SELECT i.*, m.marked_at, m.signals FROM items i JOIN (
    SELECT item_id, max(marked_at) AS marked_at, list_sort(list(DISTINCT signal)) AS signals FROM marks WHERE signal IN ('up', 'save') GROUP BY item_id) m ON m.item_id = i.id"""


@query("d8_saved_items", f"SELECT id, marked_at, array_to_string(signals, ',') AS signals FROM ({_SAVED_SQL})")
def d8(spark, d):
    s = feeds.saved(T.items(spark, d), _marks(spark, d), reactions.LIKES, limit=None)
    return s.select("id", "marked_at", joined("signals"))


@query("d9_saved_semi_join", "SELECT id FROM visible WHERE id IN (SELECT item_id FROM marks WHERE signal IN ('up', 'save'))")
def d9(spark, d):
    liked = _marks(spark, d).filter(c("signal").isin(*reactions.LIKES)).select(c("item_id").alias("id"))
    return T.items(spark, d).filter(feeds.VISIBLE).join(liked, "id", "left_semi").select("id")


def _trend_sql(period: str, vertical: str | None = None) -> str:
    h, base, div, minimum = K.TREND_PERIODS[period]
    where = f" AND vertical = '{vertical}'" if vertical else ""
    broad = ", ".join(f"'{t}'" for t in K.BROAD_TAGS)
    return f"""
      SELECT cur.tag, cur.n AS count, coalesce(base.p, 0) AS prev, cur.s AS avg_score FROM
        (SELECT tag, count(*) AS n, avg(personal_score) AS s FROM (SELECT unnest(tags) AS tag, personal_score FROM visible
          WHERE personal_score IS NOT NULL{where} AND sort_ts > {AS_OF} - INTERVAL {h} HOUR) GROUP BY tag) cur
        LEFT JOIN (SELECT tag, count(*) / {div}::DOUBLE AS p FROM (SELECT unnest(tags) AS tag FROM visible
          WHERE sort_ts <= {AS_OF} - INTERVAL {h} HOUR{where} AND sort_ts > {AS_OF} - INTERVAL {h + base} HOUR) GROUP BY tag) base USING (tag)
      WHERE cur.n >= {minimum} AND lower(cur.tag) NOT IN ({broad})"""


@query("d10_tag_current_vs_base", f"SELECT tag, count, round(prev, 6) AS prev, round(avg_score, 6) AS avg_score FROM ({_trend_sql('week')})")
def d10(spark, d):
    w = feeds.tag_windows(T.items(spark, d), T.as_of(), "week").filter((c("count") >= 5) & ~F.lower("tag").isin(*K.BROAD_TAGS))
    return w.select("tag", "count", F.round("prev", 6).alias("prev"), F.round("avg_score", 6).alias("avg_score"))


@query(
    "d11_cluster_size",
    "SELECT id, CASE WHEN cluster_id IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY cluster_id) END AS cluster_size FROM items",
)
def d11(spark, d):
    return scoring.with_cluster_size(T.items(spark, d, clusters=True)).select("id", "cluster_size")


@query("d12_cluster_sent", f"SELECT id, {_SENT_SQL.format(f='pushed_at')} AS sent FROM items i")
def d12(spark, d):
    return scoring.with_cluster_sent(T.items(spark, d, clusters=True), "pushed_at").select("id", c("cluster_sent").alias("sent"))


@query(
    "d13_attached_signals",
    """SELECT i.id, coalesce(f.feedback, '') AS feedback FROM visible i LEFT JOIN
       (SELECT item_id, array_to_string(list_sort(list(signal)), ',') AS feedback FROM marks GROUP BY item_id) f ON f.item_id = i.id""",
)
def d13(spark, d):
    page = T.items(spark, d).filter(feeds.VISIBLE).select("id")
    return feeds.attach_signals(page, _marks(spark, d)).select("id", joined("feedback"))


@query(
    "d14_learnable_counts",
    """SELECT i.vertical, count(*) AS n FROM marks m JOIN items i ON i.id = m.item_id
       WHERE m.signal IN ('up', 'down', 'save') AND i.vertical IS NOT NULL GROUP BY i.vertical""",
)
def d14(spark, d):
    return reactions.learnable_counts(_marks(spark, d), T.items(spark, d))


@query(
    "d14_recent_reactions",
    """SELECT m.item_id, m.signal, m.signal <> 'down' AS liked, m.marked_at FROM marks m JOIN items i ON i.id = m.item_id
       WHERE i.vertical = 'it' AND m.signal IN ('up', 'down', 'save') ORDER BY marked_at DESC, item_id DESC, signal LIMIT 14""",
)
def d14_recent(spark, d):
    return reactions.recent_reactions(_marks(spark, d), T.items(spark, d), "it").select("item_id", "signal", "liked", "marked_at")


@query(
    "d15_to_judge",
    "SELECT j.id FROM judged j JOIN active a ON a.vertical = j.vertical WHERE llm_relevance IS NULL OR scored_profile_version <> a.version",
)
def d15(spark, d):
    return scoring.to_judge(T.items(spark, d, labels=True), profiles.active_profiles(T.declared_profiles(spark))).select("id")


# Declared profiles are a fixed dimension; the queries below read them together with the tables, so that work follows the
# tables: how many items each declared or edited topic touches.


def _touch(spark, d):
    return (
        T.items(spark, d).filter("vertical is not null").select("vertical", F.explode("tags").alias("tag"))
        .groupBy("vertical", "tag").agg(F.count("*").alias("n_items"))
    )


_TOUCH_SQL = "(SELECT vertical, tag, count(*) AS n_items FROM (SELECT vertical, unnest(tags) AS tag FROM items WHERE vertical IS NOT NULL) GROUP BY vertical, tag)"


@query(
    "d16_declaration_diff",
    f"""SELECT x.vertical, x.kind, x.tag, x.old_polarity, x.new_polarity, coalesce(t.n_items, 0) AS n_items FROM (
          SELECT vertical, change AS kind, tag, old_polarity, new_polarity FROM topic_changes WHERE change <> 'same'
          UNION ALL SELECT a.vertical, 'description', NULL, NULL, NULL FROM active a JOIN edited e ON e.vertical = a.vertical
            WHERE trim(regexp_replace(a.description, '\\s+', ' ', 'g')) <> trim(regexp_replace(e.description, '\\s+', ' ', 'g'))) x
        LEFT JOIN {_TOUCH_SQL} t ON t.vertical = x.vertical AND t.tag = x.tag""",
)
def d16(spark, d):
    diff = profiles.declaration_diff(profiles.active_profiles(T.declared_profiles(spark)), T.edited_profiles(spark))
    return diff.join(_touch(spark, d), ["vertical", "tag"], "left").na.fill(0, ["n_items"])


def _scored(spark, d):
    items = T.items(spark, d, labels=True, vectors=True)
    steps, bare = materialize(_steps(spark, d), "steps"), T.items(spark, d)  # numbered once, read by both weights
    return scoring.scored(
        items, reactions.tag_affinity(steps), reactions.source_affinity(steps),
        reactions.taste(_marks(spark, d), bare, T.vectors(spark, d)), _muted(spark, d), T.as_of(), NO_BOOST,
    )


@query(
    "d17_score_explanation",
    """SELECT id, round(coalesce(llm_relevance, 0), 6) AS llm, round(taste_cos, 6) AS taste, round(tag_aff, 6) AS tag, round(source_aff, 6) AS source,
         round(fresh, 6) AS fresh, muted_tag, round(ps, 6) AS personal_score FROM scored""",
)
def d17(spark, d):
    r = lambda x, n: F.round(x, 6).alias(n)
    return _scored(spark, d).select(
        "id", r(S.zero(c("llm_relevance")), "llm"), r(c("taste_cos"), "taste"), r(c("tag_aff"), "tag"), r(c("source_aff"), "source"),
        r(c("fresh"), "fresh"), "muted_tag", r(c("personal_score"), "personal_score"),
    )


# what an earlier digest showed: every fifth reaction's item is remembered, newest first
_SEEN_SQL = "SELECT item_id AS id, row_number() OVER (ORDER BY last DESC, item_id) AS pos FROM (SELECT item_id, max(ts) AS last FROM clicks WHERE user_id % 5 = 0 GROUP BY item_id)"


def _seen(spark, d):
    # clicks hit at most a few items per user group; grouped first, then numbered
    seen = T.feedback_events(spark, d).filter("user_id % 5 = 0").groupBy("item_id").agg(F.max("ts").alias("last"))
    seen = seen.orderBy(F.desc("last"), "item_id").limit(K.DIGEST_SEEN_KEEP)
    return seen.select(c("item_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("last"), "item_id")).alias("pos"))


_COLLAPSE = "row_number() OVER (PARTITION BY {by}cluster_id IS NULL, coalesce(cluster_id, id) ORDER BY {order}) = 1"
_PERSONAL = "personal_score DESC NULLS LAST, id DESC"


def _top_sql(hours: int, limit: int, extra: str = "") -> str:
    return f"""SELECT id, round(personal_score, 6) AS personal_score FROM (SELECT *, {_COLLAPSE.format(by='', order=_PERSONAL)} AS first FROM visible
      WHERE personal_score IS NOT NULL AND sort_ts > {AS_OF} - INTERVAL {hours} HOUR{extra}) WHERE first ORDER BY {_PERSONAL} LIMIT {limit}"""


def _top(df):
    return df.select("id", F.round("personal_score", 6).alias("personal_score"))


@query("d18_digest_exclude", _top_sql(168, 12, f" AND id NOT IN (SELECT id FROM ({_SEEN_SQL}) WHERE pos <= 80)"))
def d18(spark, d):
    return _top(feeds.top_of_period(T.items(spark, d, clusters=True), T.as_of(), 168, 12, exclude=_seen(spark, d)))


@query(
    "d18_digest_memory",
    f"""SELECT id, age, pos FROM (
          SELECT id, 0 AS age, row_number() OVER (ORDER BY {_PERSONAL}) AS pos FROM ({_top_sql(168, 12, f" AND id NOT IN (SELECT id FROM ({_SEEN_SQL}) WHERE pos <= 80)").replace('round(personal_score, 6) AS personal_score', 'personal_score')})
          UNION ALL SELECT id, 1, pos FROM ({_SEEN_SQL}) WHERE pos <= 80) ORDER BY age, pos LIMIT 80""",
)
def d18_memory(spark, d):
    seen = _seen(spark, d)
    top = feeds.top_of_period(T.items(spark, d, clusters=True), T.as_of(), 168, 12, exclude=seen)
    return feeds.next_seen(top, seen)


@query(
    "d19_card_evaluation",
    """SELECT mode, count(*) AS n FROM (SELECT CASE WHEN len(t) >= 600 THEN 'full' WHEN len(t) >= 60 THEN 'brief' ELSE 'bare' END AS mode
         FROM (SELECT trim(i.text, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM marks m JOIN items i ON i.id = m.item_id WHERE m.signal = 'save' AND i.vertical = 'it')) GROUP BY mode""",
)
def d19(spark, d):
    return cards.mode_counts(cards.evaluation_set(_marks(spark, d), T.items(spark, d), "it", None))


# --- aggregates ----------------------------------------------------------------------------------------------------


def _trends(period, vertical, spark, d):
    t = feeds.trends(T.items(spark, d), T.as_of(), period, vertical)
    return t.withColumn("strength", F.round("strength", 6)).withColumn("prev", F.round("prev", 6))


def _trends_sql(period: str, vertical: str | None = None) -> str:
    g = "CASE WHEN prev > 0 THEN (count - prev) / prev WHEN count > 0 THEN 2.0 ELSE 0.0 END"
    return f"""SELECT tag, count, round(prev, 6) AS prev, round(least(g, 9.99), 2) AS growth, round(avg_score, 3) AS avg_score,
        CASE WHEN g >= 0.25 THEN '↑' WHEN g <= -0.25 THEN '↓' ELSE '→' END AS direction,
        round(pow(count, 0.6) * pow(least(greatest(1 + g, 0.1), 4), 1.5) * (0.4 + 0.6 * coalesce(avg_score, 0)), 6) AS strength
      FROM (SELECT *, {g} AS g FROM ({_trend_sql(period, vertical)})) ORDER BY strength DESC, tag LIMIT 8"""


for _period, _vertical in (("day", None), ("week", "it"), ("month", None)):
    query(f"e1_trends_{_period}", _trends_sql(_period, _vertical))(
        lambda spark, d, p=_period, v=_vertical: _trends(p, v, spark, d)
    )


@query(
    "e2_growth_measures",
    f"""SELECT tag, round(g, 6) AS growth, CASE WHEN g >= 0.25 THEN '↑' WHEN g <= -0.25 THEN '↓' ELSE '→' END AS direction FROM (
         SELECT tag, CASE WHEN b > 0 THEN (a - b) / b::DOUBLE WHEN a > 0 THEN 2.0 ELSE 0.0 END AS g FROM (
           SELECT tag, count(*) FILTER (WHERE sort_ts > {AS_OF} - INTERVAL 360 HOUR) AS a, count(*) FILTER (WHERE sort_ts <= {AS_OF} - INTERVAL 360 HOUR) AS b
           FROM (SELECT unnest(tags) AS tag, sort_ts FROM items) GROUP BY tag))""",
)
def e2(spark, d):
    recent = feeds.since_hours(T.as_of(), 360)
    t = T.items(spark, d).select(F.explode("tags").alias("tag"), recent.alias("recent")).groupBy("tag").agg(
        F.count_if("recent").alias("a"), F.count_if(~c("recent")).alias("b")
    )
    return t.select("tag", F.round(S.growth(c("a"), c("b")), 6).alias("growth"), S.direction(c("a"), c("b")).alias("direction"))


@query(
    "e3_totals",
    f"""SELECT count(*) FILTER (WHERE processed_at IS NOT NULL AND vertical IS NOT NULL) AS processed, count(*) FILTER (WHERE processed_at IS NULL) AS pending,
          count(*) FILTER (WHERE pushed_at IS NOT NULL) AS pushed, count(*) FILTER (WHERE processed_at > {AS_OF} - INTERVAL 60 MINUTE) AS last_hour,
          count(*) FILTER (WHERE processed_at > {AS_OF} - INTERVAL 10 MINUTE) AS last_10m, count(*) FILTER (WHERE skip_reason IS NOT NULL) AS skipped FROM items""",
)
def e3(spark, d):
    return monitor.totals(T.items(spark, d), T.as_of())


@query(
    "e4_group_counts",
    f"""WITH g AS (
          SELECT 'vertical' AS grouping, vertical AS key FROM items WHERE vertical IS NOT NULL
          UNION ALL SELECT 'source', {BUCKET_SQL} FROM items WHERE processed_at IS NOT NULL AND vertical IS NOT NULL
          UNION ALL SELECT 'feed_last_hour', feed_name FROM items WHERE processed_at > {AS_OF} - INTERVAL 60 MINUTE
          UNION ALL SELECT 'feed', feed_name FROM items WHERE processed_at IS NOT NULL
          UNION ALL SELECT 'skipped', coalesce(feed_name, source_type) FROM items WHERE skip_reason IS NOT NULL
          UNION ALL SELECT 'watch', unnest(watch_topics) FROM items WHERE processed_at IS NOT NULL),
        n AS (SELECT grouping, key, count(*) AS n FROM g GROUP BY grouping, key)
        SELECT grouping, key, n FROM (SELECT *, row_number() OVER (PARTITION BY grouping ORDER BY n DESC, key) AS r FROM n)
        WHERE r <= CASE grouping WHEN 'feed_last_hour' THEN 10 WHEN 'feed' THEN 30 WHEN 'skipped' THEN 8 ELSE 1000000 END""",
)
def e4(spark, d):
    return monitor.group_counts(T.items(spark, d), T.as_of())


@query(
    "e5_precision",
    """SELECT up, down, muted, round(up / (up + down)::DOUBLE, 6) AS precision FROM (SELECT count(*) FILTER (WHERE signal IN ('up', 'save')) AS up,
         count(*) FILTER (WHERE signal = 'down') AS down, count(*) FILTER (WHERE signal = 'mute_topic') AS muted FROM marks)""",
)
def e5(spark, d):
    return reactions.precision(_marks(spark, d)).withColumn("precision", F.round("precision", 6))


@query("e5_signal_counts", "SELECT signal, count(*) AS n FROM marks GROUP BY signal")
def e5_counts(spark, d):
    return reactions.counts_by_signal(_marks(spark, d))


@query("e6_tag_affinity", "SELECT vertical, tag, round(weight, 6) AS weight, n_pos, n_neg FROM tag_aff")
def e6(spark, d):
    return reactions.tag_affinity(_steps(spark, d)).withColumn("weight", F.round("weight", 6))


@query("e6_source_affinity", "SELECT vertical, source_type, source_key, round(weight, 6) AS weight, n_pos, n_neg FROM source_aff")
def e6_source(spark, d):
    return reactions.source_affinity(_steps(spark, d)).withColumn("weight", F.round("weight", 6))


_SEED_SQL = "CASE polarity WHEN 'love' THEN 0.8 WHEN 'like' THEN 0.5 WHEN 'dislike' THEN -0.5 WHEN 'mute' THEN -1.0 ELSE 0.0 END"


@query(
    "e6_seeded_affinity",
    f"""SELECT vertical, tag, round(coalesce(s.seed, 0) * pow(0.9::DOUBLE, coalesce(n_pos + n_neg, 0)) + coalesce(a.weight, 0), 6) AS weight,
          coalesce(n_pos, 0) AS n_pos, coalesce(n_neg, 0) AS n_neg
        FROM tag_aff a FULL JOIN (SELECT vertical, tag, ({_SEED_SQL})::DOUBLE AS seed FROM topics) s USING (vertical, tag)""",
)
def e6_seeded(spark, d):
    seeds = profiles.profile_seeds(profiles.active_profiles(T.declared_profiles(spark)))
    return reactions.tag_affinity(_steps(spark, d), seeds).withColumn("weight", F.round("weight", 6))


@query(
    "e7_taste_centroid",
    "SELECT vertical, n_liked, pos - 1 AS pos, round(vec[pos], 6) AS v FROM (SELECT vertical, n_liked, vec, unnest(range(1, len(vec) + 1)) AS pos FROM taste)",
)
def e7(spark, d):
    t = reactions.taste(_marks(spark, d), T.items(spark, d), T.vectors(spark, d))
    return t.select("vertical", "n_liked", F.posexplode("vec").alias("pos", "v")).withColumn("v", F.round("v", 6))


@query(
    "e8_base_score",
    f"""SELECT id, round(exp(-greatest(coalesce(date_diff('second', published_at, {AS_OF}) / 3600::DOUBLE, 24), 0) / 48) * (1 + coalesce(raw_score, 0)) * (1 + ln(size)), 6) AS base_score
        FROM (SELECT *, CASE WHEN cluster_id IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY cluster_id) END AS size FROM items)""",
)
def e8(spark, d):
    return scoring.base_scored(T.items(spark, d, clusters=True), T.as_of()).select("id", F.round("base_score", 6).alias("base_score"))


@query("e9_personal_score", "SELECT id, round(ps, 6) AS personal_score FROM scored")
def e9(spark, d):
    return _top(_scored(spark, d))


@query(
    "e10_top_tags",
    f"""SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM items WHERE vertical = 'it' AND processed_at > {AS_OF} - INTERVAL 30 DAY)
        GROUP BY tag ORDER BY n DESC, tag LIMIT 60""",
)
def e10(spark, d):
    return feeds.top_tags(T.items(spark, d), T.as_of(), "it")


@query("e11_saved_count", "SELECT count(DISTINCT item_id) AS n FROM marks WHERE signal IN ('up', 'save')")
def e11(spark, d):
    return reactions.per_item(_marks(spark, d)).agg(F.count("*").alias("n"))


@query(
    "e12_processing_health",
    f"""SELECT done, pending, done = 0 AND pending >= 30 AS stalled FROM (SELECT count(*) FILTER (WHERE processed_at > {AS_OF} - INTERVAL 2 HOUR) AS done,
          count(*) FILTER (WHERE processed_at IS NULL) AS pending FROM items)""",
)
def e12(spark, d):
    return monitor.health(T.items(spark, d), T.as_of())


@query(
    "e12_silent_sources",
    f"""SELECT p AS prefix, count(i.id) AS recent, count(i.id) = 0 AS silent FROM (SELECT unnest(['tw_', 'gh_', '@src1', 'zz_']) AS p)
        LEFT JOIN items i ON starts_with(i.feed_name, p) AND fetched_at > {AS_OF} - INTERVAL 6 HOUR GROUP BY p""",
)
def e12_silent(spark, d):
    return monitor.silent_sources(T.items(spark, d), ["tw_", "gh_", "@src1", "zz_"], T.as_of())


@query("e13_pushed_since", f"SELECT count(*) AS n FROM items WHERE pushed_at >= {AS_OF} - INTERVAL 3000 MINUTE")
def e13(spark, d):
    return monitor.pushed_since(T.items(spark, d), T.as_of(), 3000)


@query(
    "e14_topics_by_polarity",
    "SELECT vertical, "
    + ", ".join(f"coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (WHERE polarity = '{p}'), '') AS \"{p}\"" for p in K.POLARITY_WEIGHT)
    + ", max(n) AS n_items FROM topics JOIN (SELECT vertical, count(*) AS n FROM items GROUP BY vertical) USING (vertical) GROUP BY vertical",
)
def e14(spark, d):
    n = T.items(spark, d).groupBy("vertical").agg(F.count("*").alias("n_items"))
    return profiles.by_polarity(profiles.active_profiles(T.declared_profiles(spark))).join(n, "vertical")


@query(
    "e15_learned_board",
    "SELECT vertical, tag, round(weight, 6) AS weight, n_pos, n_neg FROM tag_aff ORDER BY weight DESC, vertical, tag LIMIT 24",
)
def e15(spark, d):
    # ties in the last digits are settled by name, so weights are rounded before ranking
    return monitor.learned_board(reactions.tag_affinity(_steps(spark, d)).withColumn("weight", F.round("weight", 6)))


@query(
    "e16_watch_board",
    f"""SELECT topic, n, rank, id, vertical, round(personal_score, 6) AS personal_score, bucket, age_s FROM (
          SELECT *, count(*) OVER (PARTITION BY topic) AS n, row_number() OVER (PARTITION BY topic ORDER BY fetched_at DESC, id DESC) AS rank
          FROM (SELECT id, vertical, personal_score, fetched_at, {BUCKET_SQL} AS bucket, date_diff('second', sort_ts, {AS_OF}) AS age_s, unnest(watch_topics) AS topic
                FROM items WHERE processed_at IS NOT NULL)) WHERE rank <= 6""",
)
def e16(spark, d):
    return monitor.watch_board(T.items(spark, d), T.as_of()).withColumn("personal_score", F.round("personal_score", 6))


@query("e17_liked_items", "SELECT DISTINCT item_id FROM marks WHERE signal IN ('up', 'save')")
def e17(spark, d):
    return reactions.per_item(_marks(spark, d)).select("item_id")


# --- windows -------------------------------------------------------------------------------------------------------


@query("f1_collapsed", f"SELECT id FROM (SELECT id, {_COLLAPSE.format(by='', order='sort_ts DESC, id DESC')} AS first FROM visible) WHERE first")
def f1(spark, d):
    return feeds.collapse(T.items(spark, d, clusters=True).filter(feeds.VISIBLE), feeds.feed_order("recent")).select("id")


@query("f3_toggle_actions", "SELECT event_id, nth, action FROM actions")
def f3(spark, d):
    return reactions.with_actions(T.feedback_events(spark, d)).select("event_id", "nth", "action")


@query("f4_current_marks", "SELECT item_id, signal, topic, marked_at FROM marks")
def f4(spark, d):
    return _marks(spark, d)


@query(
    "f5_active_profile",
    "SELECT i.vertical, a.version, count(*) AS n_items FROM items i JOIN active a ON a.vertical = i.vertical GROUP BY 1, 2",
)
def f5(spark, d):
    a = profiles.active_profiles(T.declared_profiles(spark)).select("vertical", "version")
    return T.items(spark, d).join(a, "vertical").groupBy("vertical", "version").agg(F.count("*").alias("n_items"))


@query(
    "f6_refine_triggers",
    """SELECT event_id, vertical, item_id, standing FROM (SELECT *, sum(CASE WHEN action = 'added' THEN 1 ELSE -1 END)
         OVER (PARTITION BY vertical ORDER BY ts, event_id)::BIGINT AS standing FROM steps) WHERE action = 'added' AND standing > 0 AND standing % 10 = 0""",
)
def f6(spark, d):
    return reactions.refine_triggers(T.feedback_events(spark, d), T.items(spark, d))


# --- order, paging, sets ----------------------------------------------------------------------------------------------


def _feed_sql(order: str, where: str = "true", limit: int = PAGE) -> str:
    return f"""SELECT id, row_number() OVER (ORDER BY {order}) AS rank, feed_name, title FROM (SELECT *, {_COLLAPSE.format(by='', order=order)} AS first
      FROM visible WHERE {where}) WHERE first ORDER BY {order} LIMIT {limit}"""


def _page(df):
    return df.select("id", "rank", "feed_name", "title")


_FEEDS = {
    "g1_recent_feed": ("recent", "sort_ts DESC, id DESC", "true"),
    "g1_score_feed": ("score", "score DESC NULLS LAST, id DESC", "true"),
    "g1_personal_feed": ("personal", _PERSONAL, "personal_score IS NOT NULL"),
    "g1_insight_feed": ("insight", f"insight_score DESC NULLS LAST, {_PERSONAL}", "insight_score IS NOT NULL"),
}
for _name, (_sort, _order, _where) in _FEEDS.items():
    query(_name, _feed_sql(_order, _where))(
        lambda spark, d, s=_sort: _page(feeds.feed(T.items(spark, d, clusters=True), FeedRequest(sort=s, limit=PAGE)))
    )

_CURSOR_TS, _CURSOR_ID = "2024-01-10T05:00:00", 220


@query(
    "g2_keyset_page",
    f"""SELECT id, rank, CASE WHEN rank = 50 AND more THEN replace(replace(to_base64(encode(strftime(sort_ts, '%Y-%m-%dT%H:%M:%S.%f') || '|' || id::VARCHAR)), '+', '-'), '/', '_') END AS next_cursor
        FROM (SELECT *, row_number() OVER (ORDER BY sort_ts DESC, id DESC) AS rank, lead(id) OVER (ORDER BY sort_ts DESC, id DESC) IS NOT NULL AS more
          FROM (SELECT *, {_COLLAPSE.format(by='', order='sort_ts DESC, id DESC')} AS first FROM visible
            WHERE sort_ts < TIMESTAMP '{_CURSOR_TS}' OR (sort_ts = TIMESTAMP '{_CURSOR_TS}' AND id < {_CURSOR_ID})) WHERE first) WHERE rank <= 50""",
)
def g2(spark, d):
    import base64

    cursor = base64.urlsafe_b64encode(f"{_CURSOR_TS}|{_CURSOR_ID}".encode()).decode()
    page = feeds.feed(T.items(spark, d, clusters=True), FeedRequest(limit=PAGE, cursor=cursor))
    return page.select("id", "rank", "next_cursor")


@query("g3_offset_page", f"SELECT id FROM ({_SAVED_SQL}) ORDER BY personal_score DESC NULLS LAST, marked_at DESC, id DESC LIMIT 20 OFFSET 10")
def g3(spark, d):
    return feeds.saved(T.items(spark, d), _marks(spark, d), reactions.LIKES, sort="score", limit=20, offset=10).select("id")


@query(
    "g4_incremental_export",
    f"""SELECT count(*) AS n, max(marked_at) AS latest_saved_at, (SELECT count(DISTINCT item_id) FROM marks WHERE signal IN ('up', 'save')) AS total
        FROM ({_SAVED_SQL}) WHERE marked_at > TIMESTAMP '2024-01-25 00:00:00'""",
)
def g4(spark, d):
    return feeds.saved_watermark(T.items(spark, d), _marks(spark, d), reactions.LIKES, since="2024-01-25 00:00:00")


@query("g5_top_of_period", _top_sql(72, 12, " AND vertical = 'it'"))
def g5(spark, d):
    return _top(feeds.top_of_period(T.items(spark, d, clusters=True), T.as_of(), 72, 12, "it"))


@query("g6_unpushed_top", f"SELECT id, round(personal_score, 6) AS personal_score FROM items WHERE personal_score IS NOT NULL AND pushed_at IS NULL ORDER BY {_PERSONAL} LIMIT 10")
def g6(spark, d):
    return _top(feeds.unpushed_top(T.items(spark, d)))


@query("g7_trend_items", _top_sql(720, 10, " AND list_contains(tags, 't3')"))
def g7(spark, d):
    return _top(feeds.trend_items(T.items(spark, d, clusters=True), T.as_of(), "t3", "month"))


@query(
    "g8_windowed_top",
    f"""WITH t AS (SELECT *, CASE WHEN published_at >= {AS_OF} - INTERVAL 2 HOUR THEN 0 ELSE 1 END AS tier FROM visible WHERE personal_score IS NOT NULL AND vertical IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY vertical, tier ORDER BY {_PERSONAL}) AS rank
              FROM (SELECT *, {_COLLAPSE.format(by='vertical, tier, ', order=_PERSONAL)} AS first FROM t) WHERE first)
        SELECT id, vertical, tier, rank FROM r WHERE rank <= 8 AND tier = (SELECT min(tier) FROM r x WHERE x.vertical = r.vertical)""",
)
def g8(spark, d):
    # two hours, so that some areas have fresh stories and others fall back to all times
    return feeds.windowed_top(T.items(spark, d, clusters=True), T.as_of(), hours=2).select("id", "vertical", "tier", "rank")


@query(
    "g9_queue",
    f"""SELECT id, title, {BUCKET_SQL} AS bucket, feed_name, date_diff('second', sort_ts, {AS_OF}) AS age_s, date_diff('second', fetched_at, {AS_OF}) AS lag_s
        FROM items WHERE processed_at IS NULL ORDER BY fetched_at, id LIMIT 40""",
)
def g9(spark, d):
    return monitor.queue(T.items(spark, d), T.as_of())


@query(
    "g9_skipped",
    f"""SELECT id, title, {BUCKET_SQL} AS bucket, feed_name, skip_reason, date_diff('second', sort_ts, {AS_OF}) AS age_s
        FROM items WHERE skip_reason IS NOT NULL ORDER BY processed_at DESC NULLS LAST, id DESC LIMIT 60""",
)
def g9_skipped(spark, d):
    return monitor.skipped(T.items(spark, d), T.as_of())


@query(
    "g10_dashboard_feed",
    f"""SELECT p.id, coalesce(f.feedback, '') AS feedback FROM (
          SELECT * FROM (SELECT *, {_COLLAPSE.format(by='', order='personal_score DESC NULLS LAST, sort_ts DESC, id DESC')} AS first FROM visible
            WHERE len(watch_topics) > 0 AND sort_ts > {AS_OF} - INTERVAL 721 HOUR) WHERE first ORDER BY personal_score DESC NULLS LAST, sort_ts DESC, id DESC LIMIT 50) p
        LEFT JOIN (SELECT item_id, array_to_string(list_sort(list(signal)), ',') AS feedback FROM marks GROUP BY item_id) f ON f.item_id = p.id""",
)
def g10(spark, d):
    page = feeds.dashboard_feed(T.items(spark, d, clusters=True), _marks(spark, d), T.as_of(), "watch", "score", 721)
    return page.select("id", joined("feedback"))


@query("g14_muted_tags", "SELECT vertical, tag FROM muted")
def g14(spark, d):
    return _muted(spark, d)


def _seeded_affinity(spark, d):
    seeds = profiles.profile_seeds(profiles.active_profiles(T.declared_profiles(spark)))
    return reactions.tag_affinity(_steps(spark, d), seeds)


_SEEDED_SQL = f"""SELECT vertical, tag, coalesce(s.seed, 0) * pow(0.9::DOUBLE, coalesce(n_pos + n_neg, 0)) + coalesce(a.weight, 0) AS weight,
  coalesce(n_pos, 0) AS n_pos, coalesce(n_neg, 0) AS n_neg FROM tag_aff a FULL JOIN (SELECT vertical, tag, ({_SEED_SQL})::DOUBLE AS seed FROM topics) s USING (vertical, tag)"""


@query(
    "g14_orphan_weights",
    f"SELECT vertical, tag FROM ({_SEEDED_SQL}) w WHERE n_pos = 0 AND n_neg = 0 AND NOT EXISTS (SELECT 1 FROM edited_topics e WHERE e.vertical = w.vertical AND e.tag = w.tag)",
)
def g14_orphans(spark, d):
    return profiles.orphan_weights(_seeded_affinity(spark, d), T.edited_profiles(spark)).select("vertical", "tag")


@query(
    "g15_apply_profile",
    f"""SELECT vertical, tag, round(CASE WHEN change IS NULL THEN weight WHEN change = 'same' THEN coalesce(weight, seed) ELSE seed END, 6) AS weight,
          coalesce(n_pos, 0) AS n_pos, coalesce(n_neg, 0) AS n_neg
        FROM ({_SEEDED_SQL}) a FULL JOIN (SELECT vertical, tag, change, ({_SEED_SQL.replace('polarity', 'new_polarity')})::DOUBLE AS seed FROM topic_changes WHERE new_polarity IS NOT NULL) t USING (vertical, tag)
        WHERE NOT (change IS NULL AND coalesce(n_pos, 0) = 0 AND coalesce(n_neg, 0) = 0)""",
)
def g15(spark, d):
    active = profiles.active_profiles(T.declared_profiles(spark))
    applied = profiles.apply_profile(_seeded_affinity(spark, d), active, T.edited_profiles(spark))
    return applied.withColumn("weight", F.round("weight", 6))


# --- maintenance jobs --------------------------------------------------------------------------------------------------


@query(
    "k5_retitle_job",
    """SELECT id, 'Title of ' || feed_name AS title FROM items WHERE processed_at IS NOT NULL AND (title IS NULL OR trim(title) = '')""",
)
def k5_retitle(spark, d):
    from storyloom.plans.stages import infer

    todo = maintenance.missing_titles(T.items(spark, d)).select("id", "feed_name")
    named = infer(todo, ["feed_name"], lambda b: ["Title of " + f for f in b["feed_name"]], "title")
    return named.select("id", "title")


@query(
    "k5_mute_revival_job",
    f"""SELECT s.id, round(s.ps, 6) AS personal_score, s.ps IS NOT NULL AS revived FROM scored s JOIN judged j ON j.id = s.id
        WHERE j.processed_at IS NOT NULL AND j.personal_score IS NULL AND j.vertical IS NOT NULL AND j.llm_relevance IS NOT NULL
        AND (j.skip_reason IS NULL OR starts_with(j.skip_reason, '{K.MUTE_PREFIX}'))""",
)
def k5_revive(spark, d):
    victims = maintenance.mute_victims(T.items(spark, d, labels=True, vectors=True))
    steps = _steps(spark, d)
    s = scoring.scored(
        victims, reactions.tag_affinity(steps), reactions.source_affinity(steps),
        reactions.taste(_marks(spark, d), T.items(spark, d), T.vectors(spark, d)), _muted(spark, d), T.as_of(), NO_BOOST,
    )
    return s.select("id", F.round("personal_score", 6).alias("personal_score"), c("personal_score").isNotNull().alias("revived"))
