"""Registered queries: text, URL and page functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import grounding as G
from storyloom.functions import pages as P
from storyloom.functions import text as X
from storyloom.functions import urls as U
from storyloom.operators import cards
from storyloom.plans import tables as T
from storyloom.plans.registry import AS_OF, query
from storyloom.session import spread

c = F.col


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _sql_chars(s: str) -> str:
    return s.replace("'", "''")


NORM_URL = f"""
  SELECT id, url, CASE WHEN trim(url) = '' OR url IS NULL THEN NULL ELSE
    lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' ||
    regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '') ||
    CASE WHEN regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/'
         ELSE regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') END ||
    CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url_normalized
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT starts_with(split_part(p, '=', 1), 'utm_') AND split_part(p, '=', 1) NOT IN ({_sql_list(K.TRACKING_KEYS)}))) AS kept
    FROM (SELECT id, url FROM items UNION ALL SELECT page_id + 1000000000 AS id, url FROM pages))"""

UNESCAPED = (
    "replace(replace(replace(replace(replace(regexp_replace({x}, '&amp;?', chr(1), 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'),"
    " '&copy;', '©'), '&middot;', '·')"
)


def _clean(x: str) -> str:
    """SQL twin of clean_title for the entities that occur in the tables."""
    stripped = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    plain = f"replace({UNESCAPED.format(x=stripped)}, chr(1), '&')"
    return f"nullif(trim(regexp_replace({plain}, '\\s+', ' ', 'g')), '')"


@query("b1_normalize_url", NORM_URL)
def b1(spark, d):
    urls = T.items(spark, d).select("id", "url").unionByName(
        T.table(spark, d, "pages").select((c("page_id") + 1000000000).alias("id"), "url")
    )
    return urls.select("id", "url", U.normalize_url(c("url")).alias("url_normalized"))


@query("b2_strip_html", f"SELECT page_id, {_clean('html')} AS body FROM pages")
def b2(spark, d):
    return T.table(spark, d, "pages").select("page_id", X.strip_html(c("html")).alias("body"))


@query("b3_clean_title", f"SELECT page_id, {_clean('''regexp_extract(html, '(?s)<title>(.*?)</title>', 1)''')} AS title FROM pages")
def b3(spark, d):
    raw = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return T.table(spark, d, "pages").select("page_id", X.clean_title(raw).alias("title"))


# every third text gets a Cyrillic lead whose length varies, so that both answers occur
_MIXED_SQL = "CASE WHEN doc_id % 3 = 0 THEN repeat('привет мир ', (doc_id % 200)::INTEGER) || text ELSE text END"


def _mixed():
    lead = F.repeat(F.lit("привет мир "), (c("doc_id") % 200).cast("int"))
    return F.when(c("doc_id") % 3 == 0, F.concat(lead, "text")).otherwise(c("text"))


@query(
    "b4_detect_lang",
    f"""SELECT doc_id, CASE WHEN cyr > 0 AND cyr * 3 >= lat THEN 'ru' ELSE 'en' END AS text_lang FROM (
      SELECT doc_id, len(regexp_replace(t, '[^а-яёА-ЯЁ]', '', 'g')) AS cyr, len(regexp_replace(t, '[^a-zA-Z]', '', 'g')) AS lat
      FROM (SELECT doc_id, {_MIXED_SQL} AS t FROM documents))""",
)
def b4(spark, d):
    return T.table(spark, d, "documents").select("doc_id", X.detect_lang(_mixed()).alias("text_lang"))


@query(
    "b5_hashtags",
    """SELECT id, array_to_string(list_transform(list_filter(s, lambda x, i: x <> '' AND NOT regexp_matches(x, '^[0-9]')
         AND list_position(s, x) = i), lambda x: '#' || x), ' ') AS hashtags
       FROM (SELECT id, list_transform(tags, lambda t: trim(regexp_replace(lower(trim(t)), '[^0-9a-zA-Zа-яА-ЯёЁ_]+', '_', 'g'), '_')) AS s
             FROM (SELECT id, list_concat(['AI agents!', '3d-print', source_type], tags)[1:5] AS tags FROM items))""",
)
def b5(spark, d):
    extra = F.concat(F.array(F.lit("AI agents!"), F.lit("3d-print"), c("source_type")), c("tags"))
    return T.items(spark, d).select("id", X.hashtags(extra).alias("hashtags"))


_LINE = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
   trim(split_part(ltrim(replace({t}, chr(13), ''), ' ' || chr(10) || chr(9)), chr(10), 1)),
   '\\[([^\\]]+)\\]\\((?:[^)]+)\\)', '\\1', 'g'), 'https?://\\S+', '', 'g'), '[*_`~]{{1,3}}', '', 'g'), '[ \\t ]+', ' ', 'g'))"""


def _derived(t: str) -> str:
    """SQL twin of derive_title."""
    line = _LINE.format(t=t)
    lead = (
        f"(SELECT nullif(trim(CASE WHEN regexp_matches(l, '[\\p{{L}}\\p{{M}}\\p{{N}}_\"''«(]') THEN regexp_replace(l, '^[^\\p{{L}}\\p{{M}}\\p{{N}}_\"''«(]+', '') ELSE l END), '') "
        f"FROM (SELECT {line} AS l))"
    )
    return f"""(SELECT CASE WHEN len(l) <= 90 THEN l
        WHEN len(regexp_extract(substring(l, 1, 120), '^(.*?[.!?…])(?:\\s|$)', 1)) >= 21
        THEN trim(regexp_extract(substring(l, 1, 120), '^(.*?[.!?…])(?:\\s|$)', 1))
        ELSE regexp_replace(coalesce(nullif(trim(regexp_replace(substring(l, 1, 90), ' [^ ]*$', '')), ''), trim(substring(l, 1, 90))), '[ ,;:—-]+$', '') || '…' END
      FROM (SELECT {lead} AS l))"""


@query("b6_derive_title", f"SELECT doc_id, {_derived('text')} AS title FROM documents")
def b6(spark, d):
    return T.table(spark, d, "documents").select("doc_id", X.derive_title(c("text")).alias("title"))


_STOP_SQL = _sql_list(K.URL_STOP_SEGMENTS)
_URL_TITLE_SQL = f"""
  SELECT page_id, CASE WHEN slug IS NULL OR slug = '' THEN NULL ELSE upper(substring(slug, 1, 1)) || substring(slug, 2) END AS title
  FROM (SELECT page_id, trim(regexp_replace(regexp_replace(list_filter(
      string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'),
      lambda s: s <> '' AND lower(s) NOT IN ({_STOP_SQL}) AND NOT regexp_matches(s, '^[0-9]+$'))[-1],
      '(?i)\\.(html?|php|aspx?)$', ''), '[-_]+', ' ', 'g')) AS slug
    FROM (SELECT page_id, replace(url, '.example', '.example') || CASE WHEN page_id % 2 = 0 THEN '' ELSE '' END AS url FROM pages))"""


@query("b7_title_from_url", _URL_TITLE_SQL)
def b7(spark, d):
    return T.table(spark, d, "pages").select("page_id", U.title_from_url(c("url")).alias("title"))


@query(
    "b8_title_fallback",
    f"""SELECT id, CASE WHEN trim(coalesce(title, '')) <> '' THEN title
          ELSE coalesce(CASE WHEN len(text) >= 80 THEN nullif(trim({_derived("m")}, ' .«»"''“”'), '') END,
               {_derived("text")}, '{K.TITLE_FALLBACK_PREFIX}' || feed_name) END AS title
        FROM (SELECT *, CASE WHEN id % 10 = 0 THEN '«Headline of ' || feed_name || '.»' END AS m FROM items)""",
)
def b8(spark, d):
    model = F.when(c("id") % 10 == 0, F.concat(F.lit("<think>hm</think>«Headline of "), "feed_name", F.lit(".»")))
    title = X.title_or_fallback(c("title"), c("text"), c("feed_name"), model)
    return T.items(spark, d).select("id", title.alias("title"))


@query(
    "b9_embed_text",
    """SELECT id, coalesce(nullif(substring(trim(coalesce(title, '') || chr(10) || text, ' ' || chr(10) || chr(9)), 1, 2000), ''), nullif(title, ''), '(empty)') AS input
       FROM items""",
)
def b9(spark, d):
    return T.items(spark, d).select("id", X.embed_text(c("title"), c("text")).alias("input"))


_SLUG_SQL = (
    "coalesce(nullif(trim(substring(trim(regexp_replace(lower(trim(coalesce({x}, ''))), '[^0-9a-zA-Zа-яёА-ЯЁ]+', '-', 'g'), '-'), 1, 60), '-'), ''), 'untitled')"
)


@query("b10_slugify", f"SELECT id, {_SLUG_SQL.format(x='title')} AS slug FROM items")
def b10(spark, d):
    return T.items(spark, d).select("id", X.slugify(c("title")).alias("slug"))


BUCKET_SQL = "CASE WHEN starts_with(feed_name, 'tw_') THEN 'twitter' WHEN source_type = 'telegram' THEN 'telegram' ELSE coalesce(source_type, 'other') END"


@query("b11_bucket", f"SELECT id, {BUCKET_SQL} AS bucket FROM items")
def b11(spark, d):
    return T.items(spark, d).select("id", X.source_bucket(c("source_type"), c("feed_name")).alias("bucket"))


@query(
    "b12_source_label",
    """SELECT id, CASE WHEN starts_with(feed_name, 'tw_') THEN '🐦 @' || substring(feed_name, 4)
         WHEN starts_with(feed_name, 'gh_stars_') THEN '🐙 ★' || substring(feed_name, 10)
         WHEN starts_with(feed_name, 'gh_repos_') THEN '🐙 ' || substring(feed_name, 10)
         WHEN starts_with(feed_name, 'gh_') THEN '🐙 GitHub' WHEN starts_with(feed_name, '@') THEN '✈️ ' || feed_name
         ELSE '📡 ' || feed_name END AS label FROM items""",
)
def b12(spark, d):
    return T.items(spark, d).select("id", X.source_label(c("feed_name"), c("source_type")).alias("label"))


@query(
    "b13_age_label",
    f"""SELECT id, CASE WHEN s < 60 THEN 'только что' WHEN s < 3600 THEN (s // 60)::VARCHAR || 'м' WHEN s < 86400 THEN (s // 3600)::VARCHAR || 'ч'
          WHEN s < 14 * 86400 THEN (s // 86400)::VARCHAR || 'д' ELSE (s // 604800)::VARCHAR || 'нед' END AS age
        FROM (SELECT id, greatest(date_diff('second', sort_ts, {AS_OF}), 0) AS s FROM items)""",
)
def b13(spark, d):
    return T.items(spark, d).select("id", X.age_label(X.seconds_between(c("sort_ts"), T.as_of())).alias("age"))


@query(
    "b15_age_and_lag",
    f"SELECT id, date_diff('second', sort_ts, {AS_OF}) AS age_s, date_diff('second', fetched_at, {AS_OF}) AS lag_s FROM items",
)
def b15(spark, d):
    return T.items(spark, d).select(
        "id", X.seconds_between(c("sort_ts"), T.as_of()).alias("age_s"), X.seconds_between(c("fetched_at"), T.as_of()).alias("lag_s")
    )


def _without_sql(html: str) -> str:
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "noscript", "nav", "footer", "header", "aside", "form", "svg"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    return out


@query(
    "b16_page_text",
    f"""SELECT page_id, CASE WHEN coalesce(len(article), 0) < 400 AND coalesce(len(body), 0) > coalesce(len(article), 0) THEN body ELSE article END AS body
        FROM (SELECT page_id, {_clean("regexp_extract(h, '(?is)<article[^>]*>(.*?)</article', 1)")} AS article,
            {_clean("regexp_replace(regexp_replace(h, '(?is)^.*?<body[^>]*>', ' '), '(?is)</body.*$', ' ')")} AS body
          FROM (SELECT page_id, {_without_sql('html')} AS h FROM pages))""",
)
def b16(spark, d):
    return spread(T.table(spark, d, "pages")).select("page_id", P.page_text(c("html")).alias("body"))


def _tagged_pages(spark, d):
    """Pages with preview tags made of their own title and URL, attribute order alternating; every fifth stays bare."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    one = F.concat(F.lit('<META property="og:title" content="'), F.replace(title, F.lit('"'), F.lit("")), F.lit('">'))
    two = F.concat(F.lit("<meta data-x='1' content='"), F.replace("url", F.lit("'"), F.lit("")), F.lit("' name='twitter:description'/>"))
    tags = F.when(c("page_id") % 5 == 0, "").otherwise(F.concat(one, two))
    return T.table(spark, d, "pages").select("page_id", "url", F.concat(tags, "html").alias("html"))


@query(
    "b17_meta_tags",
    f"""SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN nullif(trim(replace({UNESCAPED.format(x="replace(title, chr(34), '')")}, chr(1), '&')), '') END AS og_title,
          CASE WHEN page_id % 5 <> 0 THEN replace(url, chr(39), '') END AS description
        FROM (SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)""",
)
def b17(spark, d):
    return _tagged_pages(spark, d).select(
        "page_id", P.meta_tag(c("html"), "og:title").alias("og_title"), P.meta_tag(c("html"), "twitter:description").alias("description")
    )


_HOSTS = ("example.org", "free-bets.example.com")


@query(
    "b18_skipped_host",
    """SELECT page_id, (h = 'example.org' OR ends_with(h, '.example.org') OR h = 'free-bets.example.com' OR ends_with(h, '.free-bets.example.com')) AS skipped
       FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS h FROM pages)""",
)
def b18(spark, d):
    return T.table(spark, d, "pages").select("page_id", U.host_matches(c("url"), _HOSTS).alias("skipped"))


def _shaped_urls(spark, d):
    """Item URLs re-cast into the shapes of the classifier, by id."""
    i = T.items(spark, d).select("id", "url", "feed_name")
    n = c("id").cast("string")
    url = (
        F.when(c("id") % 5 == 0, F.concat(F.lit("https://www.reddit.com/r/x/comments/"), n))
        .when(c("id") % 5 == 1, F.concat(F.lit("https://mobile.twitter.com/"), "feed_name", F.lit("/status/"), n, F.lit("?s=20")))
        .when(c("id") % 5 == 2, F.concat(F.lit("https://github.com/topics/"), n))
        .otherwise(c("url"))
    )
    return i.select("id", url.alias("url"))


@query(
    "b19_url_shapes",
    """SELECT id, CASE WHEN id % 5 = 0 THEN replace(u, '//www.reddit.com', '//old.reddit.com') ELSE u END AS readable_url,
         CASE WHEN id % 5 = 1 THEN regexp_extract(u, 'com/([^/]+)/status/', 1) END AS post_user,
         CASE WHEN id % 5 = 1 THEN regexp_extract(u, '/status/([0-9]+)', 1) END AS post_id,
         CASE WHEN id % 5 > 2 AND u LIKE 'https://github.com/%' THEN split_part(u, '/', 4) END AS repo_owner,
         CASE WHEN id % 5 > 2 AND u LIKE 'https://github.com/%' THEN regexp_replace(split_part(u, '/', 5), '\\.git$', '') END AS repo_name
       FROM (SELECT id, CASE id % 5 WHEN 0 THEN 'https://www.reddit.com/r/x/comments/' || id::VARCHAR
         WHEN 1 THEN 'https://mobile.twitter.com/' || feed_name || '/status/' || id::VARCHAR || '?s=20'
         WHEN 2 THEN 'https://github.com/topics/' || id::VARCHAR ELSE url END AS u FROM items)""",
)
def b19(spark, d):
    s = _shaped_urls(spark, d)
    t, r = U.tweet_parts(c("url")), U.repo_parts(c("url"))
    return s.select(
        "id", U.readable_host_url(c("url")).alias("readable_url"), t["user"].alias("post_user"), t["status"].alias("post_id"),
        r["owner"].alias("repo_owner"), r["repo"].alias("repo_name"),
    )


_MD_HEAD = "# Title\n\n\n\n<!-- hidden\n -->[![ci](https://x/y.svg)](https://x/ci) ![logo](a.png) <b>bold</b>\n> see [the docs](https://d) here\t\tnow\n\n"


@query(
    "b20_markdown_to_text",
    f"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
          '{_MD_HEAD}' || text, '(?s)<!--.*?-->', ' ', 'g'), '\\[!\\[[^\\]]*\\]\\([^)]*\\)\\]\\([^)]*\\)', ' ', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'),
          '<[^>]+>', ' ', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '(?m)^[#>\\s]*', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS plain
        FROM documents""",
)
def b20(spark, d):
    md = F.concat(F.lit(_MD_HEAD), "text")
    return T.table(spark, d, "documents").select("doc_id", X.markdown_to_text(md).alias("plain"))


@query(
    "b21_text_upgrade",
    f"""SELECT id, CASE WHEN url IS NOT NULL AND source_type <> 'telegram' AND len(text) <= 1200 AND len(page) > len(text) THEN page ELSE text END AS text
        FROM (SELECT i.*, {_clean('p.html')} AS page FROM items i LEFT JOIN pages p ON p.page_id = i.id)""",
)
def b21(spark, d):
    page = T.table(spark, d, "pages").select(c("page_id").alias("id"), X.clean_title(c("html")).alias("page"))
    i = T.items(spark, d).select("id", "url", "source_type", "text").join(page, "id", "left")
    return i.select("id", X.upgraded_text(c("url"), c("source_type"), c("text"), c("page")).alias("text"))


@query(
    "b22_summary_route",
    """SELECT id, NOT short AS use_model, CASE WHEN short THEN trim(text, ' ' || chr(10) || chr(9)) END AS summary
       FROM (SELECT *, starts_with(feed_name, 'tw_') OR (len(trim(text, ' ' || chr(10) || chr(9))) < 280 AND coalesce(title, '') <> '') AS short FROM items)""",
)
def b22(spark, d):
    s = X.passthrough_summary(c("title"), c("text"), c("feed_name"))
    return T.items(spark, d).select("id", s["use_model"].alias("use_model"), s["summary"].alias("summary"))


def _answers(spark, d):
    """Model-like answers built from each item: reasoning, odd case, blanks, out-of-range and non-numeric values."""
    i = T.items(spark, d).select("id", "vertical", "tags", "raw_score")
    obj = F.to_json(
        F.struct(
            F.concat(F.array(F.lit(" AI "), F.lit("")), F.transform("tags", lambda t: F.upper(t))).alias("tags"),
            F.coalesce(F.concat(F.lit(" "), F.upper("vertical")), F.lit("other")).alias("vertical"),
            F.when(c("id") % 6 == 0, "high").otherwise((c("raw_score") * 2 - 0.5).cast("string")).alias("insight"),
            (c("raw_score") * 3).alias("score"),
        )
    )
    return i.select("id", F.concat(F.lit("<think>{maybe}</think> Answer: "), obj, F.lit("\nDone")).alias("answer"))


@query(
    "b23_model_answers",
    """SELECT id, array_to_string(list_concat(['ai'], list_transform(tags, lambda t: lower(t)))[1:5], ',') AS tags, vertical,
         round(CASE WHEN id % 6 <> 0 THEN least(greatest(raw_score * 2 - 0.5, 0), 1) END, 6) AS insight,
         round(least(greatest(raw_score * 3, 0), 1), 6) AS relevance FROM items""",
)
def b23(spark, d):
    a = _answers(spark, d).select("id", X.normalized_answer(c("answer")).alias("a"))
    return a.select(
        "id", F.array_join("a.tags", ",").alias("tags"), "a.vertical", F.round("a.insight", 6).alias("insight"),
        F.round("a.relevance", 6).alias("relevance"),
    )


@query(
    "b24_answer_cleanup",
    """SELECT doc_id, nullif(trim(trim(text, ' ' || chr(10) || chr(9)), '"'), '') AS answer FROM documents""",
)
def b24(spark, d):
    raw = F.concat(F.lit('<think>let\nme see</think>\n "'), "text", F.lit('"<THINK>x</THINK> \n'))
    return T.table(spark, d, "documents").select("doc_id", X.tidy_answer(raw).alias("answer"))


_EMOJI_TAG_NAMES = [t for _, keys in K.TOPIC_EMOJI for t in keys]


def _topic_tags():
    """Three known tags per item, spread over the whole rule table, in mixed case."""
    names = F.array(*[F.lit(t) for t in _EMOJI_TAG_NAMES])
    n = len(_EMOJI_TAG_NAMES)
    picks = [F.get(names, (c("id") * k % n).cast("int")) for k in (7, 13)]
    return F.when(c("id") % 9 != 0, F.array(F.upper(picks[0]), picks[1], F.lit("other"))).otherwise(F.array(F.lit("other")))


_EMOJI_SQL = "CASE " + " ".join(
    f"WHEN list_has_any(have, [{_sql_list(keys)}]) THEN '{e}'" for e, keys in K.TOPIC_EMOJI
) + f" WHEN starts_with(feed_name, 'gh_') THEN '{K.REPO_EMOJI}' WHEN starts_with(feed_name, 'tw_') THEN '{K.TWEET_EMOJI}' ELSE '{K.OTHER_EMOJI}' END"


@query(
    "b25_topic_emoji",
    f"""SELECT id, {_EMOJI_SQL} AS emoji FROM (SELECT id, feed_name, CASE WHEN id % 9 <> 0 THEN
          [names[id * 7 % {len(_EMOJI_TAG_NAMES)} + 1], names[id * 13 % {len(_EMOJI_TAG_NAMES)} + 1], 'other'] ELSE ['other'] END AS have
        FROM (SELECT *, [{_sql_list(_EMOJI_TAG_NAMES)}] AS names FROM items))""",
)
def b25(spark, d):
    return T.items(spark, d).select("id", X.topic_emoji(_topic_tags(), c("feed_name")).alias("emoji"))


@query(
    "b30_card_mode",
    """SELECT doc_id, CASE WHEN n >= 600 THEN 'full' WHEN n >= 60 THEN 'brief' ELSE 'bare' END AS mode
       FROM (SELECT doc_id, len(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS n FROM documents)""",
)
def b30(spark, d):
    return T.table(spark, d, "documents").select("doc_id", X.card_mode(c("text")).alias("mode"))


# --- grounding ---------------------------------------------------------------------------------------------------

_NORM_SQL = (
    "' ' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[‐-―−­]', '-', 'g'), '[   \\s]+', ' ', 'g'),"
    " '([0-9]) ([0-9]{{3}})([^0-9]|$)', '\\1\\2\\3', 'g'), '[^a-z0-9а-яё.,+#_-]+', ' ', 'g') || ' '"
)


def _claims(spark, d):
    """(id, claim, source): the first line of each text with its number, against its own text and against the text of
    the next document."""
    t = T.table(spark, d, "documents").select(c("doc_id").alias("id"), "text")
    claim = F.concat(F.substring_index("text", "\n", 1), F.lit(" Release "), (c("id") % 90).cast("string"), F.lit(" of Tool-"), c("id").cast("string"))
    claims = t.select("id", claim.alias("claim"), "text")
    other = t.select((c("id") - 1).alias("id"), c("text").alias("next_text"))
    return spread(claims.join(other, "id", "left"))


_FACTS_SQL = f"""
  SELECT id, list_distinct(list_filter(list_transform(regexp_extract_all(f, '[a-z][a-z0-9+#._-]*'), lambda w: trim(w, '{K.FACT_EDGE_CHARS}')),
           lambda w: len(w) >= 3 AND w NOT IN ({_sql_list(K.GENERIC_NAMES)}))) AS names,
         list_distinct(list_transform(regexp_extract_all(f, '[0-9]+(?:[.,][0-9]+)?'), lambda n: replace(n, ',', '.'))) AS numbers,
         own, nxt
  FROM (SELECT a.doc_id AS id, {_NORM_SQL.format(x="split_part(a.text, chr(10), 1) || ' Release ' || (a.doc_id % 90)::VARCHAR || ' of Tool-' || a.doc_id::VARCHAR")} AS f,
          {_NORM_SQL.format(x="a.text")} AS own, {_NORM_SQL.format(x="coalesce(b.text, '')")} AS nxt
        FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1)"""


def _bad_sql(src: str) -> str:
    words = [(w, dg) for dg, forms in K.NUMBER_WORDS.items() for w in forms.split()]
    keys, vals = _sql_list([w for w, _ in words]), _sql_list([v for _, v in words])
    known = (
        f"list_concat(list_transform(regexp_extract_all({src}, '[0-9]+(?:[.,][0-9]+)?'), lambda n: replace(n, ',', '.')),"
        f" list_transform(list_filter(regexp_extract_all({src}, '[a-zа-яё]+'), lambda w: list_contains([{keys}], w)), lambda w: ([{vals}])[list_position([{keys}], w)]))"
    )
    return (
        f"array_to_string(list_sort(list_concat(list_filter(names, lambda n: NOT contains({src}, n) AND NOT contains(regexp_replace({src}, '[ ._-]+', '', 'g'), regexp_replace(n, '[ ._-]+', '', 'g'))),"
        f" list_filter(numbers, lambda n: NOT list_contains({known}, n)))), ',')"
    )


@query(
    "h15_claim_grounding",
    f"SELECT id, {_bad_sql('own')} AS missing_in_own, {_bad_sql('nxt')} AS missing_in_next FROM ({_FACTS_SQL})",
)
def h15(spark, d):
    own = G.with_ungrounded(_claims(spark, d), "claim", "text", "own")
    both = G.with_ungrounded(own, "claim", "next_text", "nxt")
    return both.select("id", F.array_join("own", ",").alias("missing_in_own"), F.array_join("nxt", ",").alias("missing_in_next"))


@query("h16_grounded_cards")
def h16(spark, d):
    t = T.table(spark, d, "documents").select("doc_id", "text")
    line = F.when(c("doc_id") % 3 == 0, F.concat(F.substring_index("text", "\n", 1), F.lit(" Zyx9"))).otherwise(F.substring_index("text", "\n", 1))
    card = F.to_json(
        F.struct(
            line.alias("line"),
            F.array(
                F.concat(F.lit("• "), F.substring_index("text", ".", 1)), F.concat(F.lit("- 7777 "), F.substring_index("text", " ", 3)), F.lit("常驻 процесс")
            ).alias("points"),
        )
    )
    answers = t.select(c("doc_id").alias("id"), card.alias("answer"), c("text").alias("source"))
    g = cards.grounded(cards.parsed_cards(answers))
    return g.select("id", "mode", "line", F.array_join("points", "|").alias("points"), F.array_join("dropped", "|").alias("dropped"))
