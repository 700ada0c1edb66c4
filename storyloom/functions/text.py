"""Text functions as Column expressions: plain text, titles, tags, labels, ages, and clean-up of model output."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom import constants as K
from storyloom.functions import blank_to_null, clip, lit_strings
from storyloom.functions.urls import title_from_url

CYRILLIC = "[а-яёА-ЯЁ]"


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """HTML entities to characters. The full entity table is only in Python, so rows that hold an `&` cross Arrow;
    the others pass NULL to the worker and keep their value in the JVM."""
    return F.when(F.contains(c, F.lit("&")), _unescape(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_title(raw: Column) -> Column:
    """Markup removed, entities decoded, blanks collapsed; NULL when empty."""
    return blank_to_null(squeeze(unescape(F.regexp_replace(raw, "<[^>]+>", " "))))


def strip_html(raw: Column) -> Column:
    """Like `clean_title`, and NULL when only a placeholder such as "read more" is left."""
    t = clean_title(raw)
    return F.when(~F.lower(t).isin(*K.JUNK_TEXTS), t)


def detect_lang(text: Column) -> Column:
    s = F.coalesce(text, F.lit(""))
    cyr = F.regexp_count(s, F.lit(CYRILLIC))
    lat = F.regexp_count(s, F.lit("[a-zA-Z]"))
    return F.when((cyr > 0) & (cyr * 3 >= lat), "ru").otherwise("en")


def hashtags(tags: Column, limit: int = 5) -> Column:
    """First `limit` tags as distinct `#a_b` words; tags that start with a digit are dropped."""
    slugs = F.transform(
        F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, limit),
        lambda t: F.regexp_replace(
            F.regexp_replace(F.lower(F.trim(t)), "[^0-9a-zA-Zа-яА-ЯёЁ_]+", "_"), "^_+|_+$", ""
        ),
    )
    good = F.filter(slugs, lambda s: (s != "") & ~F.regexp_like(s, F.lit("^[0-9]")))
    return F.array_join(F.array_distinct(F.transform(good, lambda s: F.concat(F.lit("#"), s))), " ")


def first_line(text: Column) -> Column:
    """First line that is not blank, trimmed; NULL when there is none."""
    trimmed = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), r"(?U)^\s+", "")
    return blank_to_null(F.regexp_replace(F.substring_index(trimmed, "\n", 1), r"(?U)\s+$", ""))


def derive_title(text: Column) -> Column:
    """A title from the first line: links, marks and leading symbols removed, cut at a near sentence end or a word."""
    line = F.regexp_replace(first_line(text), r"\[([^\]]+)\]\((?:[^)]+)\)", "$1")
    line = F.regexp_replace(line, r"https?://\S+", "")
    line = F.regexp_replace(line, "[*_`~]{1,3}", "")
    line = F.trim(F.regexp_replace(line, "[ \t ]+", " "))
    line = blank_to_null(F.regexp_replace(line, r"(?U)^[\s\W_]*?(?=[\w\"'«(])", ""))
    end = F.regexp_instr(F.substring(line, 1, K.TITLE_MAX + 30), F.lit(r"(?U)[.!?…](?:\s|$)"))
    head = F.substring(line, 1, K.TITLE_MAX)
    word_cut = F.coalesce(blank_to_null(F.regexp_replace(head, " [^ ]*$", "")), F.trim(head))
    word_cut = F.concat(F.regexp_replace(word_cut, "[ ,;:—-]+$", ""), F.lit("…"))
    return (
        F.when(F.length(line) <= K.TITLE_MAX, line)
        .when(end >= 21, F.trim(F.substring(line, F.lit(1), end)))
        .otherwise(word_cut)
    )


def without_reasoning(raw: Column) -> Column:
    """Model output without `<think>` blocks."""
    return F.regexp_replace(raw, "(?is)<think>.*?</think>", "")


def tidy_answer(raw: Column) -> Column:
    """Model output without reasoning, outer blanks and outer quotes; NULL when empty."""
    return blank_to_null(
        F.regexp_replace(F.regexp_replace(without_reasoning(raw), r"^\s+|\s+$", ""), '^"+|"+$', "")
    )


def json_block(raw: Column) -> Column:
    """The outermost `{…}` of model output, else NULL."""
    return F.nullif(F.regexp_extract(without_reasoning(raw), r"(?s)\{.*\}", 0), F.lit(""))


def title_or_fallback(title: Column, text: Column, feed_name: Column, model_title: Column | None = None) -> Column:
    """Own title, else a model title for long enough text, else the first line, else the first link's words, else the
    feed name."""
    body = blank_to_null(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))
    fallback = F.when(F.length(feed_name) > 0, F.concat(F.lit(K.TITLE_FALLBACK_PREFIX), feed_name))
    first_link = F.nullif(F.regexp_extract(body, r"https?://\S+", 0), F.lit(""))
    steps = [derive_title(body), title_from_url(first_link), fallback]
    if model_title is not None:
        tidy = F.regexp_replace(derive_title(without_reasoning(model_title)), "^[ .«»\"'“”]+|[ .«»\"'“”]+$", "")
        steps.insert(0, F.when(F.length(body) >= K.TITLE_MODEL_MIN, blank_to_null(tidy)))
    made = F.when(body.isNull(), fallback).otherwise(F.coalesce(*steps))
    return F.when(blank_to_null(title).isNotNull(), title).otherwise(made)


def embed_text(title: Column, text: Column, limit: int = 2000) -> Column:
    """What a vector is built from: title and text, first `limit` characters, else a placeholder."""
    joined = F.regexp_replace(
        F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))), r"(?U)^\s+|\s+$", ""
    )
    return F.coalesce(
        F.nullif(F.substring(joined, 1, limit), F.lit("")), F.nullif(title, F.lit("")), F.lit("(empty)")
    )


def slugify(name: Column, maxlen: int = 60) -> Column:
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[^0-9a-zA-Zа-яёА-ЯЁ]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, maxlen)
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit("untitled"))


def source_bucket(source_type: Column, feed_name: Column) -> Column:
    return (
        F.when(feed_name.startswith("tw_"), "twitter")
        .when(source_type == "telegram", "telegram")
        .otherwise(F.coalesce(F.nullif(source_type, F.lit("")), F.lit("other")))
    )


def source_label(feed_name: Column, bucket: Column) -> Column:
    """Display label of a source, by the prefix of its feed name."""
    label = None
    for prefix, mark in K.SOURCE_LABELS:
        shown = F.concat(F.lit(mark), F.substring(feed_name, len(prefix) + 1, 1 << 30))
        cond = feed_name.startswith(prefix)
        label = F.when(cond, shown) if label is None else label.when(cond, shown)
    label = label.when(feed_name.startswith("gh_"), K.REPO_LABEL)
    plain = F.coalesce(F.nullif(feed_name, F.lit("")), F.nullif(bucket, F.lit("")), F.lit(K.UNKNOWN_SOURCE))
    return label.otherwise(F.concat(F.lit(K.OTHER_LABEL), plain))


def age_label(seconds: Column) -> Column:
    """Age for people: now, minutes, hours, days up to 13, weeks; empty when unknown."""
    s = F.greatest(seconds.cast("long"), F.lit(0))

    def unit(size: int, mark: str) -> Column:
        return F.concat(F.floor(s / size).cast("string"), F.lit(mark))

    return (
        F.when(seconds.isNull(), "")
        .when(s < 60, K.AGE_NOW)
        .when(s < 3600, unit(60, K.AGE_MINUTE))
        .when(s < 86400, unit(3600, K.AGE_HOUR))
        .when(s < 14 * 86400, unit(86400, K.AGE_DAY))
        .otherwise(unit(7 * 86400, K.AGE_WEEK))
    )


def seconds_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later)


def markdown_to_text(md: Column) -> Column:
    """Readable text of a markdown file: no comments, badges, images or tags; links keep their text."""
    t = F.regexp_replace(md, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\)", " ")
    t = F.regexp_replace(t, r"!\[[^\]]*\]\([^)]*\)", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(?m)^[#>\s]*", "")
    t = F.regexp_replace(t, "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def upgraded_text(url: Column, source_type: Column, text: Column, fetched: Column) -> Column:
    """The fetched page text where it may replace the feed's text: a URL is there, the item is no chat message, the
    feed's text is short, and the page gives more."""
    old = F.coalesce(F.length(text), F.lit(0))
    wanted = (
        url.isNotNull() & (url != "") & ~source_type.eqNullSafe("telegram") & (old <= K.ARTICLE_ENOUGH_CHARS)
    )
    return F.when(wanted & (F.length(fetched) > old), fetched).otherwise(text)


def passthrough_summary(title: Column, text: Column, feed_name: Column) -> Column:
    """struct(use_model, summary): posts and short titled texts are their own summary, the rest goes to the model."""
    body = blank_to_null(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))
    titled = F.coalesce(F.length(title), F.lit(0)) > 0
    has_content = titled | body.isNotNull()
    short = F.coalesce(feed_name.startswith("tw_"), F.lit(False)) | (
        (F.coalesce(F.length(body), F.lit(0)) < K.SUMMARY_MIN_CHARS) & titled
    )
    return F.struct(
        (has_content & ~short).alias("use_model"), F.when(has_content & short, body).alias("summary")
    )


_TAGGER = "struct<tags:array<string>,vertical:string,insight:string,score:string,reason:string>"


def norm_vertical(v: Column) -> Column:
    n = F.lower(F.trim(v))
    return F.when(n.isin(*K.VERTICALS), n)


def normalized_answer(raw: Column) -> Column:
    """struct(tags, vertical, insight, relevance) from model JSON: at most five clean tags, a known vertical, numbers
    within [0, 1]; anything unusable becomes NULL."""
    data = F.from_json(json_block(raw), _TAGGER)
    tags = F.slice(
        F.filter(F.transform(data["tags"], lambda t: F.trim(F.lower(t))), lambda t: F.length(t) > 0), 1, 5
    )
    return F.struct(
        tags.alias("tags"),
        norm_vertical(data["vertical"]).alias("vertical"),
        clip(data["insight"].try_cast("double"), 0.0, 1.0).alias("insight"),
        clip(data["score"].try_cast("double"), 0.0, 1.0).alias("relevance"),
    )


def topic_emoji(tags: Column, feed_name: Column) -> Column:
    """Mark of the first rule that shares a tag with the item, else by feed prefix."""
    have = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    mark = None
    for emoji, keys in K.TOPIC_EMOJI:
        cond = F.arrays_overlap(have, lit_strings(keys))
        mark = F.when(cond, emoji) if mark is None else mark.when(cond, emoji)
    return (
        mark.when(feed_name.startswith("gh_"), K.REPO_EMOJI)
        .when(feed_name.startswith("tw_"), K.TWEET_EMOJI)
        .otherwise(K.OTHER_EMOJI)
    )


def card_mode(text: Column) -> Column:
    n = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.when(n >= K.CARD_FULL_CHARS, "full").when(n >= K.CARD_BRIEF_CHARS, "brief").otherwise("bare")


def tokens(text: Column) -> Column:
    """Lower-case words and numbers of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
