"""Main text and title of raw HTML pages, as regular-expression projections over a table of pages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import blank_to_null
from storyloom.functions.text import clean_title, unescape

# --- fixed values: attribute order of preview tags varies, so there are two shapes ------------------------------
META_SHAPES = (
    r"(?i)<meta[^>]+(?:property|name)=[\"']{key}[\"'][^>]+content=[\"']([^\"']*)[\"']",
    r"(?i)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+(?:property|name)=[\"']{key}[\"']",
)


def meta_tag(html: Column, key: str) -> Column:
    """Content of a named preview tag, entities decoded; NULL when missing or blank."""
    shapes = [s.replace("{key}", re.escape(key)) for s in META_SHAPES]
    return F.trim(unescape(F.coalesce(*[blank_to_null(F.regexp_extract(html, s, 1)) for s in shapes])))


def page_title(html: Column) -> Column:
    """The author's preview title."""
    return F.coalesce(meta_tag(html, "og:title"), meta_tag(html, "twitter:title"))


def _without_boilerplate(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    return F.regexp_replace(
        t, r"(?is)<(script|style|noscript|nav|footer|header|aside|form|svg)\b[^>]*>.*?</\1\s*>", " "
    )


def article_text(html: Column) -> Column:
    """Text of the `<article>` element, boilerplate elements removed."""
    return clean_title(F.regexp_extract(_without_boilerplate(html), r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1))


def body_text(html: Column) -> Column:
    """Text of the whole body, boilerplate elements removed."""
    t = F.regexp_replace(_without_boilerplate(html), r"(?is)^.*?<body\b[^>]*>", " ")
    return clean_title(F.regexp_replace(t, r"(?is)</body\s*>.*$", " "))


def page_text(html: Column) -> Column:
    """The article, else the longer of article and body, else preview title and description."""
    enough = K.ARTICLE_MIN_CHARS

    def longer(a: Column, b: Column) -> Column:
        short = F.coalesce(F.length(a), F.lit(0)) < enough
        more = F.coalesce(F.length(b), F.lit(0)) > F.coalesce(F.length(a), F.lit(0))
        return F.when(short & more, b).otherwise(a)

    preview = F.concat_ws(
        "\n\n",
        page_title(html),
        F.coalesce(meta_tag(html, "og:description"), meta_tag(html, "twitter:description")),
    )
    return F.nullif(longer(longer(article_text(html), body_text(html)), preview), F.lit(""))


LISTING_LINK = r'href="/([\w.-]+/[\w.-]+)"[^>]*data-view-component'
