"""URL functions as Column expressions: canonical form, shape classification, readable titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import lit_strings

# scheme, authority, path, query; the fragment is matched and dropped
_PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def _cleaned(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), r"[\t\r\n]", "")


def _decoded(piece: Column) -> Column:
    return F.coalesce(F.try_url_decode(piece), piece)


def _encoded(piece: Column) -> Column:
    # form encoding that keeps '~' and escapes '*'
    return F.replace(F.replace(F.url_encode(piece), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def host(url: Column) -> Column:
    """Lower-case host without credentials and port; empty when the URL has none."""
    return F.lower(F.regexp_extract(_part(url, 2), r"^(?:[^@]*@)?([^:]*)", 1))


def path_segments(url: Column) -> Column:
    return F.filter(F.split(_part(url, 3), "/"), lambda s: s != "")


def normalize_url(url: Column) -> Column:
    """Canonical URL: lower-case scheme and host, default port, `www.`, fragment, trailing slashes and tracking keys
    removed, query sorted. Text without an authority comes back trimmed, blank text as NULL. Idempotent."""
    u = _cleaned(url)
    scheme = F.lower(F.when(_part(u, 1) == "", "http").otherwise(_part(u, 1)))
    netloc = F.lower(_part(u, 2))
    netloc = (
        F.when((scheme == "http") & netloc.endswith(":80"), F.regexp_replace(netloc, ":80$", ""))
        .when((scheme == "https") & netloc.endswith(":443"), F.regexp_replace(netloc, ":443$", ""))
        .otherwise(netloc)
    )
    netloc = F.regexp_replace(netloc, r"^www\.", "")
    path = F.regexp_replace(_part(u, 3), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.transform(
        F.filter(F.split(_part(u, 4), "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("k"),
            F.when(F.contains(p, F.lit("=")), _decoded(F.regexp_replace(p, r"(?s)^[^=]*=", "")))
            .otherwise("")
            .alias("v"),
        ),
    )
    kept = F.array_sort(
        F.filter(
            pairs,
            lambda p: ~F.lower(p["k"]).startswith(K.TRACKING_PREFIX) & ~F.lower(p["k"]).isin(*K.TRACKING_KEYS),
        )
    )
    query = F.array_join(
        F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&"
    )
    canonical = F.concat(
        scheme, F.lit("://"), netloc, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    )
    return F.when(u == "", None).when(_part(u, 2) == "", u).otherwise(canonical)


def host_matches(url: Column, hosts) -> Column:
    """True when the host equals one of `hosts` or is a sub-domain of it; a mere substring does not count."""
    h = host(_cleaned(url))
    hit = F.lit(False)
    for name in hosts:
        hit = hit | (h == name) | h.endswith("." + name)
    return F.coalesce(hit, F.lit(False))


def readable_host_url(url: Column) -> Column:
    """Discussion pages of one host are served as plain HTML only by its `old.` twin: point the URL there."""
    h = host(url)
    raw_host = F.regexp_extract(_part(url, 2), r"^(?:[^@]*@)?([^:]*)", 1)
    swapped = F.regexp_replace(url, r"//(?:www\.|np\.|new\.)?(?i:reddit\.com)", "//old.reddit.com")
    return F.when(h.isin(*K.REDDIT_HOSTS) & (raw_host != ""), swapped).otherwise(url)


_TWEET = r"(?i)^https?://(?:www\.|mobile\.)?(?:x|twitter)\.com/([^/]+)/status/(\d+)"


def tweet_parts(url: Column) -> Column:
    """struct(user, status) of a post URL, else NULL."""
    return F.when(
        F.regexp_like(url, F.lit(_TWEET)),
        F.struct(F.regexp_extract(url, _TWEET, 1).alias("user"), F.regexp_extract(url, _TWEET, 2).alias("status")),
    )


def repo_parts(url: Column) -> Column:
    """struct(owner, repo) of a repository URL, reserved owners excluded and `.git` cut, else NULL."""
    segs = path_segments(url)
    owner, repo = F.get(segs, F.lit(0)), F.get(segs, F.lit(1))
    ok = host(url).isin(*K.REPO_HOSTS) & (F.size(segs) >= 2) & ~F.lower(owner).isin(*K.NOT_REPO_OWNERS)
    return F.when(ok, F.struct(owner.alias("owner"), F.regexp_replace(repo, r"\.git$", "").alias("repo")))


def title_from_url(url: Column) -> Column:
    """Words of the last meaningful path segment, capitalised and cut to the title limit; NULL when there is none."""
    u = _cleaned(url)
    segs = F.transform(path_segments(u), lambda s: _decoded(F.replace(s, F.lit("+"), F.lit("%2B"))))
    useful = F.filter(
        segs,
        lambda s: ~F.array_contains(lit_strings(K.URL_STOP_SEGMENTS), F.lower(s)) & ~F.regexp_like(s, F.lit(r"^\d+$")),
    )
    slug = F.get(useful, F.size(useful) - 1)
    slug = F.regexp_replace(slug, r"(?i)\.(html?|php|aspx?)$", "")
    slug = F.trim(F.regexp_replace(slug, "[-_]+", " "))
    slug = F.concat(F.upper(F.substring(slug, 1, 1)), F.substring(slug, 2, 1 << 30))
    cut = F.concat(F.regexp_replace(F.substring(slug, 1, K.TITLE_MAX), " [^ ]*$", ""), F.lit("…"))
    title = F.when(F.length(slug) <= K.TITLE_MAX, slug).otherwise(cut)
    return F.when((_part(u, 2) != "") & (F.length(slug) > 0), title)
