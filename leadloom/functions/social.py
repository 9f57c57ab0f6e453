"""Social-media and LinkedIn URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import blank_to_null, lookup
from .urls import hostname, netloc, no_slash, path, scheme, with_scheme


def _platform(url: Column, prefix: str = r"^www\.") -> Column:
    return lookup(V.SOCIAL_HOSTS, F.regexp_replace(hostname(url), prefix, ""))


def normalize_social_url(c: Column) -> Column:
    """The canonical https URL of a known platform's page; only YouTube keeps its query, without tracking. Null for others."""
    v = F.trim(c)
    host = F.regexp_replace(hostname(v), r"\.+$", "")
    bare = F.regexp_replace(host, r"^www\.", "")
    short = host == "youtu.be"
    platform = F.when(short, "youtube").otherwise(lookup(V.SOCIAL_HOSTS, bare))
    raw_path = F.regexp_extract(v, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.transform(F.split(raw_path, "/"), lambda x: F.trim(x)), lambda p: p != "")
    clean = F.concat(F.lit("/"), F.array_join(parts, "/"))
    pairs = F.filter(F.split(F.regexp_extract(v, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda p: p.rlike("^[^=]+=.+") & ~F.lower(p).rlike("^(?:" + "|".join(V.SOCIAL_QUERY_IGNORED) + ")"))
    query = F.when((platform == "youtube") & (F.size(pairs) > 0), F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    ok = F.lower(v).rlike("^https?://") & platform.isNotNull() & ~F.exists(parts, lambda p: p.rlike(r"(?U)\s"))
    return F.when(ok, F.concat(F.lit("https://"), platform, F.lit(".com"), clean, query))


def normalize_social_urls(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, normalize_social_url), lambda x: x.isNotNull())))


def social_platform(c: Column) -> Column:
    return lookup(V.SOCIAL_HOSTS, hostname(normalize_social_url(c)))


def classify_social_url(c: Column) -> Column:
    """struct(platform, url, kind) of a useful profile or page, or null."""
    v = F.trim(c)
    platform = _platform(v)
    p = path(v)
    p = F.when(F.coalesce(p, F.lit("")).isin("", "/"), "/").otherwise(no_slash(p))
    low = F.lower(p)
    under = lambda xs: low.rlike("^(?:" + "|".join(x.replace(".", r"\.") for x in xs) + ")")
    useful = (
        F.when(platform == "facebook", ~low.isin(*V.FACEBOOK_IGNORED, "/") & ~under(V.FACEBOOK_IGNORED_UNDER))
        .when(platform == "instagram", ~low.isin(*V.INSTAGRAM_IGNORED, "/") & ~under(V.INSTAGRAM_IGNORED_UNDER))
        .when(platform == "linkedin", under(V.LINKEDIN_USEFUL))
        .when(platform == "youtube", ~low.isin(*V.YOUTUBE_IGNORED) & under(V.YOUTUBE_USEFUL))
        .when(platform == "tiktok", ~low.isin(*V.TIKTOK_IGNORED) & under(V.TIKTOK_USEFUL))
        .when(platform == "github", ~low.isin(*V.GITHUB_IGNORED) & low.rlike("[^/]"))
        .when(platform == "x", ~low.isin(*V.X_IGNORED) & ~under(V.X_IGNORED_UNDER) & low.rlike("[^/]"))
    )
    kind = F.when(platform != "linkedin", platform).when(low.rlike("^/in/"), "linkedin_profile").otherwise("linkedin_company")
    url = F.concat(F.lit("https://"), platform, F.lit(".com"), p)
    return F.when(scheme(v).isin("http", "https") & F.coalesce(useful, F.lit(False)), F.struct(platform.alias("platform"), url.alias("url"), kind.alias("kind")))


def normalize_linkedin_url(c: Column) -> Column:
    """https://www.linkedin.com/in/<slug> of a person's profile, or null."""
    v = with_scheme(F.trim(c))
    p = no_slash(path(v))
    slug = F.regexp_extract(p, "(?i)^/in/+([^/]+)$", 1)
    own = F.regexp_replace(hostname(v), r"^www\.", "") == "linkedin.com"
    return F.when(scheme(v).isin("http", "https") & own & (netloc(v) != ""), F.concat(F.lit("https://www.linkedin.com/in/"), blank_to_null(slug)))


def name_from_linkedin_slug(c: Column) -> Column:
    """A name from a profile's slug of two to five parts, all of Latin letters; else null."""
    slug = F.regexp_extract(normalize_linkedin_url(c), "/in/([^/]+)$", 1)
    whole = slug.rlike(r"^[A-Za-zÀ-ÖØ-öø-ÿ]+(?:[-_][A-Za-zÀ-ÖØ-öø-ÿ]+){1,4}$")
    word = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1000)))
    return F.when(whole, F.array_join(F.transform(F.split(slug, "[-_]"), word), " "))
