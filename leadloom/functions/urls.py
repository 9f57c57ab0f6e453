"""URLs and domains as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, clean_text, lookup, optional_text
from .vocabulary import BUSINESS_PAGE_REJECTED, BUSINESS_PAGE_WEIGHTS, PEOPLE_ANCHOR_TERMS, PEOPLE_PAGE_NEGATIVE, PEOPLE_PAGE_PATHS, PEOPLE_PAGE_TERMS

PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def with_scheme(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("://")), c).otherwise(F.concat(F.lit("https://"), c))


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, PARTS, 1))


def netloc(c: Column) -> Column:
    return F.regexp_extract(c, PARTS, 2)


def path(c: Column) -> Column:
    """The path, without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(c, PARTS, 3), r"(?s);[^/]*$", "")


def no_slash(c: Column) -> Column:
    return F.regexp_replace(c, r"/+$", "")


def bare_host(c: Column) -> Column:
    """Without user, port and www; in lower case; null if nothing is left."""
    host = F.substring_index(F.substring_index(F.lower(F.trim(c)), "@", -1), ":", 1)
    return blank_to_null(F.regexp_replace(host, r"^www\.", ""))


def hostname(c: Column) -> Column:
    return F.lower(F.substring_index(F.substring_index(netloc(c), "@", -1), ":", 1))


def normalize_url(c: Column) -> Column:
    """https, bare host and path, without query, fragment and last slash; null without a host."""
    url = with_scheme(clean_text(c))
    return F.concat(F.lit("https://"), bare_host(netloc(url)), no_slash(path(url)))


def normalize_domain(c: Column) -> Column:
    url = with_scheme(clean_text(c))
    return bare_host(F.coalesce(blank_to_null(netloc(url)), F.regexp_extract(url, r"(?s)^(?:[^:/?#]*:)?([^?#]*)", 1)))


def extract_domain(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(hostname(with_scheme(optional_text(c))), r"^www\.", ""))


def canonical_url(c: Column) -> Column:
    """Scheme, host and path, without port, query, fragment and last slash; the root is a slash."""
    return F.concat(scheme(c), F.lit("://"), hostname(c), F.coalesce(blank_to_null(no_slash(path(c))), F.lit("/")))


def path_parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(path(c)), "/"), lambda x: F.trim(x)), lambda x: x != "")


def business_page_score(url: Column) -> Column:
    """The largest weight of a path segment; 0 if a segment is rejected."""
    parts = path_parts(url)
    weights = F.transform(parts, lambda p: lookup(BUSINESS_PAGE_WEIGHTS, p, F.lit(0)))
    rejected = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in BUSINESS_PAGE_REJECTED]))
    return F.when(rejected, 0).otherwise(F.coalesce(F.array_max(weights), F.lit(0)))


def anchor_text(html: Column) -> Column:
    """An anchor's inner html as plain words in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>?", ""), r"(?U)\s+", " ")))


def people_page_score(url_path: Column, anchor: Column) -> Column:
    """Evidence that a path, in lower case and without its last slash, with an anchor's words, leads to people."""
    words = lambda xs: F.array(*[F.lit(x) for x in dict.fromkeys(xs)])
    hits = lambda a, xs: F.size(F.array_intersect(a, words(xs)))
    segments = F.filter(F.split(url_path, "/"), lambda x: x != "")
    tokens = F.filter(F.split(F.translate(F.lower(anchor), "-_/", "   "), r"(?U)\s+"), lambda x: x != "")
    return (
        F.when(url_path.isin(*PEOPLE_PAGE_PATHS), 100).otherwise(0)
        + 25 * hits(segments, PEOPLE_PAGE_TERMS)
        + 15 * hits(tokens, (*PEOPLE_PAGE_TERMS, *PEOPLE_ANCHOR_TERMS))
        - 35 * hits(segments, PEOPLE_PAGE_NEGATIVE)
        + F.when(F.array_contains(segments, "contact"), 5).otherwise(0)
    )
