"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import COUNTRY_ALIASES

SPACE = r"(?U)[\s\x1c-\x1f]+"


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    """The value of a constant table at a key column."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, default)


def bound(value: Column, f) -> Column:
    """f(value), where value is computed once, however often f has it; within a lambda Spark computes an expression anew for each place and each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def optional_text(c: Column) -> Column:
    """Trimmed of white space; blank becomes null."""
    return blank_to_null(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def required_text(c: Column, field: str) -> Column:
    return F.coalesce(optional_text(c), F.raise_error(F.lit(f"Missing required field: {field}")).cast("string"))


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed; blank becomes null."""
    return blank_to_null(F.trim(F.regexp_replace(c, SPACE, " ")))


def company_name(c: Column) -> Column:
    return F.lower(F.coalesce(clean_text(c), F.lit("")))


def country(c: Column) -> Column:
    text = clean_text(c)
    return lookup(COUNTRY_ALIASES, F.lower(text), text)


def business_phone(c: Column) -> Column:
    """A listing's phone keeps its form; only white space is collapsed."""
    return clean_text(c)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def location(c: Column) -> Column:
    """struct(city, country): the first and last part between commas; one part is a city."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.get(parts, F.lit(0)).alias("city"), F.when(F.size(parts) >= 2, F.element_at(parts, -1)).alias("country"))


def unquote(c: Column) -> Column:
    """Percent-decoded; a plus stays one, and text that can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def content_hash(text: Column, html: Column) -> Column:
    """SHA-256 of the text, or else of the html; null if both are empty."""
    return F.sha2(F.coalesce(blank_to_null(text), blank_to_null(html)), 256)
