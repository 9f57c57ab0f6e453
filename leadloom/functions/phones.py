"""Phone numbers as column expressions. Validity and type are by the ranges of numbering.PLANS, and so approximate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbering import DIGITS, PLANS, number_type
from .text import blank_to_null, bound, lookup, unquote
from .vocabulary import PHONE_TEXT


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def e164(value: Column, region: Column | str | None = None) -> Column:
    """The E.164 form, or null for what the plans don't know. A number without a country code needs a region; an unknown region raises."""
    if isinstance(region, str):
        code = region.strip().upper() or None
        if code and code not in PLANS:
            raise ValueError(f"unsupported phone region {region!r}")
        cc, trunk = (F.lit(x) for x in PLANS[code][:2]) if code else (F.lit(None).cast("string"),) * 2
        known = F.lit(True)
    else:
        code = blank_to_null(F.upper(F.trim(region))) if region is not None else F.lit(None).cast("string")
        cc, trunk = (lookup({k: v[i] for k, v in PLANS.items()}, code) for i in range(2))
        known = code.isNull() | cc.isNotNull()

    def tried(v: Column, digits: Column) -> Column:
        """With a plus or 00 the number says its country; else it is one of the region, or has its country code without a mark."""
        full = F.when(v.startswith("00"), F.substring(digits, 3, 20)).otherwise(digits)
        rest = F.when((trunk != "") & digits.startswith(trunk), F.substring(digits, F.length(trunk) + 1, F.lit(20))).otherwise(digits)
        return F.when(v.startswith("+") | v.startswith("00"), F.array(full)).otherwise(F.array(F.concat(cc, rest), F.when(digits.startswith(cc), digits)))

    def number(v: Column) -> Column:
        digits = _digits(F.regexp_replace(F.replace(v, F.lit("(0)"), F.lit("")), r"(?i)\s*(?:ext|x|;).*$", ""))
        valid = F.get(F.filter(bound(digits, lambda d: tried(v, d)), lambda n: number_type(n).isNotNull()), F.lit(0))
        found = F.when(~known, F.raise_error(F.concat(F.lit("unsupported phone region "), code if isinstance(code, Column) else F.lit(""))).cast("string")).otherwise(F.concat(F.lit("+"), valid))
        return F.when(v.rlike("[A-Za-z]{3,}") & ~v.rlike("(?i)ext"), None).otherwise(found)

    return bound(F.trim(value), number)


def phone_type(value: Column, region: Column | str | None = None) -> Column:
    """What the plan has the number for (numbering.TYPES), or null for one that no plan has."""
    return number_type(F.substring(e164(value, region), 2, DIGITS))


def is_valid_phone(value: Column, region: Column | str | None = None) -> Column:
    return e164(value, region).isNotNull()


def normalize_phones(values: Column, region: Column | str | None = None) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda x: e164(x, region)), lambda x: x.isNotNull())))


def phone_candidate(c: Column) -> Column:
    """Digits with a plus where there was one; no rules of a country."""
    v = F.regexp_replace(F.trim(unquote(c)), "(?i)^tel:", "")
    v = F.trim(F.substring_index(F.substring_index(v, "?", 1), ";", 1))
    digits = _digits(v)
    return F.when(digits == "", "").when(v.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)


def is_plausible_phone(c: Column) -> Column:
    digits = _digits(c)
    return F.length(digits).between(7, 15) & ~digits.rlike(r"^(\d)\1*$")


def extract_phones(text: Column, tel: Column | None = None) -> Column:
    """Sorted candidates of a text and of tel links; of those with equal digits the first."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHONE_TEXT), F.lit(0)), phone_candidate)
    if tel is not None:
        found = F.concat(found, F.transform(F.coalesce(tel, F.array().cast("array<string>")), phone_candidate))
    found = F.filter(found, is_plausible_phone)
    first = F.filter(found, lambda x, i: F.array_position(F.transform(found, _digits), _digits(x)) == i + 1)
    return F.array_sort(first)
