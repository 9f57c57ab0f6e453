"""E-mail addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, bound, unquote
from .vocabulary import EMAIL_TEXT, EMAIL_WHOLE, FREE_EMAIL_PROVIDERS, HONORIFICS, ROLE_EMAIL_PREFIXES


def normalize_email(c: Column) -> Column:
    """Decoded, trimmed, in lower case, without mailto:, query and fragment; null if it isn't an address."""
    v = F.regexp_replace(F.lower(F.trim(unquote(c))), "^mailto:", "")
    v = F.trim(F.substring_index(F.substring_index(v, "?", 1), "#", 1))
    return bound(v, lambda x: F.when(x.rlike(EMAIL_WHOLE), x))


def normalize_emails(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, normalize_email), lambda x: x.isNotNull())))


def email_domain(c: Column) -> Column:
    return F.substring_index(normalize_email(c), "@", -1)


def email_local_part(c: Column) -> Column:
    return F.regexp_extract(normalize_email(c), "^(.*)@", 1)


def is_free_email_provider(c: Column) -> Column:
    return F.coalesce(email_domain(c).isin(*FREE_EMAIL_PROVIDERS), F.lit(False))


def is_role_email(c: Column) -> Column:
    """Of a whole address; a bare local part is no address and has no role."""
    return F.coalesce(F.substring_index(email_local_part(c), "+", 1).isin(*ROLE_EMAIL_PREFIXES), F.lit(False))


def parse_email(c: Column) -> Column:
    """struct(address, local_part, domain, provider, is_free_provider, is_role_address), or null. The role is that of the address."""
    e, free = normalize_email(c), is_free_email_provider(c)
    return F.when(e.isNotNull(), F.struct(e.alias("address"), email_local_part(c).alias("local_part"), email_domain(c).alias("domain"), F.when(free, email_domain(c)).alias("provider"), free.alias("is_free_provider"), is_role_email(c).alias("is_role_address")))


def email_quality(c: Column) -> Column:
    return F.when(normalize_email(c).isNull(), None).when(is_free_email_provider(c), "free_provider").when(is_role_email(c), "business_role").otherwise("business_individual")


def _plausible(c: Column) -> Column:
    v = F.trim(unquote(c))
    return F.when((v != "") & ~F.contains(v, F.lit("/")) & ~F.contains(v, F.lit("\\")), v)


def extract_emails(text: Column, mailto: Column | None = None, lenient: bool = False) -> Column:
    """Sorted distinct addresses of a text and of mailto links, in the case they have there.

    An address before a full stop isn't found unless lenient.
    """
    pattern = "(?U)" + (EMAIL_TEXT.replace(r"(?![\w.-])", r"(?![\w-])") if lenient else EMAIL_TEXT)
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), _plausible)
    if mailto is not None:
        link = lambda x: _plausible(F.substring_index(F.substring_index(F.regexp_replace(F.trim(unquote(x)), "(?i)^mailto:", ""), "?", 1), "#", 1))
        found = F.array_union(found, F.transform(F.coalesce(mailto, F.array().cast("array<string>")), link))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def pattern_domain(c: Column) -> Column:
    """A bare host name for guessed addresses; null if it doesn't look like one."""
    v = F.regexp_replace(F.lower(F.trim(c)), "^[a-z][a-z0-9+.-]*://", "")
    v = F.regexp_replace(F.regexp_extract(v, "^[^/?#]*", 0), r"^www\.", "")
    v = F.regexp_replace(F.regexp_replace(v, r"^(.+):[0-9]+$", "$1"), r"^\.+|\.+$", "")
    return bound(v, lambda x: F.when(x.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$"), x))


FOLD_FROM = "àáâãäåāăąçćčďèéêëēėęěìíîïīįñńňòóôõöōőŕřśšťùúûüūůűýÿžźżğ"
FOLD_TO = "aaaaaaaaacccdeeeeeeeeiiiiiinnnooooooorrsstuuuuuuuyyzzzg"


def name_parts(c: Column) -> Column:
    """ASCII parts of a person's name, without honorifics."""
    plain = F.regexp_replace(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), r"[^a-z0-9\s'-]+", " ")
    return F.filter(F.split(plain, r"[\s'-]+"), lambda p: (p != "") & ~p.isin(*HONORIFICS))


def email_patterns(name: Column, domain: Column, limit: int = 8) -> Column:
    """Guessed addresses in order of preference, at most `limit`."""
    empty = F.array().cast("array<string>")

    def locals_(parts: Column) -> Column:
        first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
        one, end = F.substring(first, 1, 1), F.substring(last, 1, 1)
        many = F.array(
            F.concat_ws(".", first, last), first, F.concat(one, last), F.concat(first, end), F.concat(first, last), F.array_join(parts, "."), F.array_join(parts, ""),
            F.concat_ws("_", first, last), F.concat_ws("-", first, last),
        )
        return F.when(F.size(parts) == 1, F.array(first)).when(F.size(parts) > 1, F.array_distinct(many)).otherwise(empty)

    # names and hosts are taken apart once, not once for each address
    local = F.slice(bound(name_parts(name), locals_), 1, max(limit, 1))
    found = bound(pattern_domain(domain), lambda host: F.when(host.isNotNull(), F.transform(local, lambda p: F.concat(p, F.lit("@"), host))))
    return empty if limit < 1 else F.coalesce(found, empty)


def mailbox(c: Column) -> Column:
    return blank_to_null(email_local_part(c))
