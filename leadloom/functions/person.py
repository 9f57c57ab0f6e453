"""Names and titles of people. Unicode normalisation has no built-in function, so these are vectorised Python functions; each also has a plain
form for use in grouped operators."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .social import normalize_linkedin_url


@lru_cache
def _tables():
    return V.particles(), V.PREFIXES, V.all_titles()


def clean(value: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", value or "").split())


def capital(part: str) -> str:
    return part[:1].upper() + part[1:].lower()


def name_word(word: str) -> str:
    prefix = _tables()[1].get(word.casefold())
    if prefix:
        return prefix
    for curly in "‘’ʼ":
        word = word.replace(curly, "'")
    mark = next((m for m in "-'" if m in word), None)
    return mark.join(capital(p) for p in word.split(mark)) if mark else capital(word)


def person_name(value: str | None) -> str:
    """Words capitalised, surname particles in lower case (the longest that fits), prefixes in their usual form."""
    words, out = clean(value).split(), []
    known = _tables()[0]
    while words:
        for n in (3, 2, 1):
            phrase = " ".join(words[:n]).casefold()
            if n <= len(words) and phrase in known:
                out.append(phrase)
                words = words[n:]
                break
        else:
            out.append(name_word(words.pop(0)))
    return " ".join(out)


def name_key(value: str | None) -> str:
    return person_name(value).casefold()


def person_title(value: str | None) -> str | None:
    text = clean(value).strip(" -|,:;/")
    if not text:
        return None
    return _tables()[2].get(text.casefold()) or " ".join(capital(p) for p in text.split())


def _vectorised(function):
    @F.pandas_udf("string")
    def run(values):
        cache: dict = {}
        return values.map(lambda v: None if v is None else cache[v] if v in cache else cache.setdefault(v, function(v)))

    return run


def normalize_person_name(c: Column) -> Column:
    return _vectorised(person_name)(c)


def person_name_key(c: Column) -> Column:
    return _vectorised(name_key)(c)


def normalize_person_title(c: Column) -> Column:
    return _vectorised(person_title)(c)


def normalize_person(name: Column, title: Column, linkedin: Column, source_url: Column) -> Column:
    """struct(name, title, linkedin_url, source_url): a candidate in its usual form. The page that it was found on stays as it is."""
    return F.struct(normalize_person_name(name).alias("name"), normalize_person_title(title).alias("title"), normalize_linkedin_url(linkedin).alias("linkedin_url"), source_url.alias("source_url"))


def person_identity(name: Column, linkedin: Column) -> Column:
    """struct(field, value): the profile, or else the name."""
    url = F.lower(normalize_linkedin_url(linkedin))
    return F.when(url.isNotNull(), F.struct(F.lit("linkedin").alias("field"), url.alias("value"))).otherwise(F.struct(F.lit("name").alias("field"), person_name_key(name).alias("value")))


def person_match_keys(name: Column, linkedin: Column) -> Column:
    """The keys by which a person is the same as another: profile, then name."""
    key, url = F.nullif(person_name_key(name), F.lit("")), F.lower(normalize_linkedin_url(linkedin))
    pair = lambda f, v: F.when(v.isNotNull(), F.struct(F.lit(f).alias("field"), v.alias("value")))
    return F.filter(F.array(pair("linkedin", url), pair("name", key)), lambda x: x.isNotNull())


def title_role(title: Column) -> Column:
    """Our own stand-in for a language model's judgement, by the vocabulary alone: primary, secondary, professional or unknown."""
    low = F.lower(F.trim(title))
    first = ("owner", "founder", "co-founder", "cofounder", "ceo", "president", "managing director", "eigenaar", "oprichter", "medeoprichter", "directeur", "algemeen directeur")
    return F.when(low.isNull() | (low == ""), "unknown").when(low.isin(*first), "primary").when(low.isin(*V.decision_maker_roles()), "secondary").when(low.isin(*V.all_titles()), "professional").otherwise("other")
