"""Entity resolution of people within a company."""

from __future__ import annotations

from difflib import SequenceMatcher
from urllib.parse import urlsplit

from pyspark.sql import DataFrame

MERGE, POSSIBLE = 0.92, 0.75
RESOLVED = "company_id long, name string, title string, linkedin_url string, source_url string, sources long"


def _host_path(url: str | None) -> tuple[str | None, str | None]:
    value = (url or "").strip()
    parts = urlsplit(value)
    host = (parts.hostname or "").casefold().removeprefix("www.")
    return host or None, (host + parts.path.rstrip("/").casefold() if host else value.casefold().rstrip("/")) or None


class Person:
    """A candidate with the keys that comparing it needs, made once."""

    __slots__ = ("name", "title", "linkedin_url", "source_url", "key", "profile", "host", "page")

    def __init__(self, name, title, linkedin_url, source_url):
        from ..functions.people import linkedin_profile
        from ..functions.person import name_key

        self.name, self.title, self.linkedin_url, self.source_url = name or "", title, linkedin_url, source_url
        self.key = name_key(self.name)
        self.profile = (linkedin_profile(linkedin_url) or "").casefold() if linkedin_url else ""
        self.host, self.page = _host_path(source_url)


def _supported(a: Person, b: Person) -> bool:
    titles = [" ".join(t.casefold().split()) for t in (a.title or "", b.title or "")]
    return bool(
        (a.page and a.page == b.page) or (a.host and a.host == b.host) or bool(a.profile) != bool(b.profile)
        or (all(titles) and (titles[0] in titles[1] or titles[1] in titles[0]))
    )


def compare(a: Person, b: Person) -> tuple[str, float]:
    """(same, possible or different, score). Likeness of names alone never makes two people one."""
    if a.profile and b.profile:
        return ("same", 1.0) if a.profile == b.profile else ("different", 0.0)
    if not a.key or not b.key:
        return "different", 0.0
    if a.key == b.key:
        return "same", 1.0
    ratio = SequenceMatcher(None, a.key, b.key).ratio()
    if ratio >= MERGE and _supported(a, b):
        return "same", ratio
    return ("possible" if ratio >= POSSIBLE else "different"), ratio


def _richer(a: str | None, b: str | None) -> str | None:
    if not a or not b:
        return a or b
    size = lambda v: (len(v.split()), len(v))
    return b if size(b) > size(a) else a


def resolve(people: list[Person], counts: list[int] | None = None) -> list[tuple[Person, int]]:
    """Each person joins the first one so far that is the same, which then takes the richer values. With each, how many (or the sum of their counts)."""
    out: list[tuple[Person, int]] = []
    for p, n in zip(people, counts or [1] * len(people)):
        at = next((i for i, (q, _) in enumerate(out) if compare(p, q)[0] == "same"), None)
        if at is None:
            out.append((p, n))
        else:
            q, m = out[at]
            out[at] = (Person(_richer(q.name, p.name), _richer(q.title, p.title), q.linkedin_url or p.linkedin_url, q.source_url or p.source_url), m + n)
    return out


def resolve_people(candidates: DataFrame) -> DataFrame:
    """People of each company_id, from candidates (company_id, ordinal, name, title, linkedin_url, source_url) in order of ordinal. A company's people are few;
    equal candidates are counted before they are gathered."""
    from pyspark.sql import functions as F

    keys = ["company_id", "name", "title", "linkedin_url", "source_url"]
    once = candidates.groupBy(*keys).agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("n"))

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("ordinal").astype(object).where(lambda x: x.notna(), None)
        out = resolve([Person(*r) for r in pdf[keys[1:]].itertuples(index=False)], pdf["n"].tolist())
        return pd.DataFrame([(pdf["company_id"].iloc[0], p.name, p.title, p.linkedin_url, p.source_url, n) for p, n in out], columns=[c.split()[0] for c in RESOLVED.split(", ")])

    return once.groupBy("company_id").applyInPandas(one, RESOLVED)
