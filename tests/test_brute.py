"""Queries whose core runs in Python, against plain versions of their own."""

import re
from collections import defaultdict
from difflib import SequenceMatcher
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from leadloom.functions import person
from leadloom.functions import vocabulary as V
from leadloom.plans import catalogue
from leadloom.plans.base import frame

SF = "/root/testdata/sf0.001"


class Anchors(HTMLParser):
    """(href, words) of a page's anchors."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.open = None
            if dict(attrs).get("href"):
                self.open = [dict(attrs)["href"], ""]
                self.found.append(self.open)

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = None

    def handle_data(self, data):
        if self.open is not None:
            self.open[1] += data


def people_score(path, words):
    segments, tokens = {s for s in path.split("/") if s}, set(re.sub("[-_/]", " ", words).split())
    return (
        100 * (path in V.PEOPLE_PAGE_PATHS) + 25 * len(segments & set(V.PEOPLE_PAGE_TERMS)) + 15 * len(tokens & {*V.PEOPLE_PAGE_TERMS, *V.PEOPLE_ANCHOR_TERMS})
        - 35 * len(segments & set(V.PEOPLE_PAGE_NEGATIVE)) + 5 * ("contact" in segments)
    )


def test_people_pages(spark):
    extra = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id", "url", "html", f"concat('<a href=\"', {catalogue.EXTRA}, '\">Our <b>team</b></a>') AS more")
    want = []
    for r in extra.collect():
        parser = Anchors()
        parser.feed((r["html"] or "") + r["more"])
        here, best = urlsplit(r["url"]), defaultdict(int)
        bare = lambda p: (p or "/").rstrip("/") or "/"
        for href, words in parser.found:
            there = urlsplit(urljoin(r["url"], href.strip()))
            if there.scheme in ("http", "https") and there.hostname == here.hostname and bare(there.path).casefold() != bare(here.path).casefold():
                url = f"{there.scheme}://{there.hostname}{bare(there.path)}"
                best[url] = max(best[url], people_score(bare(there.path).casefold(), " ".join(words.split()).casefold()))
        ranked = sorted(((-s, u) for u, s in best.items() if s > 0))[:10]
        want += [(r["page_id"], u, -s, i) for i, (s, u) in enumerate(ranked, 1)]
    got = catalogue.QUERIES["w2_people_pages"](spark, SF)
    assert want and sorted((r["site"], r["url"], r["score"], r["rank"]) for r in got.collect()) == sorted(want)


def test_resolved_people(spark):
    """Each person joins the first one so far that is the same: equal profiles, or equal names without different profiles, or names that are nearly equal with something else in common."""
    profile = lambda u: re.sub(r"^https?://(www\.)?|/?(\?.*)?$", "", u).casefold() if u else ""
    folder = "/root/testdata/sf0.01"  # where companies have people of one name
    p = frame(spark, folder, "people")
    rows = p.select("company_id", "id", "name", "title", "linkedin_url", person.person_name_key(F.col("name")).alias("key")).orderBy("id").collect()
    by = defaultdict(list)
    for r in rows:
        # a name's key follows the richer name that a person takes, so each known name has its key
        by[r["company_id"]].append(r.asDict())
    keys = {r["name"]: r["key"] for r in rows}
    richer = lambda a, b: a or b if not a or not b else (b if (len(b.split()), len(b)) > (len(a.split()), len(a)) else a)
    want = []
    for company, people in by.items():
        out = []
        for x in people:
            for q in out:
                a, b = profile(x["linkedin_url"]), profile(q["linkedin_url"])
                if a and b:
                    same = a == b
                elif not keys[x["name"]] or not keys[q["name"]]:
                    same = False
                else:
                    same = keys[x["name"]] == keys[q["name"]] or SequenceMatcher(None, keys[x["name"]], keys[q["name"]]).ratio() >= 0.92  # all share the company's page
                if same:
                    q |= {"name": richer(q["name"], x["name"]), "title": richer(q["title"], x["title"]), "linkedin_url": q["linkedin_url"] or x["linkedin_url"], "sources": q["sources"] + 1}
                    break
            else:
                out.append(x | {"sources": 1})
        want += [(company, q["name"], q["title"] or None, q["linkedin_url"], q["sources"]) for q in out]
    got = [(r["company_id"], r["name"], r["title"] or None, r["linkedin_url"], r["sources"]) for r in catalogue.QUERIES["d5_resolve_people"](spark, folder).collect()]
    assert len(want) < len(rows) and sorted(got, key=repr) == sorted(want, key=repr)
