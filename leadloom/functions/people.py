"""People on a web page: structured data, person cards, profiles, and names near titles."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from urllib.parse import urljoin, urlsplit

from . import vocabulary as V
from .html import Node, parse

# Fixed values -------------------------------------------------------------------------------------------------------

EDGE = r"(?<![\wÀ-ÖØ-öø-ÿ])({})(?![\wÀ-ÖØ-öø-ÿ])"
TITLE_FORMS = {
    "en": (
        r"Managing\s+Director", r"General\s+Manager", r"Commercial\s+Director", r"Operations?\s+Director", r"Technical\s+Director",
        r"Managing\s+Partner", r"Vice\s+President", r"Head\s+of\s+\w+(?:\s+\w+){0,3}", r"Lead(?:\s+\w+){0,3}", r"Co[- ]Founder", "Founder", "Owner",
        "Director", "Manager", "Partner", "President", "VP", "Consultant", "Specialist", "Developer", "Designer", "Engineer", "Architect", "Lawyer",
        "Solicitor", "Accountant", "Researcher", "Scientist", "Principal", "Professor", r"Prof\.?", "Doctor", r"Dr\.?", "CEO", "CTO", "CMO", "COO", "CFO",
    ),
    "nl": (
        r"Algemeen\s+Directeur", r"Commercieel\s+Directeur", r"Operationeel\s+Directeur", r"Technisch\s+Directeur", r"Beherend\s+Vennoot",
        r"Managing\s+Partner", "Praktijkeigenaar", "Praktijkhouder", "Praktijkmanager", "Vestigingsmanager", "Bedrijfsleider", "Projectmanager",
        "Accountmanager", "Teamleider", "Teamlead", r"Mede[- ]?oprichter", r"Mede[- ]?eigenaar", "Bestuurder", "Bestuurslid", "Directeur", "Eigenaar",
        "Ondernemer", "Oprichter", "Vennoot", "Partner", "Manager", "Consultant", "Specialist", "Onderzoeker", "Wetenschapper",
        r"Hoofd(?:\s+van)?(?:\s+\w+){0,3}", r"Dhr\.?", r"Mevr\.?", r"Mw\.?", r"Drs\.?", r"Ir\.?", r"Ing\.?", r"Prof\.?", "Professor", "CEO", "CTO",
        "CMO", "COO", "CFO",
    ),
}
NAME_WORD = r"[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÖØ-öø-ÿ'’\-]+"
NAME = re.compile(rf"(?<![\wÀ-ÖØ-öø-ÿ])({NAME_WORD}(?:\s+(?:{NAME_WORD}|van|de|den|der|het|te|ten|ter|op|aan)){{1,3}})(?![\wÀ-ÖØ-öø-ÿ])")
SENTENCE_WORDS = (
    "a", "about", "after", "also", "an", "and", "are", "as", "at", "been", "being", "but", "by", "can", "clearly", "did", "does", "done", "for", "from",
    "get", "has", "have", "he", "her", "here", "his", "how", "i", "in", "is", "it", "its", "me", "my", "of", "on", "one", "our", "patient", "patients",
    "professional", "really", "she", "that", "the", "their", "them", "they", "this", "to", "very", "was", "we", "were", "what", "which", "who", "with",
    "you", "your", "aan", "als", "bij", "de", "een", "en", "er", "heeft", "hebben", "het", "hier", "hij", "hoe", "jij", "kan", "kunnen", "maar", "met",
    "mij", "naar", "niet", "om", "ons", "ook", "op", "over", "te", "voor", "van", "wat", "werd", "wie", "wordt", "zijn", "zij", "ze", "zoals",
)
WEBSITE_WORDS = (
    "about", "about us", "appointment", "book", "booking", "contact", "home", "learn", "more", "our", "read", "review", "reviews", "services", "team",
    "our team", "our people", "leadership", "management", "board", "staff", "people", "view", "welcome", "why", "choose", "careers", "career", "news",
    "blog", "privacy", "terms", "cookie", "cookies", "consent", "settings", "preferences", "over", "over ons", "afspraak", "afspraken", "boeken", "meer",
    "ons", "onze", "lees", "recensie", "recensies", "diensten", "ons team", "onze mensen", "directie", "bestuur", "bestuurders", "medewerkers", "mensen",
    "bekijk", "welkom", "waarom", "kiezen", "vacatures", "vacature", "nieuws", "voorwaarden", "instellingen", "voorkeuren",
)
PLACEHOLDERS = ("voornaam", "achternaam", "voornaam achternaam", "firstname", "lastname", "first name", "last name", "john doe", "jane doe")
REJECTED_PHRASES = (
    "accessibility statement", "privacy policy", "cookie policy", "terms conditions", "terms service", "google partner", "meta business",
    "cloudways partner", "read more", "learn more", "contact us", "about us", "our team",
)
ROLE_WORDS = (
    "ceo", "cto", "cfo", "cmo", "coo", "vp", "founder", "cofounder", "co-founder", "owner", "director", "manager", "partner", "president", "head", "lead",
    "principal", "eigenaar", "directeur", "oprichter", "medeoprichter", "mede-oprichter", "vennoot", "bestuurder", "praktijkeigenaar", "praktijkhouder",
    "praktijkmanager", "vestigingsmanager", "bedrijfsleider", "projectmanager", "accountmanager", "teamleider", "teamlead", "consultant", "specialist",
    "onderzoeker", "wetenschapper", "tandarts", "arts", "doctor", "dr", "engineer", "architect", "lawyer", "accountant", "designer", "developer",
    "researcher", "scientist",
)
ORGANISATION_WORDS = (
    "clinic", "clinics", "dental", "tandarts", "centrum", "center", "group", "groep", "company", "bedrijf", "bedrijven", "agency", "bureau", "studio", "bv",
    "b.v", "b.v.", "amsterdam", "rotterdam", "utrecht", "bilthoven", "amersfoort", "lahore",
)
LOCATION_WORDS = (
    "straat", "street", "laan", "road", "weg", "plein", "square", "avenue", "boulevard", "maliebaan", "utrecht", "amsterdam", "rotterdam", "bilthoven",
    "amersfoort", "lahore",
)
PERSON_TERMS = (
    "team", "team-member", "team_member", "teammember", "employee", "staff", "staff-member", "staff_member", "person", "person-card", "person_card", "people",
    "profile", "profile-card", "profile_card", "member", "leadership", "management", "medewerker", "medewerkers",
)
PAGE_TERMS = ("cookie", "consent", "privacy", "navigation", "breadcrumb", "footer", "sidebar", "menu", "popup", "modal", "header", "nav")
IMAGE_TERMS = ("logo", "icon", "banner", "background", "product")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
TITLE_TAGS = ("p", "span", "div", "small", "strong", "em")
#: Points of an element that may be a person's block: each word of PERSON_TERMS, PAGE_TERMS and so on, with the most that they add up to.
REGION_POINTS = {
    "person_term": 5, "person_terms_most": 10, "page_term": -10, "page_terms_most": -20, "profile_link": 6, "typed_person": 10, "one_heading": 3,
    "two_or_three_headings": 1, "over_six_headings": -3, "portrait": 2, "text_of_10_to_500": 2, "text_over_1500": -5, "over_twenty_links": -4,
}
CARD_TITLE_MOST = 160
LINK_CHARS = r"https?://(?:www\.)?linkedin\.com/in/[A-Za-z0-9%._~-]+"

# End of fixed values ------------------------------------------------------------------------------------------------

SEPARATORS = " \t\r\n-–—|,:;/()"
QUOTES = ".,:;!?()[]{}\"“”‘’"


@lru_cache
def _titles():
    return [re.compile(EDGE.format("|".join(forms)), re.IGNORECASE) for forms in TITLE_FORMS.values()]


@lru_cache
def _sets():
    plain = lambda w: w.strip(QUOTES).casefold()
    title_tokens = {plain(p) for t in V.all_titles() for p in t.split()} - {""}
    particle_tokens = {p for t in V.particles() for p in t.split()}
    return title_tokens, particle_tokens, *map(frozenset, (SENTENCE_WORDS, WEBSITE_WORDS, ROLE_WORDS, ORGANISATION_WORDS, LOCATION_WORDS))


def find_titles(text: str) -> list[tuple[int, int, str]]:
    """(start, end, title) of both languages, in order of start, longer ones first."""
    found = [(m.start(), m.end(), m[0]) for form in _titles() for m in form.finditer(text or "")]
    return sorted(found, key=lambda x: (x[0], x[0] - x[1]))


def nearby_title(text: str) -> str | None:
    found = find_titles(text)
    return found[0][2].strip() if found else None


def clean_name(value: str) -> str | None:
    """A plausible person's name of two to four words, or None."""
    title_tokens, particles, sentence, website, roles, organisation, place = _sets()
    plain = lambda w: w.strip(QUOTES).casefold()
    words = value.split()
    if not 2 <= len(words) <= 6 or re.search(r"[@/\\=<>]", value):
        return None
    while len(words) > 2 and plain(words[-1]) in title_tokens:
        words.pop()
    low = [plain(w) for w in words]
    core = [w for w in low if w not in particles]
    whole = " ".join(low)
    bad = (
        len(words) > 4 or not all(low) or any(w in sentence or w in website for w in low) or whole in PLACEHOLDERS or whole in REJECTED_PHRASES
        or len(core) < 2 or all(w in roles for w in core) or sum(w in organisation for w in low) >= 2 or sum(w in place for w in low) >= 2
    )
    return None if bad else " ".join(words)


def name_after(text: str) -> str | None:
    m = NAME.match(text.lstrip(SEPARATORS))
    return clean_name(m[1]) if m else None


def name_before(text: str) -> str | None:
    text = text.rstrip(SEPARATORS)
    last = None
    for last in NAME.finditer(text):
        pass
    return clean_name(last[1]) if last and last.end() == len(text) else None


def best_name(text: str) -> str | None:
    """Of the plausible names the one nearest to two words, then the shortest."""
    names = [n for m in NAME.finditer(text) if (n := clean_name(m[1]))]
    return min(names, key=lambda n: (abs(len(n.split()) - 2), len(n)), default=None)


def title_name_pairs(text: str, window: int = 60):
    """(name, title) where a name follows a title, or else comes before it."""
    for start, end, title in find_titles(text):
        name = name_after(text[end : end + window]) or name_before(text[max(0, start - window) : start])
        if name:
            yield name, title.strip()


def name_title_pairs(text: str, window: int = 80, reach: int = 50):
    """(name, title) of each name with the nearest title around it."""
    for m in NAME.finditer(text or ""):
        name = clean_name(m[1])
        if not name:
            continue
        begin = max(0, m.start() - window)
        a, b = m.start() - begin, m.end() - begin
        gap = lambda t: a - t[1] if t[1] <= a else max(0, t[0] - b)  # noqa: E731, B023
        near = min(find_titles(text[begin : m.end() + window]), key=lambda t: (gap(t), t[0] - t[1]), default=None)
        if near and gap(near) <= reach:
            yield name, near[2].strip()


def linkedin_profile(url: str) -> str | None:
    value = url.strip()
    value = value if re.match("https?://", value, re.I) else f"https://{value}"
    try:
        parts = urlsplit(value)
        host = (parts.hostname or "").casefold().removeprefix("www.")
    except ValueError:
        return None
    m = re.fullmatch("/in/([^/]+)", parts.path.rstrip("/"), re.I)
    return f"https://www.linkedin.com/in/{m[1].strip()}" if host == "linkedin.com" and m and m[1].strip() else None


def slug_name(profile: str) -> str | None:
    slug = profile.rsplit("/", 1)[-1]
    letters = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
    return " ".join(p.capitalize() for p in re.split("[-_]", slug)) if re.fullmatch(f"{letters}(?:[-_]{letters}){{1,4}}", slug) else None


def linkedin_profiles(html: str) -> list[str]:
    links = [n.attrs["href"] for n in parse(html).find_all("a", attr="href")] + re.findall(LINK_CHARS, html or "", re.I)
    return sorted({p for u in links if (p := linkedin_profile(u))})


# Structured data ----------------------------------------------------------------------------------------------------


def _spaces(value) -> str | None:
    return " ".join(value.split()) or None if isinstance(value, str) else None


def _objects(data):
    """All objects of a JSON value, outer ones first, in order."""
    stack = [data]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            yield x
            stack += [v for k, v in reversed(x.items()) if k not in ("@context", "@type")]
        elif isinstance(x, list):
            stack += reversed(x)


def _listed(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def json_ld_people(root: Node):
    for script in root.find_all("script"):
        if script.attrs.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads("".join(c for c in script.children if isinstance(c, str)))
        except ValueError:
            continue
        for x in _objects(data):
            kinds = {t.rsplit("/", 1)[-1].casefold() for t in _listed(x.get("@type")) if isinstance(t, str)}
            if "person" in kinds and (name := _spaces(x.get("name"))):
                profile = next((u.strip() for u in _listed(x.get("sameAs")) if isinstance(u, str) and "linkedin.com/in/" in u.casefold()), None)
                yield name, _spaces(x.get("jobTitle")), profile


def _property(node: Node, name: str) -> str | None:
    found = next((n for n in node.walk() if n.attrs.get("itemprop") == name), None)
    if found is None:
        return None
    return next((v for a in ("content", "value", "title") if (v := _spaces(found.attrs.get(a)))), None) or _spaces(found.text())


def microdata_people(root: Node):
    for node in root.find_all(attr="itemtype"):
        if "schema.org/person" in node.attrs["itemtype"].casefold() and (name := _property(node, "name")):
            links = [next((v for a in ("href", "content", "src") if (v := n.attrs.get(a, "").strip())), "") for n in node.walk() if n.attrs.get("itemprop") == "sameAs"]
            links += [n.attrs["href"].strip() for n in node.find_all("a", attr="href")]
            yield name, _property(node, "jobTitle"), next((u for u in links if "linkedin.com/in/" in u.casefold()), None)


def structured_people(root: Node) -> list[tuple[str, str | None, str | None]]:
    out: dict = {}
    for person in (*json_ld_people(root), *microdata_people(root)):
        out.setdefault((person[0].casefold(), (person[2] or "").casefold()), person)
    return list(out.values())


# Regions and cards --------------------------------------------------------------------------------------------------


def region_score(node: Node) -> int:
    marks = [m.casefold() for m in (*node.attrs.get("class", "").split(), node.attrs.get("id", "").strip()) if m]
    terms = {t for m in marks for t in (m, *re.split(r"[\s_\-]+", m)) if t}
    anchors = node.find_all("a", attr="href")
    typed = node.attrs.get("itemtype") or next((n.attrs["itemtype"] for n in node.walk() if "itemtype" in n.attrs), "")
    headings, size = len(node.find_all(*HEADINGS)), len(node.text())
    pictures = [" ".join(n.attrs.get("alt", "").split()).casefold() for n in node.find_all("img")]
    seen = {
        "profile_link": any("linkedin.com" in (h := n.attrs["href"].casefold()) and "/in/" in h for n in anchors), "typed_person": "schema.org/person" in typed.casefold(),
        "one_heading": headings == 1, "two_or_three_headings": 2 <= headings <= 3, "over_six_headings": headings > 6, "portrait": any(p and not any(t in p for t in IMAGE_TERMS) for p in pictures),
        "text_of_10_to_500": 10 <= size <= 500, "text_over_1500": size > 1500, "over_twenty_links": len(anchors) > 20,
    }
    w = REGION_POINTS
    named = min(w["person_term"] * len(terms & set(PERSON_TERMS)), w["person_terms_most"]) + max(w["page_term"] * len(terms & set(PAGE_TERMS)), w["page_terms_most"])
    return named + sum(w[k] for k, x in seen.items() if x)


def person_regions(root: Node, least: int = 6) -> list[tuple[Node, int]]:
    """Elements that look like a person's block; of nested ones the deepest. Best scores first."""
    scored = [(n, s) for n in root.find_all("article", "section", "li", "div") if (s := region_score(n)) >= least]
    covered: set[int] = set()
    chosen = []
    for node, score in sorted(scored, key=lambda x: (x[0].depth, x[1]), reverse=True):
        if id(node) not in covered:
            chosen.append((node, score))
            covered.update(id(p) for p in node.above())
    return sorted(chosen, key=lambda x: (-x[1], x[0].depth))


def person_card(node: Node) -> tuple[str, str | None, str | None] | None:
    heading = next((n for n in node.walk() if n.tag in HEADINGS), None)
    line = heading.text() if heading else ""
    found = next(iter((*name_title_pairs(line), *title_name_pairs(line))), None)
    if not found:
        return None
    profile = next((h for n in node.find_all("a", attr="href") if "linkedin.com/in/" in (h := n.attrs["href"].strip()).casefold()), None)
    name, title = found
    return name, title or card_title(node, heading, name), profile


def card_title(node: Node, heading: Node, name: str) -> str | None:
    """The first short line of a card, other than its heading and the name, that holds a professional title."""
    lines = (n.text() for n in node.find_all(*TITLE_TAGS) if n is not heading)
    return next((t for t in lines if t and len(t) <= CARD_TITLE_MOST and t.casefold() != name.casefold() and find_titles(t)), None)


def linkedin_people(root: Node, regions):
    """(name, title, profile) of each profile link: from the smallest region around it, or else from a parent with a heading."""
    seen = set()
    for anchor in root.find_all("a", attr="href"):
        profile = linkedin_profile(anchor.attrs["href"])
        if not profile or profile in seen:
            continue
        seen.add(profile)
        around = {id(n) for n in (anchor, *anchor.above())}
        region = max((n for n, _ in regions if id(n) in around), key=lambda n: n.depth, default=None)
        if region:
            nearby = region.text()
        else:
            near = [anchor, *anchor.above()][:3]
            nearby = next((t for n in near if n.tag and 3 <= len(t := n.text()) <= 500 and n.find_all(*HEADINGS)), "")
        if name := best_name(nearby) or slug_name(profile):
            yield name, nearby_title(nearby), profile


def merge_candidate(people: list, new: tuple[str, str | None, str | None]) -> None:
    """Add a person, or replace the one with the same profile, or else name, if the new one is more complete."""
    key = lambda p: (p[2] or "").strip().rstrip("/").casefold()
    name = lambda p: " ".join(p[0].split()).casefold()
    full = lambda p: 2 * bool(p[1]) + 4 * bool(p[2])
    if not name(new):
        return
    at = next((i for i, p in enumerate(people) if key(new) and key(p) == key(new)), None)
    at = next((i for i, p in enumerate(people) if name(p) == name(new)), None) if at is None else at
    if at is None:
        people.append(new)
    elif full(new) > full(people[at]):
        people[at] = new


def people_of_page(text: str | None, html: str | None) -> list[tuple[str, str | None, str | None]]:
    """(name, title, profile) found on a page, the strongest kinds of evidence first."""
    people: list = []
    found: list = []
    if html:
        root = parse(html)
        regions = person_regions(root)
        found += structured_people(root) + [c for n, _ in regions if (c := person_card(n))] + list(linkedin_people(root, regions))
    if text:
        found += [(n, t, None) for n, t in (*title_name_pairs(text), *name_title_pairs(text))]
    for person in found:
        merge_candidate(people, person)
    return people


def people_page_links(html: str | None, source_url: str | None) -> list[tuple[str, str, str]]:
    """(canonical url, path in lower case, anchor text) of links to other pages of the same host."""
    try:
        source = urlsplit(source_url or "")
        host = (source.hostname or "").casefold()
    except ValueError:
        return []
    out = []
    for n in parse(html).find_all("a", attr="href") if host else ():
        try:
            url = urlsplit(urljoin(source_url, n.attrs["href"].strip()))
            same = (url.hostname or "").casefold() == host
        except ValueError:
            continue
        path = (url.path or "/").rstrip("/") or "/"
        if n.attrs["href"].strip() and url.scheme.lower() in ("http", "https") and same and path.casefold() != ((source.path or "/").rstrip("/") or "/").casefold():
            out.append((f"{url.scheme.lower()}://{host}{path}", path.casefold(), " ".join(n.text().split()).casefold()))
    return out
