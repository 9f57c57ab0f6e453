"""Functions against golden pairs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadloom.functions import emails, people, person, phones, policies, social, text, urls


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("f", "value", "want"), [
    (urls.normalize_domain, "HTTPS://WWW.Example.COM:443/path", "example.com"), (urls.normalize_domain, "user@www.shop.nl", "shop.nl"), (urls.normalize_domain, " ", None), (urls.normalize_domain, None, None),
    (urls.normalize_url, "HTTP://WWW.Example.COM/", "https://example.com"), (urls.normalize_url, "shop.com/a/b//?x=1#y", "https://shop.com/a/b"), (urls.normalize_url, "https:///x", None),
    (urls.extract_domain, "Shop.COM:80/x", "shop.com"), (urls.canonical_url, "HTTPS://A.b:80/", "https://a.b/"),
    (text.company_name, "  Example   Digital LTD  ", "example digital ltd"), (text.company_name, None, ""), (text.clean_text, "a  b\t\n", "a b"), (text.clean_text, "   ", None),
    (text.country, " NEDERLAND ", "Netherlands"), (text.country, "France", "France"), (text.slug, "Tandarts & Co. – Utrecht!", "tandarts-co-utrecht"),
    (emails.normalize_email, "MAILTO:Ann%40B.com?subject=x", "ann@b.com"), (emails.normalize_email, "a@b", None), (emails.normalize_email, "a+b@c.org#x", "a+b@c.org"), (emails.normalize_email, "100%@c.org", "100%@c.org"),
    (emails.email_quality, "info+x@shop.nl", "business_role"), (emails.email_quality, "x@gmail.com", "free_provider"), (emails.email_quality, "ann@shop.nl", "business_individual"), (emails.email_quality, "no", None),
    (social.normalize_linkedin_url, "https://linkedin.com/in/john-smith/?trk=profile", "https://www.linkedin.com/in/john-smith"), (social.normalize_linkedin_url, "linkedin.com/in/x/y", None),
    (social.normalize_linkedin_url, "https://www.linkedin.com/company/x", None), (social.normalize_linkedin_url, "ftp://linkedin.com/in/x", None), (social.normalize_linkedin_url, "https://nl.linkedin.com/in/x", None),
    (social.normalize_social_url, "http://twitter.com//a/", "https://x.com/a"), (social.normalize_social_url, "https://m.facebook.com/a", None), (social.normalize_social_url, "https://instagram.com", "https://instagram.com/"),
    (social.name_from_linkedin_slug, "https://linkedin.com/in/ann-de-wit", "Ann De Wit"), (social.name_from_linkedin_slug, "https://linkedin.com/in/ann-1", None),
    (person.normalize_person_name, "JAN VAN DER BERG", "Jan van der Berg"), (person.normalize_person_name, "PETER VAN 'T HOF", "Peter van 't Hof"), (person.normalize_person_name, "ANNE-MARIE JANSEN", "Anne-Marie Jansen"),
    (person.normalize_person_name, "PETER O'CONNOR", "Peter O'Connor"), (person.normalize_person_name, "Dr. JOHN SMITH", "Dr. John Smith"), (person.normalize_person_name, "ﬁona  lee", "Fiona Lee"),
    (person.normalize_person_title, "co founder", "Co-Founder"), (person.normalize_person_title, "ceo", "CEO"), (person.normalize_person_title, "mede-oprichter", "Medeoprichter"),
    (person.normalize_person_title, "Head of Marketing", "Head Of Marketing"), (person.normalize_person_title, " - ", None), (person.normalize_person_title, "teamlead", "Teamlead"), (person.normalize_person_title, "team lead", "Team Lead"),
])
def test_scalars(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize(("value", "region", "want"), [
    ("020 7946 0018", "GB", "+442079460018"), ("(212) 555-0123", "US", "+12125550123"), ("416-555-0123", "CA", "+14165550123"), ("020 123 4567", "NL", "+31201234567"), ("+92 333 2142266", None, "+923332142266"),
    ("20230922", "PK", None), ("1111111111", "PK", None), ("123", "PK", None), ("not a phone", "PK", None), ("020 123 4567", None, None), ("0031 20 123 4567", "GB", "+31201234567"),
])
def test_phones(spark, value, region, want):
    assert one(spark, value, lambda c: phones.e164(c, region)) == want
    column = spark.createDataFrame([(value, region)], "v string, r string").select(phones.e164(F.col("v"), F.col("r")).alias("x")).first()["x"]
    assert column == want


def test_unknown_region_raises(spark):
    with pytest.raises(ValueError):
        phones.e164(F.col("v"), "ZZ")
    with pytest.raises(Exception, match="unsupported"):
        spark.createDataFrame([("1", "ZZ")], "v string, r string").select(phones.e164(F.col("v"), F.col("r"))).collect()


def test_extraction(spark):
    page = "Mail ann@b.com, x@y.org. or info@shop.nl now +31 20 123 4567 and (020) 123-4567 1111111"
    assert one(spark, page, emails.extract_emails) == ["ann@b.com", "info@shop.nl"]
    assert one(spark, page, lambda c: emails.extract_emails(c, lenient=True)) == ["ann@b.com", "info@shop.nl", "x@y.org"]
    assert one(spark, "Mail a@b.com.", emails.extract_emails) == []
    assert one(spark, page, phones.extract_phones) == ["+31201234567", "0201234567"]
    assert one(spark, None, phones.extract_phones) == [] and one(spark, None, emails.extract_emails) == []
    assert one(spark, "Ann Lee", lambda c: emails.email_patterns(c, F.lit("www.ex.com"))) == [f"{x}@ex.com" for x in ("ann.lee", "ann", "alee", "annl", "annlee", "ann_lee", "ann-lee")]
    assert one(spark, "Dr.", lambda c: emails.email_patterns(c, F.lit("ex.com"))) == [] and one(spark, "Ann", lambda c: emails.email_patterns(c, F.lit("-x.com"))) == []
    assert len(one(spark, "Ann B C Lee", lambda c: emails.email_patterns(c, F.lit("ex.com")))) == 8


def test_pages(spark):
    assert one(spark, "https://a.nl/about-us/Team/", urls.business_page_score) == 100 and one(spark, "https://a.nl/shop/team", urls.business_page_score) == 0 and one(spark, "https://a.nl/", urls.business_page_score) == 0
    assert one(spark, "/over-ons", lambda c: urls.people_page_score(c, F.lit("Over ons"))) == 100 + 25 + 15
    assert one(spark, "/blog/team", lambda c: urls.people_page_score(c, F.lit("our-team"))) == 25 + 15 - 35


def test_names_and_titles():
    assert people.clean_name("Maarten Vaartjes Tandarts") == "Maarten Vaartjes" and people.clean_name("Privacy Policy") is None and people.clean_name("Director Manager") is None
    assert people.clean_name("van der") is None and people.clean_name("Jan de Vries") is None and people.clean_name("Dental Clinic Lahore") is None and people.best_name("meet Jan Vries today") == "Jan Vries" and people.best_name("Jan de Vries") is None
    assert [t for *_, t in people.find_titles("Jan, Managing Director and eigenaar")] == ["Managing Director", "eigenaar"]
    assert set(people.title_name_pairs("CEO Jan Vries")) == {("Jan Vries", "CEO")} and list(people.title_name_pairs("Ann Baker, Managing Director"))[0] == ("Ann Baker", "Managing Director")
    assert list(people.name_title_pairs("Ann Baker is our Founder")) == [("Ann Baker", "Founder")]


HTML = """
<html><head><script type="application/ld+json">{"@graph": [{"@type": "https://schema.org/Person", "name": "Ann  Baker", "jobTitle": "CEO", "sameAs": ["x", "https://www.linkedin.com/in/ann-baker"]}]}</script>
<script type="application/ld+json">{bad</script></head><body>
<div itemscope itemtype="https://schema.org/Person"><span itemprop="name">Kim Stone</span><i itemprop="jobTitle" content="Designer"></i><a href="https://linkedin.com/in/kim-stone/">in</a></div>
<section class="team"><div class="team-member"><h3>Jan Vries, Eigenaar</h3><img alt="portrait"><a href="https://linkedin.com/in/jan-vries">in</a></div></section>
<a href="/over-ons">Over ons</a><a href="/privacy">x</a><a href="https://other.nl/team">x</a><a href="mailto:a@b.nl">m</a><p>Lisa Stone, Accountant
</body></html>
"""  # fmt: skip


def test_people_of_a_page():
    found = people.people_of_page("Lisa Stone, Accountant", HTML)
    by = {n: (t, u) for n, t, u in found}
    assert by["Ann Baker"] == ("CEO", "https://www.linkedin.com/in/ann-baker") and by["Kim Stone"][0] == "Designer" and by["Jan Vries"][0] == "Eigenaar" and by["Lisa Stone"] == ("Accountant", None)
    assert people.people_of_page(None, None) == [] and people.people_of_page("", "<div" * 2000) == []
    assert people.people_page_links(HTML, "https://shop.nl/") == [("https://shop.nl/over-ons", "/over-ons", "over ons"), ("https://shop.nl/privacy", "/privacy", "x")]
    assert people.linkedin_profiles(HTML) == [f"https://www.linkedin.com/in/{x}" for x in ("ann-baker", "jan-vries", "kim-stone")]
    assert people.people_of_page(None, "<div>" * 5000) == []


def test_policies(spark):
    row = spark.createDataFrame([("Ann Baker", "primary", True, "high", True)], "n string, r string, d boolean, c string, l boolean")
    s = row.select(policies.score_person(*[F.col(c) for c in "nrdcl"]).alias("s")).first()["s"]
    assert s["score"] == 140 and s["reasons"] == ["primary_decision_maker_role", "qualified_decision_maker", "high_role_confidence", "linkedin_profile", "person_name", "name_role_combination"]
    age = lambda at: spark.createDataFrame([(at,)], "t timestamp_ntz").select(policies.should_recrawl(F.col("t"), timedelta(days=7), F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")).alias("x")).first()["x"]
    assert age(datetime(2024, 1, 1)) and not age(datetime(2024, 1, 1, 0, 0, 0, 1)) and age(None)
    sent = lambda *v: spark.createDataFrame([v], "s boolean, a boolean, t string, c double").select(policies.send_decision(*[F.col(c) for c in "satc"], 0.5, ["deliverable"]).alias("d")).first()["d"]["reason"]
    assert [sent(True, True, "x", 0.1), sent(False, True, "x", 0.1), sent(None, None, None, 0.9), sent(False, False, "deliverable", None), sent(False, False, "deliverable", 0.4), sent(False, False, "deliverable", 0.5)] == [
        "suppressed", "already_sent", "verification_status_not_allowed", "verification_confidence_missing", "verification_confidence_too_low", "eligible"]


DIALLED = [
    ("0300 1234567", "PK", "mobile"), ("042 35761999", "PK", "fixed_line"), ("07400 123456", "GB", "mobile"), ("0808 157 0192", "GB", "toll_free"), ("0844 800 0000", "GB", "shared_cost"), ("0909 879 0001", "GB", "premium_rate"),
    ("056 1234 5678", "GB", "voip"), ("070 1234 5678", "GB", "personal_number"), ("076 4012 3456", "GB", "pager"), ("0300 123 4567", "GB", "uan"), ("(212) 555-0123", "US", "fixed_line_or_mobile"), ("1-800-234-5678", "US", "toll_free"),
    ("900 234 5678", "US", "premium_rate"), ("112 555 0123", "US", None), ("416-555-0123", "CA", "fixed_line_or_mobile"), ("0412 345 678", "AU", "mobile"), ("1800 123 456", "AU", "toll_free"), ("13 1450", "AU", "shared_cost"),
    ("06 12345678", "NL", "mobile"), ("0800 1234", "NL", "toll_free"), ("0900 1234567", "NL", "premium_rate"), ("088 1234567", "NL", "uan"), ("066 1234567", "NL", "pager"), ("06 12345", "NL", None), ("0151 23456789", "DE", "mobile"),
    ("030 123456", "DE", "fixed_line"), ("0800 1234567890", "DE", "toll_free"), ("06 12 34 56 78", "FR", "mobile"), ("09 12 34 56 78", "FR", "voip"), ("0470 12 34 56", "BE", "mobile"), ("612 34 56 78", "ES", "mobile"), ("900 123 456", "ES", "toll_free"),
    ("312 345 6789", "IT", "mobile"), ("02 1234 5678", "IT", "fixed_line"), ("912 345 678", "PT", "mobile"), ("085 012 3456", "IE", "mobile"), ("1800 123 456", "IE", "toll_free"), ("0664 123456", "AT", "mobile"), ("078 123 45 67", "CH", "mobile"),
    ("0860 123 456 789", "CH", "voicemail"), ("070-123 45 67", "SE", "mobile"), ("406 12 345", "NO", "mobile"), ("800 12 345", "NO", "toll_free"), ("32 12 34 56", "DK", "fixed_line_or_mobile"), ("041 2345678", "FI", "mobile"), ("512 345 678", "PL", "mobile"),
    ("601 123 456", "CZ", "mobile"), ("06 20 123 4567", "HU", "mobile"), ("0712 034 567", "RO", "mobile"), ("691 234 5678", "GR", "mobile"), ("050 123 4567", "AE", "mobile"), ("+7 495 123 45 67", None, None), ("123", "AE", None), (None, "NL", None),
]


def test_phone_types(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(DIALLED)], "i int, v string, r string, want string").coalesce(1)
    got = rows.select("*", phones.phone_type(F.col("v"), F.col("r")).alias("type"), phones.is_valid_phone(F.col("v"), F.col("r")).alias("ok")).collect()
    assert [(r["v"], r["r"], r["type"], r["ok"]) for r in got] == [(v, c, want, want is not None) for v, c, want in DIALLED]
    assert {c for _, c, _ in DIALLED if c} == set(phones.PLANS)


def places(spark, column, name):
    """In how many places of the plan the column of that name is computed with."""
    rows = spark.createDataFrame([("+31 20 123 4567", "Ann Lee")], "v string, w string").select(column.alias("x"))
    return rows._jdf.queryExecution().analyzed().toString().splitlines()[0].count(f"{name}#")


def test_numbers_are_read_once(spark):
    """Each step of the search through the index had read the whole number anew, and a type had normalised it at each step."""
    from leadloom.functions import numbering

    assert places(spark, numbering.number_type(F.col("v")), "v") == 1
    assert places(spark, phones.e164(F.col("v")), "v") == 1 and places(spark, phones.phone_type(F.col("v")), "v") == 1


def test_guesses_take_names_apart_once(spark):
    """Each guess had taken the name apart anew, and checked the host anew."""
    guesses = emails.email_patterns(F.col("w"), F.col("v"))
    assert places(spark, guesses, "w") == 1 and places(spark, guesses, "v") == 1


def test_number_index_equals_longest_prefix():
    """Every range, at its first and last number, one before and one after, by the index and by the prefixes one by one."""
    from bisect import bisect_right

    from leadloom.functions import numbering

    lows, masks, types = numbering.index()
    known = {p: (k, n) for p, k, n in numbering.ranges()}
    assert lows == sorted(set(lows)) and set(types) <= set(numbering.TYPES)
    for prefix in known:
        for edge in (int(prefix.ljust(15, "0")), int(prefix.ljust(15, "9"))):
            for number in (edge - 1, edge, edge + 1):
                digits = str(number).zfill(15)
                for n in (8, 11, 12, 13):
                    best = next((known[digits[:i]] for i in range(n, 0, -1) if digits[:i] in known), (None, ()))
                    at = bisect_right(lows, int(digits[:n].ljust(15, "0"))) - 1
                    assert (types[at] if masks[at] >> n & 1 else None) == (best[0] if n in best[1] else None)


def test_required_text(spark):
    rows = spark.createDataFrame([(" a ",), ("\t",)], "v string")
    assert rows.where("v <> '\t'").select(text.required_text(F.col("v"), "name").alias("x")).first()["x"] == "a"
    with pytest.raises(Exception, match="Missing required field: name"):
        rows.select(text.required_text(F.col("v"), "name").alias("x")).collect()
