"""The flows end to end on small fixtures, and integrity checks."""

from datetime import datetime

from pyspark.sql import functions as F

from leadloom.operators.leads import ExportFilters
from leadloom.plans import jobs
from leadloom.plans.base import frame
from leadloom.sources import schemas

NOW = datetime(2024, 3, 1)
CARD = '<div class="team-member"><h3>Ann Baker, Owner</h3><a href="https://linkedin.com/in/ann-baker">in</a></div><a href="mailto:info@a.nl">m</a>'


def test_acquire(spark):
    stored = spark.createDataFrame([(7, "Shop", "shop", None, "shop.nl", None, "Netherlands", None, None, None)], "id long, name string, normalized_name string, website string, domain string, phone string, country string, city string, address string, category string")
    rows = [("Shop BV", "https://www.shop.nl/x", None, "020 1", "nederland", None, None, None), ("New  Co", None, None, "020 2", None, "Utrecht", None, "c"), ("New Co", None, None, "020 2", None, None, "Street", None)]
    new = spark.createDataFrame(rows, "name string, website string, domain string, phone string, country string, city string, address string, category string").withColumn("ordinal", F.monotonically_increasing_id())
    out = jobs.acquire(new, stored)
    got = {r["name"]: r for r in out["companies"].collect()}
    assert got["Shop"]["phone"] == "020 1" and got["Shop"]["website"] == "https://shop.nl/x" and got["New Co"]["address"] == "Street" and len(got) == 2
    assert tuple(out["counters"].first()) == (3, 1, 2)


def test_enrich(spark):
    companies = spark.createDataFrame([(1, "https://a.nl"), (2, None), (3, "https://c.nl"), (4, "https://d.nl")], "id long, website string")
    crawls = spark.createDataFrame([(1, 0, "https://a.nl", "Kim Stone, Designer", CARD, datetime(2024, 2, 20)), (3, 0, "https://c.nl", "x", "", datetime(2023, 1, 1)), (4, 0, "https://d.nl", "x", "", datetime(2024, 2, 28))], "company_id long, page int, url string, text string, html string, collected_at timestamp")
    states = spark.createDataFrame([(4, "people_analysis", "completed", 1, None, None, NOW, NOW)], "company_id long, stage string, status string, attempts int, error_type string, error_message string, completed_at timestamp, updated_at timestamp")
    out = jobs.enrich(companies, crawls, states, NOW)
    assert [(r["kind"], r["normalized_value"]) for r in out["contacts"].orderBy("kind").collect()] == [("email", "info@a.nl"), ("linkedin_profile", "https://linkedin.com/in/ann-baker")]
    assert sorted((r["name"], r["title"]) for r in out["people"].collect()) == [("Ann Baker", "Owner"), ("Kim Stone", "Designer")]
    assert [r["company_id"] for r in out["crawl_again"].collect()] == [3] and [r["company_id"] for r in out["without_website"].collect()] == [2]
    assert sorted((r["company_id"], r["status"], r["attempts"]) for r in out["states"].collect()) == [(1, "completed", 1), (3, "failed", 1), (4, "completed", 1)]
    assert {r["score"] for r in out["ranked"].collect()} == {30, 15}


def test_export_and_integrity(spark):
    sf = "/root/testdata/sf0.001"
    t = {n: frame(spark, sf, n) for n in ("companies", "performance", "stages", "people", "contacts", "observations", "technologies")}
    out = jobs.export(t, ExportFilters(has_website=True))
    assert out.count() == t["companies"].where("coalesce(website, '') <> ''").count() and len(out.columns) == 22
    bad = {(r["table"], r["rule"]): r["rows"] for r in schemas.violations({"people": t["people"], "companies": t["companies"], "sources": schemas.empty(spark, "sources")}).collect()}
    assert bad[("sources", "unique name")] == 0 and bad[("people", "company_id in companies")] == t["people"].where("company_id >= 10").count()


def test_from_listings_to_export(spark, tmp_path):
    """One run over new companies, and a second one over others, on the same stores; repeated, each changes nothing."""
    listing = "ordinal long, name string, website string, domain string, phone string, country string, city string, address string, category string"
    first = spark.createDataFrame([(0, "Shop", "https://www.shop.nl", None, "020 1", "nederland", "Delft", None, "c"), (1, "No Site", None, None, "020 2", None, None, None, None), (2, "Gone", "https://gone.nl", None, None, None, None, None, None)], listing)
    later = spark.createDataFrame([(3, "Shop BV", "https://shop.nl/x", None, None, None, None, "Street", None), (4, "Late", "late.nl", None, None, None, None, None, None)], listing)
    report = '{"categories": {"performance": {"score": 0.9}, "seo": {"score": 0.5}}}'
    landed = {
        "technologies": spark.createDataFrame([("shop.nl", '{"https://shop.nl": {"Nginx": {"version": "1.2"}}}')], "domain string, report string"), "performance": spark.createDataFrame([("shop.nl", report), ("late.nl", report)], "domain string, report string"),
        "crawls": spark.createDataFrame([("shop.nl", 0, "https://shop.nl", "", CARD, ["https://shop.nl/team"]), ("late.nl", 0, "https://late.nl", "Kim Stone, Designer", "", [])], "domain string, page int, url string, text string, html string, links array<string>"),
        "verdicts": spark.createDataFrame([("ann.baker@shop.nl", True, "deliverable", 95, "deliverable", False)], "email string, valid boolean, status string, score int, smtp_verdict string, catch_all boolean"),
    }
    out = jobs.run_all(spark, str(tmp_path), "one", first, landed, NOW)
    assert tuple(out["counters"].first()) == (3, 3, 0) and [r["company_id"] for r in out["without_website"].collect()] == [1]
    rows = {r["company_name"]: r for r in out["export"].collect()}
    shop = rows["Shop"]
    assert (shop["technologies"], shop["performance_score"], shop["seo_score"], shop["email"]) == ("Nginx 1.2", 90, 50, "info@a.nl") and "Ann Baker | Owner" in shop["people"] and len(rows) == 3
    assert [(r["name"], r["email"]) for r in out["people"].collect()] == [("Ann Baker", "ann.baker@shop.nl")] and [r["email"] for r in out["person_email"].collect()] == ["ann.baker@shop.nl"]
    state = lambda o: {(r["company_id"], r["stage"]): (r["status"], r["attempts"]) for r in o["states"].collect()}
    assert state(out)[(0, "contacts")] == ("completed", 1) and state(out)[(2, "contacts")] == ("failed", 1) and len(state(out)) == 10
    again = jobs.run_all(spark, str(tmp_path), "one", first, landed, NOW)
    assert state(again) == state(out) and sorted(map(str, again["export"].collect())) == sorted(map(str, rows.values()))
    more = jobs.run_all(spark, str(tmp_path), "two", later, landed, NOW)
    assert tuple(more["counters"].first()) == (2, 1, 1)
    assert state(more)[(0, "contacts")] == ("completed", 1) and state(more)[(2, "contacts")] == ("failed", 2) and state(more)[(4, "people_analysis")] == ("completed", 1)
    rows = {r["company_name"]: r for r in more["export"].collect()}
    assert len(rows) == 4 and rows["Shop"]["address"] == "Street" and rows["Shop"]["technologies"] == "Nginx 1.2" and "Kim Stone" in rows["Late"]["people"]
