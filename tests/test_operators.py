"""Operators against DuckDB and brute force."""

import random
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from leadloom.operators import companies, components, extraction, identity, leads, outreach, plan, state
from leadloom.plans import catalogue, stored  # noqa: F401  (each registers its queries)
from leadloom.sources import providers, readers, sinks
from leadloom.streaming import landing

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return x.replace(tzinfo=None) if isinstance(x, datetime) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name in catalogue.SQL:
        found = duck.execute(catalogue.SQL[name])
        columns = [d[0] for d in found.description]
        want = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in found.fetchall())
        assert sorted(columns) == sorted(df.columns) and rows == want
    else:
        assert rows


def brute_fold(rows):
    out = []
    for r in rows:
        place = {k: r[k] for k in ("city", "country", "address") if r[k] is not None}
        tests = [lambda c: r["domain"] is not None and c["domain"] == r["domain"], lambda c: r["phone"] is not None and c["phone"] == r["phone"]]
        tests += [lambda c: c["normalized_name"] == r["normalized_name"] and all(c[k] == v for k, v in place.items())] if place else []
        hit = next((c for t in tests for c in out if t(c)), None)
        if hit is None:
            out.append(hit := dict(r) | {"rows": 0})
        hit["rows"] += 1
        for k in companies.FILLED:
            hit[k] = hit[k] if hit[k] is not None else r[k]
    return out


def test_company_fold_against_brute_force(spark):
    rng = random.Random(8)
    maybe = lambda v, p=0.5: v if rng.random() < p else None
    rows = [
        {"ordinal": i, "name": f"N{i}", "normalized_name": f"n{rng.randrange(60)}", "website": maybe("w"), "domain": maybe(f"d{rng.randrange(80)}", 0.3), "phone": maybe(f"p{rng.randrange(80)}", 0.3),
         "country": maybe("NL"), "city": maybe(f"c{rng.randrange(3)}"), "address": maybe(f"a{rng.randrange(4)}", 0.2), "category": maybe("k")}
        for i in range(400)
    ]
    schema = "ordinal long, name string, normalized_name string, website string, domain string, phone string, country string, city string, address string, category string"
    got = companies.fold_companies(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect()
    key = ("name", "rows", *companies.FILLED)
    assert sorted(repr([r[k] for k in key]) for r in got) == sorted(repr([r[k] for k in key]) for r in brute_fold(rows))


def test_company_fold_broadcasts_nothing_and_settles(spark, monkeypatch):
    """Companies that were joined by mistake in a round don't cost a round for each link of their chain."""
    nations = [r[0] for r in catalogue.read(spark, SF, "customer").select("c_nationkey").orderBy("c_custkey").collect()]
    plans, keep = [], companies.materialized
    monkeypatch.setattr(companies, "materialized", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    many = spark.range(9000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("N"), "id").alias("c_name"), F.get(F.lit(nations), (F.col("id") % len(nations)).cast("int")).alias("c_nationkey"), F.lit("m").alias("c_mktsegment"))
    monkeypatch.setattr(catalogue, "read", lambda *a: many)
    assert catalogue.QUERIES["d3_company_fold"](spark, SF).agg(F.sum("rows")).first()[0] == 9000
    assert len(plans) <= 5 and not any("Broadcast" in p for p in plans)  # the rows and their rounds


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1300)] + [(k, k + 1) for k in range(2000, 2100)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_identity(spark):
    p = identity.Person
    assert identity.compare(p("Jon Smith", None, None, "https://a.nl/team"), p("John Smith", None, None, "https://www.a.nl/x"))[0] == "same"
    assert identity.compare(p("Jon Smith", None, None, "https://a.nl"), p("John Smith", None, None, "https://b.nl"))[0] == "possible"
    assert identity.compare(p("A B", None, "https://linkedin.com/in/a", None), p("A B", None, "https://linkedin.com/in/b", None)) == ("different", 0.0)
    rows = [(1, 0, "Jon Smith", "CEO", None, "https://a.nl"), (1, 1, "John Smith", "Chief Executive", "https://linkedin.com/in/js", "https://a.nl/team"), (1, 2, "Ann Lee", None, None, "https://a.nl"), (2, 0, "Ann Lee", None, None, "https://b.nl"), (2, 1, "Ann Lee", None, None, "https://b.nl")]
    df = spark.createDataFrame(rows, "company_id long, ordinal int, name string, title string, linkedin_url string, source_url string")
    got = sorted((r["company_id"], r["name"], r["title"], r["sources"]) for r in identity.resolve_people(df).collect())
    assert got == [(1, "Ann Lee", None, 1), (1, "John Smith", "Chief Executive", 2), (2, "Ann Lee", None, 2)]


def test_states(spark):
    with pytest.raises(Exception, match="illegal"):
        spark.createDataFrame([("pending", "completed")], "a string, b string").select(state.transition(F.col("a"), F.col("b"))).collect()
    with pytest.raises(ValueError):
        leads.ExportFilters(min_seo=101)
    with pytest.raises(ValueError):
        leads.ExportFilters(min_seo=60, max_seo=50)


def test_listings(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,place_id,website,extra,address,complete_address\n"A, ""x""\nb",p1,https://www.A.com/x,z,,Street 1\nB,p1,,,,\n,p2,,,,\nC,,,,Road 2,\n', "utf-8")
    raw = readers.read_listings(spark, str(tmp_path / "a.csv")).withColumn("ordinal", F.monotonically_increasing_id())
    assert raw.count() == 4 and readers.count_listings(spark, str(tmp_path / "none.csv")) == 0
    got = readers.load_results(raw, "Utrecht", "Netherlands").collect()
    assert sorted((r["name"], r["domain"], r["address"], r["external_id"]) for r in got) == [('A, "x"\nb', "a.com", "Street 1", "p1"), ("C", None, "Road 2", None)]
    assert readers.load_results(raw, None, None, limit=1).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None, datetime(2026, 8, 14, 12)), (1, 'a,"b"', None)], "id int, name string, at timestamp")
    sinks.write_leads(df, str(tmp_path / "out"), order=["id"], single=True)
    text = next((tmp_path / "out").glob("part-*")).read_text().splitlines()
    assert text == ["id,name,at", '1,"a,""b""",', "2,,2026-08-14T12:00:00Z"]
    sinks.append(df, str(tmp_path / "t"), "at")
    sinks.append(df, str(tmp_path / "t"), "at")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_plan(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("name: p\ncountry: {name: Netherlands, code: NL}\ncities: {u: {name: Utrecht}}\ntargets:\n- {segment: s, priority: low, keywords: [Dentist, dentist, x], cities: [u]}\n- {segment: t, priority: high, keywords: [y], cities: [u]}\n")
    q = plan.expand(plan.plan_targets(spark, plan.load_plan(str(tmp_path), "p"))).orderBy("run_order").collect()
    assert [(r["segment"], r["keyword"]) for r in q] == [("t", "y"), ("s", "Dentist"), ("s", "x")]
    with pytest.raises(ValueError):
        plan.load_plan(str(tmp_path), "../p")


def test_provider(spark):
    class Upper:
        schema = "id long, out string"

        def answer(self, requests):
            for r in requests:
                if r["text"] is None:
                    raise ValueError("no text")
                yield {"id": r["id"], "out": r["text"].upper()}

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, text string")
    got = {r["id"]: (r["out"], r["error_type"]) for r in providers.call(Upper(), df, tasks=2).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError"), 3: ("C", None)}


def test_contacts_and_candidates(spark):
    pages = spark.createDataFrame([(1, 0, "https://a.nl", "mail Ann@A.nl now", '<a href="mailto:ann@a.nl">x</a>'), (1, 1, "https://a.nl/x", None, None), (2, 0, None, "", "<p>")], "company_id long, page int, url string, text string, html string")
    found = extraction.contacts(pages)
    assert [(r["kind"], r["normalized_value"]) for r in extraction.normalize_contacts(found).collect()] == [("email", "ann@a.nl")]
    targets = spark.createDataFrame([(1, 1, "Ann Lee", "X@a.nl"), (2, 1, "Kim", None)], "person_id long, company_id long, name string, email string")
    rows = outreach.verification_candidates(targets, F.lit("a.nl")).orderBy("person_id", "attempt").collect()
    assert (rows[0]["email"], rows[0]["from_pattern"]) == ("x@a.nl", False) and rows[1]["from_pattern"] and rows[-1]["email"] == "kim@a.nl"


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = landing.event_windows(stream, late="40 days").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    row = lambda r: (str(r["start"]), r["event_type"], r["n"], round(r["total"], 4))
    assert sorted(map(row, spark.table("w").collect())) == sorted(map(row, landing.event_windows(events).collect()))
