"""Stored tables that are updated in part: results of any split into runs, files that stay, runs that were lost half-way."""

import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leadloom.operators import companies as C
from leadloom.operators import state
from leadloom.plans import jobs
from leadloom.sources import store as S

LISTING = "ordinal long, name string, website string, domain string, phone string, country string, city string, address string, category string"


def listings(n, seed):
    """Rows of shared domains, phones and names, a third of them with one name."""
    rng = random.Random(seed)
    maybe = lambda v, p=0.5: v if rng.random() < p else None
    return [
        (i, "Chain" if rng.random() < 0.33 else f"n{rng.randrange(n // 8)}", maybe(f"https://d{rng.randrange(n // 5)}.nl", 0.3), None, maybe(f"p{rng.randrange(n // 5)}", 0.3), maybe("Netherlands"), maybe(f"c{rng.randrange(3)}"),
         maybe(f"a{rng.randrange(4)}", 0.2), maybe("k")) for i in range(n)
    ]


def one_by_one(rows):
    """The upserts in order, as a list of companies."""
    out = []
    for r in rows:
        place = [k for k in ("city", "country", "address") if r[k] is not None]
        hit = next((c for c in out if r["domain"] is not None and c["domain"] == r["domain"]), None)
        hit = hit or next((c for c in out if r["phone"] is not None and c["phone"] == r["phone"]), None)
        hit = hit or next((c for c in out if place and c["normalized_name"] == r["normalized_name"] and all(c[k] == r[k] for k in place)), None)
        if hit is None:
            out.append(dict(r, rows=1))
        else:
            hit["rows"] += 1
            hit |= {k: r[k] for k in C.FILLED if hit[k] is None}
    return sorted((c["ordinal"], c["name"], *[c[k] for k in C.FILLED], c["rows"]) for c in out)


def stored(companies):
    return sorted((r["id"], r["name"], *[r[k] for k in C.FILLED], r["rows"]) for r in companies.read().collect())


@pytest.mark.parametrize("cuts", [(), (60, 61)])
def test_runs_equal_one_fold(spark, tmp_path, cuts):
    rows = listings(120, 4)
    frame = spark.createDataFrame(rows, LISTING)
    normal = C.normalize_records(frame)
    want = one_by_one([r.asDict() for r in normal.orderBy("ordinal").collect()])
    if not cuts:
        for chunks in (3, 64):
            folded = C.fold_companies(normal, chunks=chunks).collect()
            assert sorted((r["company_ordinal"], r["name"], *[r[k] for k in C.FILLED], r["rows"]) for r in folded) == want
        return
    companies, index = jobs.company_stores(spark, str(tmp_path / "s"), buckets=4)
    counts = []
    for low, high in zip((0, *cuts), (*cuts, len(rows))):
        counts.append(jobs.acquire_run(companies, index, f"to-{high}", frame.where((F.col("ordinal") >= low) & (F.col("ordinal") < high))).first())
    assert stored(companies) == want
    assert sum(c["new"] for c in counts) == len(want) and sum(c["found"] for c in counts) == len(rows) and all(c["duplicates"] == c["found"] - c["new"] for c in counts)
    # the index has the lowest company of each key
    held = companies.read().select("id", F.explode(C.held_keys()).alias("k")).groupBy(*[F.col(f"k.{k}") for k in C.KEY]).agg(F.min("id").alias("id"))
    assert sorted(map(repr, index.read().select(*C.KEY, "id").collect())) == sorted(map(repr, held.select(*C.KEY, "id").collect()))


def test_runs_read_what_they_touch(spark, tmp_path):
    companies, index = jobs.company_stores(spark, str(tmp_path / "s"), buckets=8)
    jobs.acquire_run(companies, index, "first", spark.createDataFrame(listings(100, 5), LISTING))
    asked = spark.createDataFrame([("domain", "d1.nl", None, None, None)], "field string, value string, city string, country string, address string")
    found = index.among(asked)
    assert found.count() == 1
    plan = companies.among(found.select("id"))._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "PartitionFilters: [isnotnull(bucket" in plan.replace("PartitionFilters: [bucket", "PartitionFilters: [isnotnull(bucket") and companies.among(found.select("id")).count() == 1


def test_a_run_reads_its_listings_once(spark, tmp_path):
    """They had been read and normalised anew for each look into the stored tables and each part of the fold."""
    seen = spark.sparkContext.accumulator(0)

    def counted(name):
        seen.add(1)
        return name

    rows = spark.createDataFrame(listings(20, 7), LISTING).withColumn("name", F.udf(counted, "string").asNondeterministic()("name"))
    jobs.acquire_run(*jobs.company_stores(spark, str(tmp_path / "s"), buckets=4), "first", rows)
    assert seen.value == 20


def test_lost_run_is_repeated(spark, tmp_path, monkeypatch):
    """A run that ends between the tables is repeated as a whole."""
    rows = spark.createDataFrame(listings(80, 6), LISTING)
    plain, other = (jobs.company_stores(spark, str(tmp_path / n), buckets=4) for n in ("a", "b"))
    for s in (plain, other):
        jobs.acquire_run(*s, "first", rows.where("ordinal < 40"))
    jobs.acquire_run(*plain, "second", rows.where("ordinal >= 40"))
    with monkeypatch.context() as m:
        m.setattr(other[1], "update", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            jobs.acquire_run(*other, "second", rows.where("ordinal >= 40"))
    for _ in range(2):
        jobs.acquire_run(*other, "second", rows.where("ordinal >= 40"))
    assert stored(other[0]) == stored(plain[0])
    assert sorted(map(repr, other[1].read().collect())) == sorted(map(repr, plain[1].read().collect()))


def files(path):
    return {str(p.relative_to(path)) for p in Path(path, "live").rglob("*.parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "t"), "id long, name string", ["id"], buckets=16)
    assert s.read().collect() == []
    s.update("one", spark.range(100).selectExpr("id", "'a' AS name"), S.replaced(["id"]))
    before = files(tmp_path / "t")
    new = spark.createDataFrame([(3, "b"), (1000, "c")], "id long, name string")
    touched = {f"bucket={b}" for b in s.touched(new)}
    s.update("two", new, S.replaced(["id"]))
    after = files(tmp_path / "t")
    assert {f for f in before if f.split("/")[1] not in touched} == {f for f in after if f.split("/")[1] not in touched} and len(touched) <= 2
    assert not {f for f in before if f.split("/")[1] in touched} & after
    got = {r["id"]: r["name"] for r in s.read().collect()}
    assert len(got) == 101 and got[3] == "b" and got[1000] == "c" and got[4] == "a"
    # a run without rows and a repeated run leave all files as they are
    s.update("none", new.limit(0), S.replaced(["id"]))
    s.update("two", spark.createDataFrame([(3, "z")], "id long, name string"), S.replaced(["id"]))
    assert files(tmp_path / "t") == after


def test_a_merge_that_counts_is_applied_once(spark, tmp_path, monkeypatch):
    """Attempts grow by one, though the run was lost after its buckets had been stored, and after they had been put in place."""
    states = jobs.state_store(spark, str(tmp_path / "t"), buckets=4)
    out = spark.createDataFrame([(1, "contacts", True, None, None), (2, "contacts", False, "E", "m")], "company_id long, stage string, ok boolean, error_type string, error_message string")
    now = datetime(2024, 3, 1)
    jobs.store_outcomes(states, "one", out, now)
    for lost in ("stored", "applied"):
        with monkeypatch.context() as m:
            m.setattr(states, "_note", lambda run, step, lost=lost, note=states._note: 1 / 0 if step == lost else note(run, step))
            with pytest.raises(ZeroDivisionError):
                jobs.store_outcomes(states, lost, out, now)
        jobs.store_outcomes(states, lost, out, now)
    got = sorted((r["company_id"], r["status"], r["attempts"]) for r in states.read().collect())
    assert got == [(1, "completed", 3), (2, "failed", 3)]
    assert state.pending(out.select("company_id"), states.read(), "contacts").count() == 1


def test_null_keys(spark, tmp_path):
    p = jobs.provenance_store(spark, str(tmp_path / "t"), buckets=4)
    t = datetime(2024, 1, 1)
    rows = [(1, 5, 1, "x", t), (2, 5, 1, None, t), (3, 5, 1, None, t)]
    schema = "id long, company_id long, source_id int, external_id string, collected_at timestamp"
    jobs.record_provenance(p, "one", spark.createDataFrame(rows, schema))
    jobs.record_provenance(p, "two", spark.createDataFrame([(4, 6, 1, "x", datetime(2024, 1, 2)), (5, 5, 1, None, t), (6, 7, None, "x", t)], schema))
    assert sorted((r["id"], r["company_id"]) for r in p.read().collect()) == [(2, 5), (3, 5), (4, 6), (5, 5), (6, 7)]
    among = p.among(spark.createDataFrame([(None, "x", None), (1, None, 3)], "source_id int, external_id string, lone long"))
    assert sorted(r["id"] for r in among.collect()) == [3, 6]


def test_emails_of_stored_people(spark, tmp_path):
    people = S.Store(spark, str(tmp_path / "t"), "id long, name string, email string", ["id"], buckets=4)
    people.update("import", spark.createDataFrame([(1, "A", None), (2, "B", "b@x")], people.schema), S.replaced(["id"]))
    seen = spark.createDataFrame([(1, "late@x", 2, True), (1, "a@x", 1, True), (2, "no@x", 0, False), (9, "lost@x", 0, True)], "person_id long, email string, attempt int, is_qualified boolean")
    jobs.store_emails(people, "run", seen)
    assert sorted(tuple(r) for r in people.read().collect()) == [(1, "A", "a@x"), (2, "B", "b@x")]
