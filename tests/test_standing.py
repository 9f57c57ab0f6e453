"""Standing latest rows, bitmaps of ids, bucketed crawls and identity keys."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leadloom.functions.person import person_match_keys
from leadloom.operators import bitmaps, outreach, standing
from leadloom.sources import crawl_tables

T0 = datetime(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_in_any_order(spark, tmp_path):
    rng = random.Random(1)
    schema = "id long, company_id long, score int, observed_at timestamp"
    rows = [(i, rng.randrange(8) if rng.random() < 0.6 else 0, rng.choice([None, i]), None if i % 9 == 0 else T0 + timedelta(days=rng.randrange(5))) for i in range(120)] + [(500, None, 1, T0), (501, 99, 1, None)]
    want = {}
    for r in rows:
        if r[1] is not None:
            want[r[1]] = max(want.get(r[1], r), r, key=lambda x: (x[3] is not None, x[3] or T0, x[0]))
    empty = spark.createDataFrame([], schema)
    for n in range(2):
        store = standing.latest_store(spark, str(tmp_path / f"s{n}"), empty, ["company_id"], buckets=4)
        rng.shuffle(rows)
        for at in range(0, len(rows), 50):  # the first part comes again, late
            standing.merge_latest(store, f"b{at}", spark.createDataFrame(rows[at : at + 50], schema))
        standing.merge_latest(store, "again", spark.createDataFrame(rows[:50], schema))
        assert sorted(map(tuple, store.read().collect())) == sorted(want.values())


def test_bitmaps(spark):
    rng = random.Random(2)
    ids = [rng.choice([rng.randrange(-70_000, 70_000), rng.randrange(10), 32767, 32768, 32769, 10**12]) for _ in range(3000)]
    some = spark.createDataFrame([(i, j % 3) for j, i in enumerate(ids)] + [(None, 0)], "id long, stage int")
    rows = spark.createDataFrame([(i + d, "x") for i in ids[:500] for d in (0, 1)] + [(None, "y")], "company_id long, bits string")
    b = bitmaps.bitmap(some, "id")
    own = set(ids)
    assert sorted(r[0] for r in bitmaps.members(rows, "company_id", b).collect()) == sorted(i + d for i in ids[:500] for d in (0, 1) if i + d in own)
    out = bitmaps.members(rows, "company_id", b, inside=False)
    assert out.columns == rows.columns and sorted((r[0] or 0 for r in out.collect())) == sorted([i + d for i in ids[:500] for d in (0, 1) if i + d not in own] + [0])
    each = bitmaps.bitmap(some, "id", ["stage"])
    assert {r["stage"]: r["ids"] for r in bitmaps.sizes(each, ["stage"]).collect()} == {s: len(set(ids[s::3])) for s in range(3)}
    assert bitmaps.sizes(bitmaps.united(each), []).first()["ids"] == len(own)


def test_a_bitmap_moves_no_rows(spark, tmp_path):
    """The rows are scanned and joined in one stage; only the bitmap is exchanged."""
    spark.range(5000).selectExpr("id", "id % 50 AS company_id", "repeat('x', 20) AS value").write.parquet(f"{tmp_path}/rows")
    spark.range(0, 50, 3).write.parquet(f"{tmp_path}/ids")
    got = bitmaps.members(spark.read.parquet(f"{tmp_path}/rows"), "company_id", bitmaps.bitmap(spark.read.parquet(f"{tmp_path}/ids"), "id"))
    assert got.count() == 1700
    text = plan_of(got)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning(company_id" not in text


def test_last_crawls_stay_where_they_lie(spark, tmp_path):
    crawls = spark.range(200).selectExpr("id", "id % 9 AS company_id", "concat('u', id) AS url", "200 AS status_code", "repeat('<p>', 50) AS html", "'t' AS text", "CAST(NULL AS STRING) AS title", "CAST(NULL AS STRING) AS meta_description", "CAST(NULL AS TIMESTAMP) AS collected_at")
    links = spark.createDataFrame([(5, "b"), (5, "a"), (5, "a"), (7, None)], "website_crawl_id long, url string")
    crawl_tables.write_crawls(crawls, links, "t_last", str(tmp_path), buckets=4)
    states = spark.createDataFrame([(1, 5), (2, 7), (3, None), (4, 999), (5, 5)], "company_id long, last_crawl_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the states are many
    try:
        got = crawl_tables.last_crawls(spark, "t_last", states)
        text = plan_of(got)
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r["company_id"], r["crawl_id"], r["url"], r["links"]) for r in rows) == [(1, 5, "u5", ["a", "b"]), (2, 7, "u7", []), (5, 5, "u5", ["a", "b"])]
    assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in text, text


def test_keys_in_order(spark):
    said = [(1, "Ann Lee", "https://linkedin.com/in/ann", "other", "low", False), (2, "Ann Lee", None, "primary", "high", True), (3, "Bo Ek", None, "secondary", "low", False), (4, "Bo Ek", None, "secondary", "low", False)]
    classified = spark.createDataFrame(said, "ordinal long, name string, linkedin string, role_group string, confidence string, is_decision_maker boolean")
    people = spark.createDataFrame([(1, "Else", "https://www.linkedin.com/in/ANN/"), (2, "ann  lee", None), (3, "Bo Ek", "https://linkedin.com/in/nobody"), (4, "No One", None), (5, None, None), (6, "Bo Ek", None)], "person_id long, name string, linkedin string")
    keys = person_match_keys(F.col("name"), F.col("linkedin")).alias("keys")
    got = outreach.classify(people.select("person_id", keys), classified.select("*", keys).drop("name", "linkedin"))
    assert sorted((r["person_id"], r["role_group"], r["confidence"], r["is_decision_maker"], r["matched_by"]) for r in got.collect()) == [
        (1, "other", "low", False, "linkedin"), (2, "primary", "high", True, "name"), (3, "secondary", "low", False, "name"), (4, "unknown", "low", False, None), (5, "unknown", "low", False, None), (6, "secondary", "low", False, "name")
    ]
