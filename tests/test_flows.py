"""Landing, limits, answers, files and the e-mail stage on small fixtures."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leadloom.errors import DailyLimitError, LoadError
from leadloom.functions import phones, vocabulary
from leadloom.operators import extraction
from leadloom.plans import jobs
from leadloom.sources import answers, providers, readers, sinks
from leadloom.streaming import landing

NOW = datetime(2024, 3, 1)


def test_limiter():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(round(seconds, 6))
        now[0] += seconds

    limiter = providers.Limiter(3, 5, clock=lambda: now[0], sleep=sleep, day=lambda: "day" + str(int(now[0] // 86_400)))
    for _ in range(4):
        limiter.acquire()
    assert slept == [20, 20, 20] and now[0] == 60
    limiter.cool_down(100)
    limiter.acquire()
    assert now[0] == 160
    with pytest.raises(DailyLimitError):
        limiter.acquire()
    now[0] = 90_000
    limiter.acquire()
    with pytest.raises(ValueError):
        providers.Limiter(0, 1)


def test_answers(spark):
    good = '{"people": [{"name": "Ann", "decision_maker": false, "role_group": "other", "decision_maker_confidence": "low"}]}'
    bad = [good.replace('"Ann"', '" "'), good.replace('"other"', '"boss"'), good.replace("false", "null"), good.replace('"low"', '"sure"'), "no", "", None, "[]"]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate([good, f"```json\n{good}\n```", f"```{good}```", '{"people": []}', *bad])], "id int, answer string")
    got = [r["p"] for r in rows.select("id", answers.parse_answer(F.col("answer")).alias("p")).orderBy("id").collect()]
    assert [len(p) for p in got[:4]] == [1, 1, 1, 0] and got[4:] == [None] * len(bad)


def test_final_read(spark, tmp_path):
    with pytest.raises(LoadError):
        readers.read_final(spark, str(tmp_path / "missing.csv"), attempts=2, pause=0.01)
    (tmp_path / "empty.csv").write_text("title,place_id\n")
    with pytest.raises(LoadError):
        readers.read_final(spark, str(tmp_path / "empty.csv"), pause=0.01)
    (tmp_path / "one.csv").write_text("title,place_id\nShop,p1\n")
    assert readers.read_final(spark, str(tmp_path / "one.csv")).count() == 1


def test_listings_stream_once(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    header = ",".join(f.split(" ")[0] for f in readers.LISTING.split(", ")[:-1])
    for k, rows in enumerate((["A,,,,,,p1,,", "B,,,,,,,,", "C,,,,,,,c1,"], ["A again,,,,,,p1,,", "B,,,,,,,,", "D,,,,,,p2,,"])):
        (folder / f"{k}.csv").write_text("\n".join([header, *rows]) + "\n")
        q = landing.listing_stream(spark, str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(out))
        q.awaitTermination(120)
    assert sorted(r["name"] for r in spark.read.parquet(str(out)).collect()) == ["A", "B", "B", "C", "D"]


def test_stamped_file(spark, tmp_path):
    path = sinks.write_stamped(spark.createDataFrame([(1, "Café"), (2, None)], "company_id int, name string"), str(tmp_path), "leads", datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("leads_2024-01-02_03-04-05.csv")
    (part,) = __import__("pathlib").Path(path).glob("part-*")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfcompany_id,name\n") and part.read_text("utf-8-sig").splitlines()[1] == "1,Café"


def test_phones_against_brute_force(spark):
    pattern = re.compile(vocabulary.PHONE_TEXT)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").unionByName(spark.createDataFrame([("+31 (0)20 123 4567 or 020 123 4567, 11-11-11 and +31 20 123 4567",), ("12 345 678 @", ), (None,)], "text string"))
    got = [r for r in docs.select("text", phones.extract_phones(F.col("text")).alias("p")).collect()]
    seen = 0
    for text, found in got:
        want = {}
        for m in pattern.findall(text or ""):
            v = m.strip().split("?")[0].split(";")[0].strip()
            digits = re.sub(r"\D", "", v)
            if 7 <= len(digits) <= 15 and len(set(digits)) > 1:
                want.setdefault(digits, "+" + digits if v.startswith("+") else digits)
        assert found == sorted(want.values())
        seen += len(found)
    assert seen > 5


def test_card_title_and_single_parse(spark):
    page = '<div class="team-member person-card"><h3>Ann Baker, Owner</h3><p>Hello</p></div><a href="mailto:a@b.nl">m</a>'
    pages = spark.createDataFrame([(1, 0, "https://b.nl", "", page)], "company_id long, page int, url string, text string, html string")
    once = extraction.parsed(pages)
    for f in (extraction.people, extraction.contacts):
        assert f(once).collect() == f(pages).collect() != []
    from leadloom.functions import html
    from leadloom.functions import people as P

    root = html.parse("<div><h3>Ann Baker</h3><p>Ann Baker</p><span>x</span><p>Managing Director</p></div>")
    heading = next(n for n in root.walk() if n.tag == "h3")
    assert P.card_title(root.children[0], heading, "Ann Baker") == "Managing Director" and P.card_title(heading, heading, "x") is None


def test_email_stage(spark):
    people = spark.createDataFrame([(1, 9, "Ann Baker", None, None, "Info@Shop.com"), (2, 9, "Kim Stone", None, None, None), (3, 9, "Lee Wood", None, None, "bad"), (4, 9, "Jan Smit", None, None, "jan@shop.com")], "id long, company_id long, name string, title string, linkedin_url string, email string")
    seen = spark.createDataFrame([], "id long, person_id long, title string, linkedin_url string, observed_at timestamp")
    companies = spark.createDataFrame([(9, "shop.com")], "id long, domain string")
    known = spark.createDataFrame([(4, "jan@shop.com", "deliverable")], "person_id long, normalized_email string, verification_result string")
    tell = lambda e, s: (e, s == "deliverable", s, 90, "deliverable" if s == "deliverable" else "undeliverable", False)
    verdicts = [tell("info@shop.com", "deliverable"), tell("kim.stone@shop.com", "undeliverable"), tell("kim@shop.com", "deliverable")]
    verdicts = spark.createDataFrame(verdicts, "email string, valid boolean, status string, score int, smtp_verdict string, catch_all boolean")
    out = jobs.email_stage(people, seen, companies, verdicts, known, NOW)
    assert {r["id"]: r["email"] for r in out["people"].collect()} == {1: "info@shop.com", 2: "kim@shop.com", 3: "bad", 4: "jan@shop.com"}
    got = sorted((r["person_id"], r["normalized_email"], r["pattern_inferred"]) for r in out["observations"].collect())
    assert got == [(1, "info@shop.com", False), (2, "kim.stone@shop.com", True), (2, "kim@shop.com", True)]
    c = out["counters"].first()
    assert (c["attempted"], c["already_verified"], c["verified"], c["qualified"], c["persisted"]) == (4, 1, 3, 2, 3)
