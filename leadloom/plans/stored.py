"""Registered queries over tables that are kept and updated in part, and their DuckDB forms. The stored tables are derived from the driver's ones, run by run."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import companies as C
from ..operators import bitmaps, extraction, outreach, schedule, standing, state
from ..sources import answers, crawl_tables, landed, providers, readers
from ..sources.store import Store, shared_path
from ..streaming import crawl_states
from . import jobs
from .base import ctes, frame, read
from .catalogue import SQL, query

# Companies and their keys ----------------------------------------------------------------------------------------------


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as listings that share domains, phones and names."""
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS ordinal", "c_name AS name", "CASE WHEN c_custkey % 2 = 0 THEN concat('https://www.d', c_custkey % 400, '.com/x') END AS website", "CAST(NULL AS STRING) AS domain",
        "CASE WHEN c_custkey % 3 = 0 THEN concat('+ ', c_custkey % 500) END AS phone", "concat('N', c_nationkey) AS country", "CASE WHEN c_custkey % 5 = 0 THEN concat('City ', c_custkey % 7) END AS city",
        "CAST(NULL AS STRING) AS address", "c_mktsegment AS category",
    )


@query()
def k3_indexed_runs(spark, sf_dir):
    """Three runs of listings into stored companies through the key index. The fold depends on order; compared with the fold of all listings at once, and with brute force, in tests."""
    rows, most = _listings(spark, sf_dir), read(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    companies, index = jobs.company_stores(spark, shared_path(spark, "companies"), buckets=8)
    for run, (low, high) in {"first": (-1, most // 2), "second": (most // 2, most * 3 // 4), "third": (most * 3 // 4, most)}.items():
        jobs.acquire_run(companies, index, run, rows.where((F.col("ordinal") > low) & (F.col("ordinal") <= high)))
    return companies.read()


@query(
    "WITH s AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'w' || s_suppkey END AS website, CAST(NULL AS VARCHAR) AS phone FROM supplier), "
    "i AS (SELECT c_custkey AS id, c_name AS name, 'new' || c_custkey AS website, CASE WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey END AS phone FROM customer) "
    "SELECT coalesce(s.id, i.id) AS id, CASE WHEN s.id IS NOT NULL THEN s.name ELSE i.name END AS name, coalesce(s.website, i.website) AS website, coalesce(s.phone, i.phone) AS phone FROM s FULL JOIN i ON s.id = i.id"
)
def k4_fill_missing(spark, sf_dir):
    """Stored rows whose gaps later runs fill, each run rewriting the buckets of its own keys only. A run that is repeated changes nothing."""
    store = Store(spark, shared_path(spark, "filled"), "id long, name string, website string, phone string", ["id"], buckets=16)
    store.update("first", read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "CASE WHEN s_suppkey % 2 = 0 THEN concat('w', s_suppkey) END AS website", "CAST(NULL AS STRING) AS phone"), _fill)
    incoming = read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "concat('new', c_custkey) AS website", "CASE WHEN c_custkey % 3 = 0 THEN concat('p', c_custkey) END AS phone")
    for run, part in (("second", "id % 2 = 0"), ("third", "id % 2 <> 0"), ("second", "id % 2 = 0")):
        store.update(run, incoming.where(part), _fill)
    return store.read()


def _fill(current: DataFrame, deltas: DataFrame) -> DataFrame:
    return C.upsert_snapshot(current, deltas, "id", ["website", "phone"])


@query(SQL["k6_provenance"])
def k6_stored_provenance(spark, sf_dir):
    """The latest record of each source and external id, over two runs into a stored table."""
    records = frame(spark, sf_dir, "source_records")
    store = jobs.provenance_store(spark, shared_path(spark, "provenance"), buckets=8)
    own = records.withColumn("collected_at", F.col("collected_at").cast("timestamp"))
    for run, part in {"later": "company_id >= 40", "earlier": "company_id < 40"}.items():
        jobs.record_provenance(store, run, own.where(part))
    return store.read().withColumn("collected_at", F.col("collected_at").cast("timestamp_ntz")).drop("lone")


@query(
    ctes("people", "email_observations")
    + ", q AS (SELECT person_id, arg_min(normalized_email, id) AS found FROM email_observations WHERE verification_result = 'deliverable' GROUP BY person_id) SELECT p.id, name, coalesce(found, email) AS email FROM people p LEFT JOIN q ON p.id = q.person_id"
)
def k16_person_emails(spark, sf_dir):
    """Qualified addresses into the stored people whom they were found for; people of other buckets aren't read."""
    people = Store(spark, shared_path(spark, "people"), "id long, name string, email string", ["id"], buckets=16)
    people.update("import", frame(spark, sf_dir, "people").select("id", "name", "email"), lambda current, deltas: current.unionByName(deltas))
    found = frame(spark, sf_dir, "email_observations").selectExpr("person_id", "normalized_email AS email", "id AS attempt", "verification_result = 'deliverable' AS is_qualified")
    jobs.store_emails(people, "verification", found)
    return people.read()


@query(SQL["t2_advance"])
def t2_stored_states(spark, sf_dir):
    """Outcomes of a run into stored stage states. Attempts grow by one however often the run is repeated."""
    e = read(spark, sf_dir, "events")
    states = jobs.state_store(spark, shared_path(spark, "states"), buckets=8)
    old = e.groupBy(F.col("user_id").alias("company_id"), F.col("event_type").alias("stage")).agg(F.count("*").cast("int").alias("attempts"))
    states.update("import", old.selectExpr("*", "'failed' AS status", "'Old' AS error_type", "'m' AS error_message", "CAST(NULL AS timestamp) AS completed_at", "CAST(NULL AS timestamp) AS updated_at"), lambda current, deltas: current.unionByName(deltas.select(*current.columns)))
    outcomes = e.groupBy((F.col("user_id") * 2).alias("company_id"), F.col("event_type").alias("stage")).agg((F.max("event_id") % 3 != 0).alias("ok")).selectExpr("*", "'Timeout' AS error_type", "'slow' AS error_message")
    for _ in range(2):
        jobs.store_outcomes(states, "2024-02-01", outcomes, datetime(2024, 2, 1))
    return states.read().select("company_id", "stage", "status", "attempts", "error_type")


# Streams ---------------------------------------------------------------------------------------------------------------

_KIND = "CASE WHEN event_id % 3 = 0 OR event_type = 'click' THEN 'started' WHEN value > 40 THEN 'completed' ELSE 'failed' END"
_LEGAL = " OR ".join(f"(s.status = '{a}' AND w = '{b}')" for a, bs in state.TRANSITIONS.items() for b in bs)


@query(
    f"WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY seq) AS n FROM (SELECT event_id AS seq, user_id AS company_id, {_KIND} AS kind, ts AS t, event_id * 10 AS crawl_id, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 1 HOUR END AS next_retry_at FROM events)), "
    "s AS (SELECT DISTINCT company_id, 0::BIGINT AS n, 'pending' AS status, 0 AS attempts, NULL::BIGINT AS last_crawl_id, NULL::TIMESTAMP AS started_at, NULL::TIMESTAMP AS completed_at, NULL::TIMESTAMP AS failed_at, NULL::TIMESTAMP AS next_retry_at, NULL::VARCHAR AS error_type FROM e "
    "UNION ALL SELECT x.company_id, x.n, CASE WHEN ok THEN w ELSE x.status END, CASE WHEN ok AND w = 'running' THEN attempts + 1 ELSE attempts END, CASE WHEN ok AND w = 'completed' THEN crawl_id ELSE last_crawl_id END, "
    "CASE WHEN ok AND w = 'running' THEN t ELSE started_at END, CASE WHEN ok AND w = 'completed' THEN t ELSE completed_at END, CASE WHEN NOT ok THEN failed_at WHEN w IN ('failed', 'retrying') THEN t END, "
    "CASE WHEN NOT ok THEN old_retry WHEN w = 'retrying' THEN new_retry END, CASE WHEN NOT ok THEN error_type WHEN w IN ('failed', 'retrying') THEN 'TimeoutError' END FROM ("
    f"SELECT e.company_id, e.n, s.status, s.attempts, s.last_crawl_id, s.started_at, s.completed_at, s.failed_at, s.next_retry_at AS old_retry, e.next_retry_at AS new_retry, s.error_type, e.t, e.crawl_id, w, ({_LEGAL}) AS ok "
    "FROM s JOIN (SELECT *, CASE kind WHEN 'started' THEN 'running' WHEN 'completed' THEN 'completed' ELSE CASE WHEN next_retry_at IS NULL THEN 'failed' ELSE 'retrying' END END AS w FROM e) e ON e.company_id = s.company_id AND e.n = s.n + 1) x) "
    "SELECT company_id, status, attempts, last_crawl_id, started_at, completed_at, failed_at, next_retry_at, error_type FROM s QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY n DESC) = 1"
)
def t4_crawl_state_stream(spark, sf_dir):
    """Crawl events as a stream into the state store, and from there into a stored table."""
    raw = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, since a single file is no folder to watch
    at = F.col("ts").cast("timestamp")
    events = raw.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("company_id"), F.expr(_KIND).alias("kind"), at.alias("at"), (F.col("event_id") * 10).alias("crawl_id"), F.lit("TimeoutError").alias("error_type"),
        F.lit("slow").alias("error_message"), F.when(F.col("event_id") % 2 == 0, at + F.expr("INTERVAL 1 HOUR")).alias("next_retry_at"),
    )
    folder = shared_path(spark, "crawl-states")
    store = crawl_states.state_store(spark, f"{folder}/states", buckets=8)
    crawl_states.run_once(spark, events, store, f"{folder}/checkpoint")
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "completed_at", "failed_at", "next_retry_at")}
    return store.read().withColumns(times).drop("seq", "error_message")


# Latest rows that stand -------------------------------------------------------------------------------------------------


def _standing(spark: SparkSession, rows: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """The standing latest rows after the parts of a history, which come in the given order."""
    store = standing.latest_store(spark, shared_path(spark, "latest"), rows, keys, buckets=8)
    for i, part in enumerate(parts):
        standing.merge_latest(store, f"batch-{i}", rows.where(part))
    return store.read()


@query(ctes("performance") + "SELECT company_id, id, performance_score, seo_score, observed_at FROM performance QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY observed_at DESC, id DESC) = 1")
def a3_standing_performance(spark, sf_dir):
    """Three batches, the latest of them first, and one of them twice."""
    rows = frame(spark, sf_dir, "performance").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    late = _standing(spark, rows, ["company_id"], ["id % 3 = 2", "id % 3 = 0", "id % 3 = 2", "id % 3 = 1"])
    return late.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))


@query(ctes("stages") + "SELECT company_id, max(completed_at) AS completed_at FROM stages GROUP BY company_id")
def a4_standing_completion(spark, sf_dir):
    rows = frame(spark, sf_dir, "stages").select("company_id", F.col("completed_at").cast("timestamp").alias("completed_at"), "id")
    store = Store(spark, shared_path(spark, "completed"), "company_id long, completed_at timestamp", ["company_id"], buckets=8)
    for run in (1, 0):
        standing.merge_largest(store, f"batch-{run}", rows.where(F.col("id") % 2 == run), "completed_at")
    return store.read().withColumn("completed_at", F.col("completed_at").cast("timestamp_ntz"))


@query(ctes("observations") + "SELECT person_id, id, role_group, decision_maker_score FROM observations WHERE decision_maker_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY observed_at DESC, id DESC) = 1")
def a5_standing_scores(spark, sf_dir):
    """Each person's latest observation that has a score."""
    rows = frame(spark, sf_dir, "observations").where("decision_maker_score is not null").select("person_id", "id", "role_group", "decision_maker_score", F.col("observed_at").cast("timestamp").alias("observed_at"))
    return _standing(spark, rows, ["person_id"], ["id % 2 = 1", "id % 2 = 0"]).drop("observed_at")


@query("SELECT user_id AS company_id, event_type AS url, arg_max(event_id, (ts, event_id)) AS crawl_id FROM events GROUP BY ALL")
def a6_standing_crawls(spark, sf_dir):
    """The latest crawl of each company and url."""
    rows = read(spark, sf_dir, "events").selectExpr("user_id AS company_id", "event_type AS url", "event_id AS id", "CAST(ts AS timestamp) AS observed_at")
    return _standing(spark, rows, ["company_id", "url"], ["id % 2 = 1", "id % 2 = 0"]).select("company_id", "url", F.col("id").alias("crawl_id"))


# Sets of ids ------------------------------------------------------------------------------------------------------------


@query(ctes("companies", "contacts") + "SELECT company_id, id, kind FROM contacts WHERE company_id IN (SELECT id FROM companies WHERE website <> '' AND country LIKE '%A%')")
def j6_load_by_bitmap(spark, sf_dir):
    """The contacts of chosen companies: the choice goes to them as a bitmap, and they stay where they lie."""
    chosen = frame(spark, sf_dir, "companies").where("website <> '' and country like '%A%'")
    return bitmaps.members(frame(spark, sf_dir, "contacts"), "company_id", bitmaps.bitmap(chosen, "id")).select("company_id", "id", "kind")


@query(ctes("companies", "people") + "SELECT id, company_id FROM people WHERE id NOT IN (SELECT id FROM companies)")
def j6_not_in_bitmap(spark, sf_dir):
    return bitmaps.members(frame(spark, sf_dir, "people"), "id", bitmaps.bitmap(frame(spark, sf_dir, "companies"), "id"), inside=False).select("id", "company_id")


@query("SELECT coalesce(event_type, 'any') AS stage, count(DISTINCT user_id) AS companies FROM events WHERE value > 60 GROUP BY ROLLUP (event_type)")
def j6_distinct_over_stages(spark, sf_dir):
    """How many companies completed each stage, and any of them: the bitmaps of the stages are united, no id is counted again."""
    done = bitmaps.bitmap(read(spark, sf_dir, "events").where("value > 60"), "user_id", ["event_type"])
    each = bitmaps.sizes(done, ["event_type"]).select(F.col("event_type").alias("stage"), F.col("ids").alias("companies"))
    return each.unionByName(bitmaps.sizes(bitmaps.united(done), []).select(F.lit("any").alias("stage"), F.col("ids").alias("companies")))


# Stored crawls ----------------------------------------------------------------------------------------------------------


@query(
    "WITH s AS (SELECT page_id % 40 AS company_id, max(page_id) AS crawl_id FROM pages GROUP BY ALL) SELECT company_id, crawl_id, url, octet_length(encode(html)) AS n, "
    "list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS links FROM s JOIN pages ON page_id = crawl_id"
)
def g8_last_crawls(spark, sf_dir):
    """The page and the links of each company's last crawl, from bucketed tables."""
    pages = read(spark, sf_dir, "pages")
    null = F.lit(None).cast("string")
    crawls = pages.select(F.col("page_id").alias("id"), "url", F.lit(200).alias("status_code"), "html", null.alias("text"), null.alias("title"), null.alias("meta_description"), F.lit(None).cast("timestamp").alias("collected_at"))
    links = pages.select(F.col("page_id").alias("website_crawl_id"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("url"))
    folder = shared_path(spark, "crawls")
    name = "crawls_" + folder.rpartition("-")[2]
    crawl_tables.write_crawls(crawls, links, name, folder)
    states = pages.groupBy((F.col("page_id") % 40).alias("company_id")).agg(F.max("page_id").alias("last_crawl_id"))
    return crawl_tables.last_crawls(spark, name, states).select("company_id", "crawl_id", "url", F.octet_length("html").cast("long").alias("n"), "links")


# Identity keys ----------------------------------------------------------------------------------------------------------

_ROLE = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'primary' WHEN '2' THEN 'secondary' WHEN '3' THEN 'professional' ELSE 'unknown' END"
_SURE = "CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END"
_PROFILE = "CASE WHEN {0} % 3 = 0 THEN 'linkedin.com/in/p' || CAST({0} % 700 AS STRING) END"


@query(
    f"WITH c AS (SELECT o_orderkey AS n, {_PROFILE.format('o_orderkey')} AS linkedin, CASE WHEN o_orderkey % 7 <> 0 THEN 'person ' || CAST(o_custkey % 900 AS STRING) END AS name, {_ROLE} AS role_group, {_SURE} AS confidence, o_orderkey % 4 = 0 AS is_decision_maker FROM orders), "
    "k AS (SELECT 'linkedin' AS field, linkedin AS value, * FROM c WHERE linkedin IS NOT NULL UNION ALL SELECT 'name', name, * FROM c WHERE name IS NOT NULL), "
    "b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY field, value ORDER BY is_decision_maker DESC, CASE role_group WHEN 'primary' THEN 0 WHEN 'secondary' THEN 1 WHEN 'professional' THEN 2 ELSE 4 END, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, n) = 1), "
    f"p AS (SELECT c_custkey AS person_id, {_PROFILE.format('c_custkey')} AS linkedin, 'person ' || CAST(c_custkey % 1100 AS STRING) AS name FROM customer) "
    "SELECT person_id, coalesce(l.role_group, n.role_group, 'unknown') AS role_group, coalesce(l.confidence, n.confidence, 'low') AS confidence, coalesce(l.is_decision_maker, n.is_decision_maker, false) AS is_decision_maker, coalesce(l.field, n.field) AS matched_by "
    "FROM p LEFT JOIN b l ON l.field = 'linkedin' AND l.value = p.linkedin LEFT JOIN b n ON n.field = 'name' AND n.value = p.name"
)
def g14_classify_by_keys(spark, sf_dir):
    """Classifications found by profile, or else by name."""
    keys = lambda name: F.expr(f"filter(array(named_struct('field', 'linkedin', 'value', linkedin), named_struct('field', 'name', 'value', {name})), k -> k.value is not null)")
    c = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS ordinal", f"{_PROFILE.format('o_orderkey')} AS linkedin", "CASE WHEN o_orderkey % 7 <> 0 THEN concat('person ', o_custkey % 900) END AS name", f"{_ROLE} AS role_group", f"{_SURE} AS confidence", "o_orderkey % 4 = 0 AS is_decision_maker")
    p = read(spark, sf_dir, "customer").selectExpr("c_custkey AS person_id", f"{_PROFILE.format('c_custkey')} AS linkedin", "concat('person ', c_custkey % 1100) AS name")
    found = outreach.classify(p.select("person_id", keys("name").alias("keys")), c.select("ordinal", keys("name").alias("keys"), "role_group", "confidence", "is_decision_maker"))
    return found.drop("keys")


# Requests ---------------------------------------------------------------------------------------------------------------


@query(
    "WITH r AS (SELECT event_id, event_type AS client, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS slot FROM events), "
    "d AS (SELECT *, CASE WHEN client = 'click' THEN 100 ELSE 900 END AS cap, CASE WHEN client = 'click' THEN 2 ELSE 1 END AS spacing FROM r) "
    "SELECT event_id, client, slot, CASE WHEN slot // cap > 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(slot // cap AS INTEGER)) + to_seconds((slot % cap) * spacing) "
    "ELSE TIMESTAMP '2024-01-01 12:00:00' + to_seconds(slot * spacing + CASE WHEN client = 'view' AND slot >= 50 THEN 600 ELSE 0 END) END AS slot_at FROM d"
)
def s17_request_slots(spark, sf_dir):
    """Requests of several clients dealt to slots: rates, daily caps, and a cooldown of one of them."""
    noon = datetime(2024, 1, 1, 12)
    cooldown = (noon + timedelta(seconds=50), noon + timedelta(seconds=650))
    requests = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("client"))
    limits = {r[0]: schedule.Limits(30, 100) if r[0] == "click" else schedule.Limits(60, 900, [cooldown] if r[0] == "view" else []) for r in requests.select("client").distinct().collect()}
    calendars = {c: schedule.Calendar(x, noon) for c, x in limits.items()}
    return schedule.deal(requests, calendars, order="event_id").withColumn("slot_at", F.col("slot_at").cast("timestamp_ntz"))


# Landed files -----------------------------------------------------------------------------------------------------------


@query("SELECT 'Shop \"' || c_custkey || '\"' || chr(10) || c_mktsegment AS title, CASE WHEN c_custkey % 3 = 0 THEN 'https://s' || c_custkey || '.com' END AS website, c_name || ', ' || c_nationkey AS address, CAST(NULL AS VARCHAR) AS cid, CAST(c_custkey AS VARCHAR) AS place_id FROM customer")
def s1_landed_listings(spark, sf_dir):
    """Listings from CSV files with quotes and line ends inside values, a column that isn't wanted, and one that is missing."""
    folder = shared_path(spark, "landed")
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey AS place_id", "concat('Shop \"', c_custkey, '\"\n', c_mktsegment) AS title", "'x' AS other", "CASE WHEN c_custkey % 3 = 0 THEN concat('https://s', c_custkey, '.com') END AS website", "concat(c_name, ', ', c_nationkey) AS address")
    rows.repartition(4, "place_id").write.option("header", True).option("escape", '"').csv(folder)
    return landed.read_landed(spark, folder).select("title", "website", "address", "cid", "place_id")


# Providers --------------------------------------------------------------------------------------------------------------


@query(
    "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 5 = 1 THEN NULL ELSE CAST(s_suppkey % 101 AS INTEGER) END AS performance, CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 1 AND s_suppkey % 2 = 0 THEN 50 END AS seo, "
    "CASE WHEN s_suppkey % 7 = 0 THEN 'FileNotFoundError' END AS error_type FROM supplier"
)
def s11_called_reports(spark, sf_dir):
    """Lab reports asked of a provider whose answers are files: some lack, some aren't JSON, some have no second score. Failures are rows."""
    folder = shared_path(spark, "reports")
    s = read(spark, sf_dir, "supplier").select("s_suppkey")
    report = "CASE WHEN s_suppkey % 5 = 1 THEN 'not json' ELSE concat('{\"categories\": {\"performance\": {\"score\": ', CAST(s_suppkey % 101 / 100.0D AS STRING), '}', if(s_suppkey % 2 = 0, ', \"seo\": {\"score\": 0.5}', ''), '}}') END"
    s.where("s_suppkey % 7 <> 0").selectExpr("concat(s_suppkey, '.json') AS name", f"{report} AS report").repartition(8, "name").write.partitionBy("name").text(folder)
    asked = s.select(F.concat(F.lit("name="), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("key"))
    got = providers.call(providers.FileAnswers(folder), asked, tasks=4, attempts=2)
    score = lambda c: readers.category_score(F.col("report"), c).alias(c)
    return got.select(F.regexp_extract("key", r"\d+", 0).cast("long").alias("s_suppkey"), score("performance"), score("seo"), "error_type")


@query(
    "WITH d AS (SELECT source, doc_id, 'PAGE URL: doc/' || doc_id || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) AS chunk FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''), "
    "b AS (SELECT *, coalesce(sum(length(chunk)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d), "
    "c AS (SELECT source, trim(string_agg(substr(chunk, 1, CAST(12000 - before AS BIGINT)), chr(10) || chr(10) ORDER BY doc_id), ' ' || chr(9) || chr(10) || chr(13)) AS context FROM b WHERE before < 12000 GROUP BY source), "
    "k AS (SELECT 'src' || CAST(c_custkey % 7 AS VARCHAR) AS source, string_agg('- ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN ' | ' || c_mktsegment ELSE '' END, chr(10) ORDER BY c_custkey) AS lines FROM customer GROUP BY 1) "
    "SELECT source, md5('Candidates found by rules:' || chr(10) || coalesce(lines, '- none') || chr(10) || chr(10) || 'Pages:' || chr(10) || context || chr(10) || chr(10) || "
    "'Return only people of this company as JSON: people, a list of name, title, linkedin_url, source_url, decision_maker, role_group (primary, secondary, professional, other, unknown), decision_maker_confidence (high, medium, low), decision_maker_reason and evidence.') AS prompt FROM c LEFT JOIN k USING (source)"
)
def s16_prompts(spark, sf_dir):
    """Requests to a language model: the candidates and the pages of each source."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), "text")
    contexts = extraction.model_context(d, "source", "doc_id").withColumnRenamed("source", "company_id")
    candidates = read(spark, sf_dir, "customer").selectExpr("concat('src', c_custkey % 7) AS company_id", "c_custkey AS ordinal", "c_name AS name", "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS title")
    return answers.prompts(contexts, candidates).select(F.col("company_id").alias("source"), F.md5("prompt").alias("prompt"))


@query(
    "SELECT DISTINCT 'Shop ' || s_suppkey % 60 AS name, 'https://shop' || s_suppkey % 60 || '.nl' AS website, 'shop' || s_suppkey % 60 || '.nl' AS domain, '+' || s_suppkey % 60 AS phone, 'Netherlands' AS country, 'Delft' AS city, 1 AS rows FROM supplier WHERE s_suppkey % 60 <> 7"
)
def s3_imported_results(spark, sf_dir):
    """Results that an earlier search left as files, as stored companies: repeated ids count once, rows without a title don't count."""
    folder = shared_path(spark, "results")
    shop = "CAST(s_suppkey % 60 AS STRING)"
    rows = read(spark, sf_dir, "supplier").selectExpr(f"if(s_suppkey % 60 = 7, ' ', concat('Shop  ', {shop})) AS title", f"concat('HTTPS://www.shop', {shop}, '.nl/') AS website", f"concat('+', {shop}) AS phone", f"{shop} AS place_id")
    rows.repartition(4, "place_id").write.option("header", True).csv(folder)
    companies, index = jobs.company_stores(spark, shared_path(spark, "companies"), buckets=8)
    jobs.import_run(companies, index, "import", folder, 0, "Delft", "nederland")
    return companies.read().select("name", "website", "domain", "phone", "country", "city", F.col("rows").cast("int").alias("rows"))


_LISTED = "SELECT o_orderkey AS ordinal, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE ' ' || o_orderpriority END AS title, CASE o_orderkey % 3 WHEN 0 THEN 'p' || o_custkey % 300 END AS place_id, CASE WHEN o_orderkey % 4 = 0 THEN 'c' || o_custkey % 100 END AS cid FROM orders"


@query(
    f"WITH l AS ({_LISTED}), e AS (SELECT ordinal, trim(title) AS name, coalesce(place_id, cid) AS external_id FROM l QUALIFY coalesce(place_id, cid) IS NULL OR row_number() OVER (PARTITION BY coalesce(place_id, cid) ORDER BY ordinal) = 1), "
    "k AS (SELECT * FROM e ORDER BY ordinal LIMIT 400) SELECT name, external_id, 'Delft' AS city, count(*) AS n FROM k WHERE name <> '' GROUP BY ALL"
)
def w9_limit_after_dedupe(spark, sf_dir):
    """The first 400 listings after repeated ids are gone, those without a title among them; these then don't become records."""
    null = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS ordinal", "CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE ' ' || o_orderpriority END AS title", "CASE o_orderkey % 3 WHEN 0 THEN 'p' || o_custkey % 300 END AS place_id", "CASE WHEN o_orderkey % 4 = 0 THEN 'c' || o_custkey % 100 END AS cid")
    rows = rows.select("*", *[null.alias(c) for c in ("website", "address", "complete_address", "phone", "category", "data_id")])
    return readers.load_results(rows, "Delft", None, 400).groupBy("name", "external_id", "city").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, trim(o_orderpriority) AS name FROM orders WHERE o_orderpriority <> ''")
def f10_required_text(spark, sf_dir):
    """A text that must be there: trimmed, and an error where it lacks (tests)."""
    return read(spark, sf_dir, "orders").select("o_orderkey", text.required_text(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("\t")), "priority").alias("name"))
