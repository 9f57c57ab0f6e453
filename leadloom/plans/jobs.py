"""The flows as set-oriented jobs: acquisition, enrichment, export, selection of recipients. Each stage works on all companies at once; tables are the boundary between them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import emails, person
from ..operators import companies as C
from ..operators import extraction, identity, leads, ledger, observations, outreach, state
from ..sources import landed, readers
from ..sources.providers import fallback_classification
from ..sources.schemas import durable_id
from ..sources.store import Store, least, materialized


#: Ids of stored companies, less this, come before every ordinal of a listing.
STORED = 1 << 62


def acquire(listings: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    """Records folded into companies: stored ones first (by id), then listings in order of their `ordinal`. Returns companies and counters."""
    new = C.normalize_records(listings)
    known = stored.withColumn("ordinal", F.col("id") - STORED)
    columns = ["ordinal", "name", "normalized_name", *C.FILLED]
    folded = C.fold_companies(new.select(*columns), stored=known.select(*columns))
    found = folded.withColumn("outcome", F.when(F.col("company_ordinal") >= 0, "new").otherwise("stored"))
    counters = found.agg(F.sum(F.when(F.col("outcome") == "new", F.col("rows")).otherwise(F.col("rows") - 1)).alias("found"), F.count_if(F.col("outcome") == "new").alias("new"))
    return {"companies": found, "counters": counters.withColumn("duplicates", F.col("found") - F.col("new"))}


COMPANIES = f"id long, name string, normalized_name string, {', '.join(f'{c} string' for c in C.FILLED)}, rows long"
COMPANY_KEYS = f"{', '.join(f'{k} string' for k in C.KEY)}, id long"


def company_stores(spark: SparkSession, path: str, buckets: int = 64) -> tuple[Store, Store]:
    """(companies by id, index): the index has each key under which a company is found, and the lowest company that it finds."""
    return Store(spark, f"{path}/companies", COMPANIES, ["id"], buckets), Store(spark, f"{path}/keys", COMPANY_KEYS, list(C.KEY), buckets)


def acquire_run(companies: Store, index: Store, run: str, listings: DataFrame) -> DataFrame:
    """One run of acquisition into stored companies: listings (with ordinals above those of all runs before) are folded as if all runs were one, and a company's id is the ordinal
    of the listing that began it. Returns the run's counters.

    Only what the listings can meet is read: their keys are looked up in the index, and the companies that it names are the only stored ones that the fold sees. That is enough: a
    candidate takes the lowest company of a key, and among those stored before the run that is the one in the index. Companies that changed are put in place of their
    buckets, and their keys into the index's. Repeating a run that was lost half-way leaves the tables as if it had run once."""
    columns = ["name", "normalized_name", *C.FILLED]

    def changes():
        # each of these is read several times, and is made once
        new = materialized(C.normalize_records(listings).select("ordinal", *columns), "new")
        asked = new.select(F.explode(C.lookup_keys()).alias("k")).select(*[F.col(f"k.{k}") for k in C.KEY]).distinct()
        named = materialized(index.among(materialized(asked, "asked")).select("id").distinct(), "named")
        known = materialized(companies.among(named), "known")
        folded = C.fold_companies(new, stored=known.withColumn("ordinal", F.col("id") - STORED).select("ordinal", *columns))
        old = F.col("company_ordinal") < 0
        found = folded.withColumns({"id": F.when(old, F.col("company_ordinal") + STORED).otherwise(F.col("company_ordinal")), "found": F.col("rows") - old.cast("int")}).where("found > 0")
        return found.select("id", *columns, F.col("found").alias("rows"), (~old).alias("is_new"))

    deltas = companies.planned(run, changes)

    def merge(current, changed):
        c, d = current.alias("c"), changed.alias("d")
        picked = [F.coalesce(f"d.{x}", f"c.{x}").alias(x) for x in columns]
        return c.join(d, "id", "full").select("id", *picked, (F.coalesce("c.rows", F.lit(0)) + F.coalesce("d.rows", F.lit(0))).alias("rows"))

    companies.update(run, deltas.drop("is_new"), merge)
    index.update(run, deltas.select("id", F.explode(C.held_keys()).alias("k")).select(*[F.col(f"k.{k}") for k in C.KEY], "id"), least(list(C.KEY), "id"))
    return deltas.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("found"), F.count_if("is_new").alias("new")).withColumn("duplicates", F.col("found") - F.col("new"))


def import_run(companies: Store, index: Store, run: str, path: str, base: int, city: str | None = None, country: str | None = None) -> DataFrame:
    """A run over results that another search left as CSV files at path: listings once for each id, those with a title, in order of file and row, with ordinals from `base` on, which must
    be above those of all runs before. Returns the run's counters."""
    rows = landed.read_landed(companies.spark, path, final=True).withColumn("ordinal", F.lit(base).cast("long") + F.monotonically_increasing_id())
    return acquire_run(companies, index, run, readers.business_records(C.deduplicate_listings(rows), city, country, keep=("ordinal",)))


PROVENANCE = "id long, company_id long, source_id int, external_id string, collected_at timestamp, lone long"


def provenance_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    """Source records by (source, external id); `lone` is the id of a record without an external one, which is a key of its own."""
    return Store(spark, path, PROVENANCE, ["source_id", "external_id", "lone"], buckets)


def record_provenance(store: Store, run: str, records: DataFrame) -> None:
    """Records of a run: the latest one of each (source, external id) stays; those without an external id are all added."""
    own = records.withColumn("lone", F.when(F.col("external_id").isNull(), F.col("id")))
    store.update(run, own, lambda current, deltas: C.provenance(current.unionByName(deltas.select(*current.columns))))


STATES = "company_id long, stage string, status string, attempts int, error_type string, error_message string, completed_at timestamp, updated_at timestamp"


def state_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    """Stage states by company and stage."""
    return Store(spark, path, STATES, ["company_id", "stage"], buckets)


def store_outcomes(states: Store, run: str, outcomes: DataFrame, now: datetime) -> None:
    """Outcomes (company_id, stage, ok, error_type, error_message) of a run into the stored states."""
    states.update(run, outcomes, lambda current, deltas: state.advance(current, deltas, now))


def store_emails(people: Store, run: str, seen: DataFrame) -> None:
    """Qualified addresses (person_id, email, attempt, is_qualified) into stored people; addresses of people who aren't stored are left out."""
    known = people.among(seen.where("is_qualified").select(F.col("person_id").alias("id")))
    mine = seen.where("is_qualified").join(known.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    people.update(run, mine.withColumn("id", F.col("person_id")), lambda current, deltas: outreach.update_emails(current, deltas))


def found_people(pages: DataFrame) -> DataFrame:
    """The people of each company, resolved, from its pages (company_id, page, url, text, html): candidates in order of page, url and place on it."""
    found = F.col("found_people") if "found_people" in pages.columns else extraction.page_people(F.col("text"), F.col("html"))
    placed = pages.select("company_id", "page", F.col("url").alias("source_url"), F.posexplode(found).alias("place", "p")).select("company_id", "page", "source_url", "place", "p.*")
    order = F.row_number().over(Window.partitionBy("company_id").orderBy("page", "source_url", "place")).cast("long")
    named = placed.withColumns({"ordinal": order, "name": person.normalize_person_name(F.col("name")), "title": person.normalize_person_title(F.col("title"))})
    people = identity.resolve_people(named.select("company_id", "ordinal", "name", "title", "linkedin_url", "source_url"))
    return people.withColumn("person_id", durable_id("company_id", "name", "linkedin_url"))


def enrich(companies: DataFrame, crawls: DataFrame, states: DataFrame, now: datetime, max_age: timedelta = timedelta(days=30), region: str | None = None) -> dict[str, DataFrame]:
    """Contacts and people of the companies whose stages aren't completed, from crawls (company_id, page, url, text, html, collected_at).

    Returns contacts, people, ranked people, companies to crawl again, companies without a website, and new states. A company without a crawl fails its stage and harms no other."""
    missing = companies.where("coalesce(website, '') = ''").select(F.col("id").alias("company_id"))
    todo = state.pending(companies.where("coalesce(website, '') <> ''").select(F.col("id").alias("company_id")), states, "people_analysis")
    fresh = crawls.where(F.col("collected_at") > F.lit(now) - F.expr(f"INTERVAL {int(max_age.total_seconds())} SECONDS"))
    pages = fresh.join(todo, "company_id", "left_semi")
    stale = todo.join(fresh.select("company_id"), "company_id", "left_anti")
    pages = extraction.parsed(pages)
    found = extraction.contacts(pages)
    contacts = extraction.normalize_contacts(found, region)
    people = found_people(pages)
    ranked = outreach.rank_people(fallback_classification(people))
    done = pages.select("company_id").distinct().select("company_id", F.lit("people_analysis").alias("stage"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("error_message"))
    lost = stale.select("company_id", F.lit("people_analysis").alias("stage"), F.lit(False).alias("ok"), F.lit("CrawlingProviderError").alias("error_type"), F.lit("no crawl").alias("error_message"))
    return {"contacts": contacts, "people": people, "ranked": ranked, "crawl_again": stale, "without_website": missing, "states": state.advance(states, done.unionByName(lost), now)}


def run_stage(stage: str, companies: DataFrame, states: DataFrame, operation, now: datetime) -> dict[str, DataFrame]:
    """A stage over the companies (company_id) that haven't completed it: operation(companies) returns (rows, lost), where lost (company_id, error_type, error_message) are
    companies whose part failed. Their failure harms no other, and doesn't undo what they had. Returns rows, outcomes and the new states."""
    todo = state.pending(companies, states, stage)
    rows, lost = operation(todo)
    failed = lost.select("company_id", F.lit(False).alias("ok"), "error_type", "error_message")
    done = todo.select("company_id").distinct().join(lost.select("company_id"), "company_id", "left_anti").select("company_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("error_message"))
    outcomes = done.unionByName(failed).withColumn("stage", F.lit(stage))
    return {"rows": rows.join(lost.select("company_id"), "company_id", "left_anti"), "states": state.advance(states, outcomes, now), "outcomes": outcomes}


def _without(todo: DataFrame, evidence: DataFrame, error: str, message: str) -> DataFrame:
    return todo.join(evidence.select("company_id"), "company_id", "left_anti").select("company_id", F.lit(error).alias("error_type"), F.lit(message).alias("error_message"))


def technology_stage(companies: DataFrame, reports: DataFrame, states: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """Technology observations from detector reports (company_id, report)."""
    def operation(todo):
        own = reports.join(todo, "company_id", "left_semi")
        found = own.select("company_id", F.explode(readers.technologies(F.col("report"))).alias("t")).select("company_id", "t.name", "t.version", "t.confidence", "t.categories", "t.groups")
        return observations.technologies(found, "detector", now), _without(todo, own, "TechnologyDetectionProviderError", "no report")

    return run_stage("technology_detection", companies, states, operation, now)


def performance_stage(companies: DataFrame, reports: DataFrame, states: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """One performance row for each company with a report that has a performance score; a missing SEO score is null."""
    def operation(todo):
        own = reports.join(todo, "company_id", "left_semi")
        scored = own.select("company_id", readers.category_score(F.col("report"), "performance").alias("performance_score"), readers.category_score(F.col("report"), "seo").alias("seo_score")).where("performance_score is not null")
        rows = observations.performance(scored.drop("seo_score"), scored.select("company_id", "seo_score"), "lab", now)
        return rows, _without(todo, scored, "PerformanceProviderError", "no score")

    return run_stage("performance_seo", companies, states, operation, now)


def business_pages_stage(companies: DataFrame, crawls: DataFrame, states: DataFrame, now: datetime, k: int = 5) -> dict[str, DataFrame]:
    """The pages to crawl next of each company, from the links of its crawled pages (company_id, url, links); the homepage is one already."""
    def operation(todo):
        own = crawls.join(todo, "company_id", "left_semi")
        return extraction.business_pages(extraction.page_candidates(own), k), _without(todo, own, "CrawlingProviderError", "no crawl")

    return run_stage("business_pages", companies, states, operation, now)


def contacts_stage(companies: DataFrame, pages: DataFrame, states: DataFrame, now: datetime, region: str | None = None) -> dict[str, DataFrame]:
    """Contact observations from crawled pages, and counters of what was found and discarded."""
    counters = {}

    def operation(todo):
        own = pages.join(todo, "company_id", "left_semi")
        found = extraction.contacts(own)
        counters["counters"] = extraction.discarded_contacts(found, region)
        return observations.contacts(extraction.normalize_contacts(found, region), now, region), _without(todo, own, "CrawlingProviderError", "no crawl")

    return run_stage("contacts", companies, states, operation, now) | counters


def people_stage(companies: DataFrame, pages: DataFrame, states: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """Ranked people from crawled pages (company_id, page, url, text, html), with the roles that are known without a language model."""
    def operation(todo):
        own = pages.join(todo, "company_id", "left_semi")
        return outreach.rank_people(fallback_classification(found_people(own))), _without(todo, own, "CrawlingProviderError", "no crawl")

    return run_stage("people_analysis", companies, states, operation, now)


def email_stage(people: DataFrame, person_observations: DataFrame, companies: DataFrame, verdicts: DataFrame, known: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """The e-mail stage: targets, addresses to try, what trying them in turn saw (verdicts by email), observations, people with the address found, counters."""
    domains = companies.select(F.col("id").alias("company_id"), "domain")
    targets = outreach.email_targets(people, person_observations).join(domains, "company_id")
    mine = known.where("verification_result = 'deliverable'").select("person_id", F.col("normalized_email").alias("__known"))
    normal = emails.normalize_email(F.col("email"))
    marked = targets.withColumn("normalized_email", normal).join(mine.withColumn("already_verified", F.lit(True)), (targets["person_id"] == mine["person_id"]) & (F.col("normalized_email") == F.col("__known")), "left").drop(mine["person_id"]).drop("__known")
    marked = marked.dropDuplicates(["person_id"]).withColumn("already_verified", F.coalesce("already_verified", F.lit(False)))
    tried = outreach.verification_candidates(marked.where("not already_verified"), F.col("domain")).join(verdicts, "email", "left")
    seen = outreach.until_qualified(outreach.qualify(tried.where("status is not null")))
    lost = tried.where("status is null").select("person_id", "attempt", F.lit(False).alias("ok"), F.lit(False).alias("is_qualified"))
    attempts = seen.select("person_id", "attempt", F.lit(True).alias("ok"), "is_qualified").unionByName(lost)
    generated = F.size(emails.email_patterns(F.col("name"), F.col("domain"))).cast("long").alias("generated")
    counters = ledger.email_counters(marked.select("person_id", "email", "normalized_email", "already_verified", generated), attempts)
    return {"observations": observations.person_emails(seen, "verifier", now), "people": outreach.update_emails(people, seen), "counters": counters}


def export(tables: dict[str, DataFrame], filters: leads.ExportFilters) -> DataFrame:
    """The wide export of the companies that pass the filters."""
    t = tables
    chosen = leads.filter_companies(t["companies"], filters, t["performance"], t["stages"], t["people"], t["contacts"], t["observations"])
    return leads.wide_rows(chosen, t["performance"], t["technologies"], t["contacts"], t["people"], t["observations"])


def dry_run(observations: DataFrame, messages: DataFrame, results: list[str], minimum: float, limit: int | None = None) -> DataFrame:
    """Whom a mailing would reach. Nothing here sends mail."""
    return outreach.recipients(observations, messages, results, minimum, limit)


def run_all(spark: SparkSession, folder: str, run: str, listings: DataFrame, given: dict[str, DataFrame], now: datetime, region: str | None = None) -> dict[str, DataFrame]:
    """From listings to the wide export in one run, over the stored companies and stage states below `folder`.

    `given` has what providers gave, by domain: technologies (domain, report), performance (domain, report), crawls (domain, page, url, text, html, links), and verdicts by email
    (email, valid, status, score, smtp_verdict, catch_all). Stages come in their order, each over the companies with a website that haven't completed it; its rows are stored, and then its
    outcomes, so a run that is repeated takes up where it was lost. A company whose part is missing fails that stage only. Returns the counters, what each stage found, the
    companies without a website, people with the addresses found, and the export of all that this and earlier runs found."""
    stored, index = company_stores(spark, f"{folder}/companies")
    states = state_store(spark, f"{folder}/states")
    out = {"counters": acquire_run(stored, index, run, listings)}
    companies = stored.read()
    has = F.coalesce(F.col("website") != "", F.lit(False))
    out["without_website"] = companies.where(~has).select(F.col("id").alias("company_id"))
    todo = companies.where(has).select(F.col("id").alias("company_id"))
    named = companies.where(has & F.col("domain").isNotNull()).groupBy("domain").agg(F.min("id").alias("company_id"))
    own = {n: given[n].join(named, "domain").drop("domain") for n in ("technologies", "performance", "crawls")}
    stages = {
        "technology_detection": lambda s: technology_stage(todo, own["technologies"], s, now), "performance_seo": lambda s: performance_stage(todo, own["performance"], s, now),
        "business_pages": lambda s: business_pages_stage(todo, own["crawls"], s, now), "contacts": lambda s: contacts_stage(todo, own["crawls"], s, now, region),
        "people_analysis": lambda s: people_stage(todo, own["crawls"], s, now),
    }
    for name, stage in stages.items():
        done = stage(states.read())
        out[name] = states.planned(f"{run}-{name}-rows", lambda: done["rows"])  # noqa: B023
        outcomes = states.planned(f"{run}-{name}", lambda: done["outcomes"])  # noqa: B023
        store_outcomes(states, f"{run}-{name}", outcomes, now)
    people = out["people_analysis"].select(F.col("person_id").alias("id"), "company_id", "name", "title", "linkedin_url", F.lit(None).cast("string").alias("email"))
    unseen = spark.createDataFrame([], "id long, person_id long, title string, linkedin_url string, observed_at timestamp")
    unknown = spark.createDataFrame([], "person_id long, normalized_email string, verification_result string")
    mail = email_stage(people, unseen, companies, given["verdicts"], unknown, now)
    out["people"] = states.planned(f"{run}-people-rows", lambda: mail["people"])
    out |= {"email_counters": mail["counters"], "person_email": states.planned(f"{run}-person_email-rows", lambda: mail["observations"]), "states": states.read()}
    every = lambda name, *keys: states.all_planned(f"-{name}-rows").withColumn("id", durable_id(*keys))
    scored = every("people_analysis", "person_id").select("id", "person_id", F.col("score").alias("decision_maker_score"), "role_group", "confidence", F.lit(now).alias("observed_at"))
    tables = {
        "performance": every("performance_seo", "company_id"), "technologies": every("technology_detection", "company_id", "name"), "contacts": every("contacts", "company_id", "kind", "value"),
        "people": states.all_planned("-people-rows"), "observations": scored,
    }
    out["export"] = leads.wide_rows(companies, tables["performance"], tables["technologies"], tables["contacts"], tables["people"], tables["observations"])
    return out
