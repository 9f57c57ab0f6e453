"""Exports of companies: filters, joins of the latest evidence, wide rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import joined_text, latest_by_time, latest_per, ordered_distinct

CONTACT_KINDS = ("email", "phone", "linkedin_company", "linkedin_profile", "facebook", "instagram", "x", "youtube", "tiktok")


WIDE_FIELDS = (
    "website", "domain", "country", "city", "address", "category", "people", "decision_makers", "technologies", "performance_score", "seo_score", "email",
    "phone", "linkedin_company_urls", "linkedin_profile_urls", "facebook_urls", "instagram_urls", "x_urls", "youtube_urls", "tiktok_urls",
)


@dataclass(frozen=True)
class ExportFilters:
    """All fields are optional; those given must all hold. Times are half-open, scores inclusive."""

    country: str | None = None
    city: str | None = None
    category: str | None = None
    created_after: datetime | None = None
    created_before: datetime | None = None
    updated_after: datetime | None = None
    updated_before: datetime | None = None
    completed_after: datetime | None = None
    completed_before: datetime | None = None
    has_website: bool | None = None
    has_people: bool | None = None
    has_performance: bool | None = None
    has_email: bool | None = None
    has_phone: bool | None = None
    has_linkedin: bool | None = None
    has_decision_maker: bool | None = None
    min_performance: int | None = None
    max_performance: int | None = None
    min_seo: int | None = None
    max_seo: int | None = None

    def __post_init__(self):
        for low, high in ((self.min_performance, self.max_performance), (self.min_seo, self.max_seo)):
            if any(x is not None and not 0 <= x <= 100 for x in (low, high)):
                raise ValueError("scores are from 0 to 100")
            if low is not None and high is not None and low > high:
                raise ValueError("the least score is above the greatest")


def _between(c: str, after, before, inclusive: bool = False) -> list[Column]:
    out = [] if after is None else [F.col(c) >= F.lit(after)]
    return out + ([] if before is None else [F.col(c) <= F.lit(before) if inclusive else F.col(c) < F.lit(before)])


def _exists(companies: DataFrame, wanted: bool | None, evidence: DataFrame) -> DataFrame:
    if wanted is None:
        return companies
    ids = evidence.select(F.col("company_id").alias("id"))
    return companies.join(ids, "id", "left_semi" if wanted else "left_anti")


def filter_companies(companies: DataFrame, f: ExportFilters, performance: DataFrame, stages: DataFrame, people: DataFrame, contacts: DataFrame, observations: DataFrame) -> DataFrame:
    """companies that pass; predicates on its own columns reach the scan, the others are semi and anti joins or joins with latest rows."""
    own = [F.col(c).ilike(v) for c, v in (("country", f.country), ("city", f.city)) if v is not None]
    own += [F.col("category").ilike(f"%{f.category}%")] if f.category is not None else []
    own += _between("created_at", f.created_after, f.created_before) + _between("updated_at", f.updated_after, f.updated_before)
    if f.has_website is not None:
        has = F.coalesce(F.col("website") != "", F.lit(False))
        own.append(has if f.has_website else ~has)
    for condition in own:
        companies = companies.where(condition)
    if f.completed_after or f.completed_before:
        done = latest_completion(stages)
        for condition in _between("completed_at", f.completed_after, f.completed_before):
            done = done.where(condition)
        companies = companies.join(done.select(F.col("company_id").alias("id")), "id", "left_semi")
    companies = _exists(companies, f.has_people, people)
    companies = _exists(companies, f.has_performance, performance)
    value = F.coalesce(F.nullif("normalized_value", F.lit("")), F.nullif("value", F.lit("")))
    companies = _exists(companies, f.has_email, contacts.where((F.col("kind") == "email") & value.isNotNull()))
    companies = _exists(companies, f.has_phone, contacts.where((F.col("kind") == "phone") & value.isNotNull()))
    if f.has_linkedin is not None:
        linked = contacts.where(F.col("kind").isin("linkedin_company", "linkedin_profile") & value.isNotNull()).select("company_id")
        linked = linked.unionByName(people.where("linkedin_url is not null and linkedin_url <> ''").select("company_id"))
        companies = _exists(companies, f.has_linkedin, linked)
    companies = _exists(companies, f.has_decision_maker, latest_scored(observations).where(F.col("role_group").isin("primary", "secondary")))
    scores = _between("performance_score", f.min_performance, f.max_performance, True) + _between("seo_score", f.min_seo, f.max_seo, True)
    if scores:
        latest = latest_by_time(performance, "company_id")
        for condition in scores:
            latest = latest.where(condition)
        companies = companies.join(latest.select(F.col("company_id").alias("id")), "id", "left_semi")
    return companies


def latest_completion(stages: DataFrame) -> DataFrame:
    return stages.groupBy("company_id").agg(F.max("completed_at").alias("completed_at"))


def latest_scored(observations: DataFrame) -> DataFrame:
    """Each person's latest observation that has a score."""
    return latest_per(observations.where("decision_maker_score is not null"), ["person_id"], F.col("observed_at").desc_nulls_last(), F.col("id").desc())


def first_source(records: DataFrame, sources: DataFrame) -> DataFrame:
    """company_id, source: the name of each company's earliest record's source."""
    named = records.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
    return named.where("company_id is not null").groupBy("company_id").agg(F.min_by("source_name", F.struct("collected_at", "id")).alias("source"))


def technology_text(technologies: DataFrame) -> DataFrame:
    name = F.concat_ws(" ", "name", F.nullif("version", F.lit("")))
    once = ordered_distinct(technologies, ["company_id"], name, -F.unix_micros(F.col("observed_at").cast("timestamp")), -F.col("id"))
    return once.groupBy("company_id").agg(joined_text().alias("technologies"))


def contact_columns(contacts: DataFrame, kinds=CONTACT_KINDS) -> DataFrame:
    """One row for each company, one column for each kind: distinct values, newest first."""
    value = F.coalesce(F.nullif("normalized_value", F.lit("")), F.col("value"))
    once = ordered_distinct(contacts.where(F.col("kind").isin(*kinds)), ["company_id", "kind"], value, -F.unix_micros(F.col("observed_at").cast("timestamp")), -F.col("id"))
    wide = once.groupBy("company_id").pivot("kind", list(kinds)).agg(joined_text())
    return wide.select("company_id", *[F.nullif(k, F.lit("")).alias(k) for k in kinds])


def people_columns(people: DataFrame, observations: DataFrame) -> DataFrame:
    """company_id, people and decision_makers as text, in order of id."""
    last = latest_scored(observations).select("person_id", "decision_maker_score", "role_group", "confidence")
    joined = people.join(last, people["id"] == last["person_id"], "left")
    one = F.concat_ws(" | ", "name", F.nullif("title", F.lit("")), F.nullif("linkedin_url", F.lit("")))
    marks = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}="), F.col(c).cast("string"))) for c, label in (("decision_maker_score", "score"), ("role_group", "role"), ("confidence", "confidence"))]
    maker = F.when(F.col("role_group").isin("primary", "secondary"), F.concat_ws(" | ", "name", F.nullif("title", F.lit("")), *marks))
    line = F.explode(F.array(F.struct(F.lit("people").alias("kind"), one.alias("v")), F.struct(F.lit("decision_makers").alias("kind"), maker.alias("v"))))
    once = ordered_distinct(joined.select("company_id", "id", line.alias("l")).select("company_id", "id", "l.*"), ["company_id", "kind"], F.col("v"), F.col("id"))
    wide = once.groupBy("company_id").pivot("kind", ["people", "decision_makers"]).agg(joined_text())
    return wide.select("company_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("people", "decision_makers")])


def lead_rows(companies: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """The ten columns of the plain lead export, after the company's id."""
    source = first_source(records, sources)
    rows = companies.join(source, companies["id"] == source["company_id"], "left")
    return rows.select("id", F.col("name").alias("company_name"), "website", "domain", "phone", "city", "country", "address", "category", "source", "created_at")


def wide_rows(companies: DataFrame, performance: DataFrame, technologies: DataFrame, contacts: DataFrame, people: DataFrame, observations: DataFrame) -> DataFrame:
    """The 22 columns of the wide lead export: companies with their latest performance and all evidence as text."""
    last = latest_by_time(performance, "company_id").select(F.col("company_id").alias("id"), "performance_score", "seo_score")
    found = contact_columns(contacts)
    found = found.select("company_id", *[F.col(k).alias(k if k in ("email", "phone") else f"{k}_urls") for k in CONTACT_KINDS])
    rows = companies.drop("phone").join(last, "id", "left")
    for part in (technology_text(technologies), found, people_columns(people, observations)):
        rows = rows.join(part.withColumnRenamed("company_id", "id"), "id", "left")
    return rows.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"), *WIDE_FIELDS)
