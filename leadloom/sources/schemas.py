"""Schemas of the stored tables, and checks in place of foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import orphans

TABLES = {
    "companies": "id long, name string, normalized_name string, website string, domain string, phone string, country string, city string, address string, category string, created_at timestamp, updated_at timestamp",
    "sources": "id long, name string, source_type string",
    "source_records": "id long, company_id long, source_id long, provider_name string, external_id string, raw_data string, collected_at timestamp",
    "acquisition_runs": "id long, plan_name string, segment string, keyword string, country_code string, city string, status string, started_at timestamp, completed_at timestamp",
    "website_crawls": "id long, company_id long, url string, status_code int, html string, text string, title string, meta_description string, content_hash string, provider_name string, collected_at timestamp",
    "website_crawl_links": "website_crawl_id long, url string",
    "website_crawl_states": "company_id long, status string, attempt_count int, last_crawl_id long, started_at timestamp, completed_at timestamp, failed_at timestamp, next_retry_at timestamp, error_type string, error_message string",
    "stage_states": "company_id long, stage string, status string, attempts int, error_type string, error_message string, started_at timestamp, completed_at timestamp, updated_at timestamp",
    "technology_observations": "id long, company_id long, source_id long, name string, version string, confidence int, categories array<string>, groups array<string>, provider_name string, observed_at timestamp",
    "website_performance": "id long, company_id long, performance_score int, first_contentful_paint double, largest_contentful_paint double, cumulative_layout_shift double, total_blocking_time double, speed_index double, seo_score int, observed_at timestamp",
    "contacts": "id long, company_id long, kind string, value string, normalized_value string",
    "contact_observations": "id long, company_id long, source_id long, kind string, value string, normalized_value string, source_url string, observed_at timestamp",
    "people": "id long, company_id long, name string, normalized_name string, title string, linkedin_url string, email string, phone string",
    "person_observations": "id long, person_id long, company_id long, source_id long, provider_name string, name string, title string, linkedin_url string, decision_maker_score int, role_group string, confidence string, reasons array<string>, observed_at timestamp",
    "person_email_observations": "id long, person_id long, company_id long, email string, normalized_email string, confidence double, verification_method string, verification_result string, pattern_inferred boolean, observed_at timestamp",
    "email_messages": "id long, person_id long, company_id long, to_email string, provider_message_id string, subject string, sent_at timestamp",
}
#: child table: {column: parent table}
REFERENCES = {
    "source_records": {"company_id": "companies", "source_id": "sources"}, "website_crawls": {"company_id": "companies"}, "website_crawl_links": {"website_crawl_id": "website_crawls"},
    "website_crawl_states": {"company_id": "companies", "last_crawl_id": "website_crawls"}, "stage_states": {"company_id": "companies"},
    "technology_observations": {"company_id": "companies"}, "website_performance": {"company_id": "companies"}, "contact_observations": {"company_id": "companies"},
    "people": {"company_id": "companies"}, "person_observations": {"person_id": "people", "company_id": "companies"},
    "person_email_observations": {"person_id": "people", "company_id": "companies"}, "email_messages": {"person_id": "people", "company_id": "companies"},
}
#: Columns that are unique together where none is null.
UNIQUE = {
    "sources": ["name"], "source_records": ["source_id", "external_id"], "website_crawl_links": ["website_crawl_id", "url"], "website_crawl_states": ["company_id"],
    "stage_states": ["company_id", "stage"], "email_messages": ["provider_message_id"],
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def durable_id(*keys: str):
    """A surrogate key that depends on the natural key alone."""
    return F.xxhash64(*keys)


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rule and the number of rows that break it, for the references and unique keys of the given tables."""
    checks = []
    for name, refs in REFERENCES.items():
        for column, parent in refs.items():
            if name in tables and parent in tables:
                checks.append((name, f"{column} in {parent}", orphans(tables[name], column, tables[parent])))
    for name, keys in UNIQUE.items():
        if name in tables:
            known = tables[name].where(" and ".join(f"{k} is not null" for k in keys))
            checks.append((name, f"unique {', '.join(keys)}", known.groupBy(*keys).count().where("count > 1")))
    counted = [d.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), F.lit(r).alias("rule"), "rows") for n, r, d in checks]
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    return out
