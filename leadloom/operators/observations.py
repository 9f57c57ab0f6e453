"""Rows of the observation tables, typed and checked, from what the stages found. Observations are appended and never changed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import emails
from .extraction import normalized_contact

#: Columns that may not be null.
REQUIRED = {
    "contact_observations": ["company_id", "kind", "value"], "person_observations": ["person_id", "company_id", "name"],
    "person_email_observations": ["person_id", "company_id", "email", "normalized_email"], "technology_observations": ["company_id", "name"],
    "website_performance": ["company_id"], "email_messages": ["person_id", "company_id", "to_email", "provider_message_id"],
}


def _observed(rows: DataFrame, now: datetime | Column, column: str = "observed_at") -> Column:
    at = now if isinstance(now, Column) else F.lit(now)
    return (F.coalesce(column, at) if column in rows.columns else at).alias(column)


def _known(rows: DataFrame, *names: str) -> list[Column]:
    """Columns by name, null where the rows lack them."""
    return [F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names]


def accepted(rows: DataFrame, table: str) -> DataFrame:
    """Rows that have all that the table requires."""
    return rows.where(" and ".join(f"{c} is not null" for c in REQUIRED[table]))


def refused(rows: DataFrame, table: str) -> DataFrame:
    """The others, with the first column that is missing."""
    missing = F.coalesce(*[F.when(F.col(c).isNull(), c) for c in REQUIRED[table]])
    return rows.withColumn("missing", missing).where("missing is not null")


def contacts(found: DataFrame, now: datetime | Column, region: Column | str | None = None) -> DataFrame:
    rows = found.withColumn("normalized_value", normalized_contact(F.col("kind"), F.col("value"), region)).where("normalized_value is not null")
    return accepted(rows.select("company_id", "kind", "value", "normalized_value", *_known(rows, "source_url"), _observed(rows, now)), "contact_observations")


def people(found: DataFrame, provider: str, now: datetime | Column) -> DataFrame:
    rows = found.withColumn("provider_name", F.lit(provider))
    return accepted(rows.select("person_id", "company_id", "provider_name", "name", *_known(rows, "title", "linkedin_url"), "decision_maker_score", "role_group", "confidence", _observed(rows, now)), "person_observations")


def person_emails(verified: DataFrame, provider: str, now: datetime | Column) -> DataFrame:
    """Observations of verdicts (qualified as outreach.qualify does); whether the address was guessed stays with them."""
    rows = verified.withColumns({"provider_name": F.lit(provider), "normalized_email": emails.normalize_email(F.col("email"))})
    columns = ["person_id", "company_id", "provider_name", "email", "normalized_email", "confidence", "verification_method", F.col("status").alias("verification_result"), F.col("from_pattern").alias("pattern_inferred")]
    return accepted(rows.select(*columns, _observed(rows, now)), "person_email_observations")


def technologies(found: DataFrame, provider: str, now: datetime | Column) -> DataFrame:
    rows = found.withColumn("provider_name", F.lit(provider))
    return accepted(rows.select("company_id", "provider_name", "name", "version", "confidence", *[F.col(c) if c in rows.columns else F.array().cast("array<string>").alias(c) for c in ("categories", "groups")], _observed(rows, now)), "technology_observations")


def performance(speed: DataFrame, seo: DataFrame, provider: str, now: datetime | Column) -> DataFrame:
    """One row for each company and analysis: the performance score, and the SEO score where there is one."""
    rows = speed.join(seo.select("company_id", "seo_score"), "company_id", "left").withColumn("provider_name", F.lit(provider))
    return accepted(rows.select("company_id", "provider_name", "performance_score", "seo_score", _observed(rows, now)), "website_performance")


def messages(sent: DataFrame, known: DataFrame, provider: str, now: datetime | Column) -> DataFrame:
    """Messages that the provider confirmed with an id, each once and not those already known."""
    rows = sent.withColumn("provider_name", F.lit(provider))
    rows = accepted(rows.select("person_id", "company_id", "provider_name", "provider_message_id", "to_email", *_known(rows, "from_email", "reply_to", "subject"), _observed(rows, now, "sent_at")), "email_messages")
    return rows.join(known.select("provider_message_id"), "provider_message_id", "left_anti").dropDuplicates(["provider_message_id"])
