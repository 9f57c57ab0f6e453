"""Stage states, crawl states, failures, retries, retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policies

# Fixed values -------------------------------------------------------------------------------------------------------

STAGES = ("technology_detection", "performance_seo", "website_analysis", "business_pages", "contacts", "people_analysis", "person_persistence", "person_email")
STATUSES = ("pending", "running", "completed", "failed", "skipped")
TRANSITIONS = {
    "pending": ("running",), "running": ("completed", "failed", "retrying"), "failed": ("running", "retrying"), "retrying": ("running", "failed"),
    "completed": ("running",),
}
TRANSIENT_ERRORS = [
    "TimeoutError", "AsyncioTimeoutError", "CrawlingProviderTimeout", "ConnectionError", "ConnectionResetError", "ConnectError", "ReadTimeout",
    "ConnectTimeout", "RemoteProtocolError", "GroqRateLimitedError",
]
TRANSIENT_FRAGMENTS = [
    "timed out", "timeout", "connection reset", "connection refused", "temporary failure", "temporarily unavailable", "service unavailable",
    "bad gateway", "gateway timeout", "rate limit", "too many requests", "http 429", "status 429", "http 502", "status 502", "http 503", "status 503",
    "http 504", "status 504",
]
ERROR_STAGES = {
    "homepage": ("CrawlingProviderError", "CrawlingProviderTimeout"), "technology_detection": ("TechnologyDetectionProviderError", "TechnologyProviderError"),
    "website_performance": ("PerformanceProviderError", "PageSpeedProviderError", "SeoProviderError"),
    "people_ai": ("GroqProviderError", "GroqRateLimitedError", "GroqParseError"), "persistence": ("IntegrityError",),
    "person_email": ("MrEmailCheckerError", "MrEmailCheckerTimeoutError", "MrEmailCheckerParseError"), "company_validation": ("ValueError", "ValidationError"),
}
# End of fixed values ------------------------------------------------------------------------------------------------


def pending(items: DataFrame, states: DataFrame, stage: str) -> DataFrame:
    """Items (company_id) whose stage isn't completed."""
    done = states.where((F.col("stage") == stage) & (F.col("status") == "completed")).select("company_id")
    return items.join(done, "company_id", "left_anti")


def advance(states: DataFrame, outcomes: DataFrame, now: datetime | Column) -> DataFrame:
    """A new snapshot of states after outcomes (company_id, stage, ok, error_type, error_message) of one run each: attempts grow, errors are those of the last run."""
    at = now if isinstance(now, Column) else F.lit(now)
    s, o = states.alias("s"), outcomes.alias("o")
    ran = F.col("o.ok").isNotNull()
    return s.join(o, ["company_id", "stage"], "full").select(
        "company_id", "stage", F.when(ran, F.when(F.col("o.ok"), "completed").otherwise("failed")).otherwise(F.col("s.status")).alias("status"),
        (F.coalesce("s.attempts", F.lit(0)) + ran.cast("int")).alias("attempts"),
        F.when(ran, F.when(~F.col("o.ok"), F.col("o.error_type"))).otherwise(F.col("s.error_type")).alias("error_type"),
        F.when(ran, F.when(~F.col("o.ok"), F.col("o.error_message"))).otherwise(F.col("s.error_message")).alias("error_message"),
        F.when(ran & F.col("o.ok"), at).otherwise(F.col("s.completed_at")).alias("completed_at"), F.when(ran, at).otherwise(F.col("s.updated_at")).alias("updated_at"),
    )


def is_legal(before: Column, after: Column) -> Column:
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    return F.coalesce(F.array_contains(table[before], after), F.lit(False))


def transition(before: Column, after: Column) -> Column:
    """The new status; an illegal step raises."""
    return F.when(is_legal(before, after), after).otherwise(F.raise_error(F.concat(F.lit("illegal step from "), before, F.lit(" to "), after)).cast("string"))


def retry_schedule(failures: DataFrame, most_attempts: int, base: float = 2.0, factor: float = 2.0, most: float = 15.0) -> DataFrame:
    """failures (attempt) with retry and delay_seconds."""
    return failures.withColumns({"retry": F.col("attempt") < most_attempts, "delay_seconds": policies.retry_delay(F.col("attempt"), base, factor, most)})


def failure_stage(error_type: Column) -> Column:
    """The stage that an error most likely comes from."""
    table = {name: stage for stage, names in ERROR_STAGES.items() for name in names}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[error_type], F.lit("company_enrichment"))


def retryable(error_type: Column, message: Column, names: list[str] = TRANSIENT_ERRORS, fragments: list[str] = TRANSIENT_FRAGMENTS) -> Column:
    """Whether a failure may pass: by the error's name, or by a part of its message."""
    return F.coalesce(error_type.isin(*names), F.lit(False)) | F.exists(F.array(*[F.lit(f) for f in fragments]), lambda f: F.contains(F.lower(F.coalesce(message, F.lit(""))), f))


def retention_split(pages: DataFrame, crawls: DataFrame, max_age: timedelta, now: datetime | Column) -> DataFrame:
    """pages (company_id, url) with the latest crawl's id and whether to crawl again."""
    last = crawls.groupBy("company_id", "url").agg(F.max_by(F.struct("id", "collected_at"), F.struct("collected_at", "id")).alias("c"))
    return pages.join(last, ["company_id", "url"], "left").select("company_id", "url", F.col("c.id").alias("crawl_id"), policies.should_recrawl(F.col("c.collected_at"), max_age, now).alias("recrawl"))


def run_counters(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count("*").alias("found"), F.count_if(F.col("outcome") == "new").alias("new"), F.count_if(F.col("outcome") == "duplicate").alias("duplicates"), F.count_if(F.col("outcome").isin("new", "duplicate")).alias("stored"))
