"""Ledgers of runs, and what a run counted."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_KEYS = ["plan_name", "segment", "keyword", "country_code", "city"]


def _at(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now)


def start_runs(runs: DataFrame, queries: DataFrame, now: datetime | Column) -> DataFrame:
    """The ledger with a running run for each query (QUERY_KEYS) that has no completed one."""
    todo = queries.select(*QUERY_KEYS).join(runs.where("status = 'completed'").select(*QUERY_KEYS), QUERY_KEYS, "left_anti").distinct()
    started = todo.select(F.xxhash64(*QUERY_KEYS, _at(now).cast("string")).alias("id"), *QUERY_KEYS, F.lit("running").alias("status"), _at(now).alias("started_at"), F.lit(None).cast(runs.schema["completed_at"].dataType).alias("completed_at"))
    return runs.unionByName(started)


def finish_runs(runs: DataFrame, outcomes: DataFrame, now: datetime | Column) -> DataFrame:
    """The ledger after outcomes (id, ok) of running runs: completed or failed, and when. Other runs stay as they are."""
    o = outcomes.select("id", F.col("ok").alias("__ok"))
    ended = (F.col("status") == "running") & F.col("__ok").isNotNull()
    joined = runs.join(o, "id", "left")
    return joined.select(
        "id", *QUERY_KEYS, F.when(ended, F.when(F.col("__ok"), "completed").otherwise("failed")).otherwise(F.col("status")).alias("status"), "started_at",
        F.when(ended, _at(now)).otherwise(F.col("completed_at")).alias("completed_at"),
    )


def plan_counters(runs: DataFrame) -> DataFrame:
    """How the runs of each plan stand."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return runs.groupBy("plan_name").agg(F.count("*").alias("runs"), count("completed"), count("failed"), count("running"))


def batch_counters(companies: DataFrame, outcomes: DataFrame, people: DataFrame) -> DataFrame:
    """One row for a batch of companies (id, website): selected, succeeded, failed, with and without a website, people and decision makers found.
    outcomes (company_id, ok) and people (company_id, is_decision_maker) of companies that failed don't count."""
    o = outcomes.select(F.col("company_id").alias("id"), "ok")
    found = people.groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("people"), F.count_if("is_decision_maker").alias("makers"))
    rows = companies.join(o, "id", "left").join(found, "id", "left")
    ok, has = F.coalesce("ok", F.lit(False)), F.coalesce(F.col("website") != "", F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("long")
    return rows.agg(
        F.count("*").alias("selected"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if(ok & has).alias("companies_with_website"),
        F.count_if(ok & ~has).alias("companies_without_website"), total("people").alias("people_found"), total("makers").alias("decision_makers_found"),
    )


def email_counters(targets: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row for the e-mail stage. targets (person_id, email, normalized_email, already_verified, generated): generated counts guessed addresses of
    those not verified yet; attempts (person_id, attempt, ok, is_qualified): verifications tried, a qualified one being a person's last."""
    t, open_ = F.col("email"), ~F.coalesce("already_verified", F.lit(False))
    bad = t.isNotNull() & (t != "") & F.col("normalized_email").isNull()
    one = targets.agg(F.count("*").alias("attempted"), F.count_if(~open_).alias("already_verified"), F.coalesce(F.sum(F.when(open_, F.col("generated"))), F.lit(0)).cast("long").alias("generated"), F.count_if(bad).alias("unusable"))
    two = attempts.agg(F.count_if("ok").alias("verified"), F.count_if("is_qualified").alias("qualified"), F.count_if(~F.col("ok")).alias("lost"))
    return one.join(two).select("attempted", "verified", "qualified", "already_verified", "generated", (F.col("unusable") + F.col("lost")).alias("failed"), F.col("verified").alias("persisted"))
