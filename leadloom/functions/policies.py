"""Scores and policies as column expressions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import lookup


def is_real_person_name(c: Column) -> Column:
    """Two to four words, none of a website's own, no digit and no symbol of addresses."""
    words = F.filter(F.split(F.trim(c), r"(?U)\s+"), lambda w: w != "")
    plain = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"""^[.,:;!?()\[\]{}"“”‘’]+|[.,:;!?()\[\]{}"“”‘’]+$""", "")))
    blocked = F.arrays_overlap(plain, F.array(*[F.lit(w) for w in V.WEAK_NAME_WORDS]))
    return F.coalesce(F.size(words).between(2, 4) & ~blocked & ~c.rlike(r"\p{Nd}|[@/\\=<>]"), F.lit(False))


def score_person(name: Column, role: Column, decision_maker: Column, confidence: Column, has_linkedin: Column) -> Column:
    """struct(score 0..150, role_group, reasons in order)."""
    valid, maker, linked = is_real_person_name(name), F.coalesce(decision_maker, F.lit(False)), F.coalesce(has_linkedin, F.lit(False))
    known = F.when(role.isin("primary", "secondary", "professional", "other"), role).otherwise("unknown")
    combined = maker & known.isin("primary", "secondary") & valid
    score = (
        lookup(V.ROLE_SCORES, known) + F.when(confidence == "high", 10).when(confidence == "medium", 5).otherwise(0)
        + F.when(linked, 15).otherwise(0) + F.when(valid, 10).otherwise(-50) + F.when(combined, 5).otherwise(0)
    )
    reasons = F.array(
        lookup(V.ROLE_REASONS, known), F.when(maker, "qualified_decision_maker"),
        F.when(confidence == "high", "high_role_confidence").when(confidence == "medium", "medium_role_confidence").otherwise("low_role_confidence"),
        F.when(linked, "linkedin_profile"), F.when(valid, "person_name").otherwise("weak_person_name"), F.when(combined, "name_role_combination"),
    )
    return F.struct(F.greatest(F.lit(0), F.least(F.lit(150), score)).alias("score"), known.alias("role_group"), F.filter(reasons, lambda r: r.isNotNull()).alias("reasons"))


def is_decision_maker(ai: Column, role: Column, confidence: Column) -> Column:
    return F.coalesce(ai & ((role == "primary") | ((role == "secondary") & confidence.isin("high", "medium"))), F.lit(False))


def confidence_rank(c: Column) -> Column:
    return F.coalesce(lookup({"high": 0, "medium": 1, "low": 2}, c), F.lit(3))


def role_rank(c: Column) -> Column:
    return F.coalesce(lookup({"primary": 0, "secondary": 1, "professional": 2, "other": 3}, c), F.lit(4))


def _reason(reasons: dict, verdict: Column) -> Column:
    return lookup({k: v for k, v in reasons.items() if k}, verdict, F.lit(reasons[None]))


def email_qualification(valid: Column, status: Column, score: Column, verdict: Column, disposable: Column | None = None) -> Column:
    """struct(is_qualified, status, confidence, reason); the first rule that holds decides."""
    disposable = F.lit(False) if disposable is None else F.coalesce(disposable, F.lit(False))
    known = F.when(status.isin("deliverable", "risky", "undeliverable"), status).otherwise("unknown")
    refused = ~valid | (status == "undeliverable") | (verdict == "undeliverable") | disposable
    reason = (
        F.when(~valid, V.INVALID_REASON).when(status == "undeliverable", V.UNDELIVERABLE_REASON).when(verdict == "undeliverable", V.REJECTED_REASON)
        .when(disposable, V.DISPOSABLE_REASON).when(status == "deliverable", _reason(V.DELIVERABLE_REASONS, verdict))
        .when(status == "risky", _reason(V.RISKY_REASONS, verdict)).otherwise(_reason(V.UNKNOWN_REASONS, verdict))
    )
    confidence = F.greatest(F.lit(0.0), F.least(score / 100, F.lit(1.0)))
    return F.struct((~refused & (status == "deliverable")).alias("is_qualified"), F.when(refused, status).otherwise(known).alias("status"), confidence.alias("confidence"), reason.alias("reason"))


def catch_all_override(qualified: Column, from_pattern: Column, catch_all: Column, verdict: Column) -> Column:
    """A guessed address at a domain that takes all mail isn't qualified."""
    return qualified & ~(from_pattern & (F.coalesce(catch_all, F.lit(False)) | F.coalesce(verdict == "catch_all", F.lit(False))))


def verification_method(verdict: Column) -> Column:
    return F.when(verdict == "skipped", "mx").otherwise("smtp+mx")


def send_decision(suppressed: Column, already_sent: Column, status: Column, confidence: Column, minimum: float, allowed: list[str], skip_sent: bool = True) -> Column:
    """struct(allowed, reason)."""
    reason = (
        F.when(F.coalesce(suppressed, F.lit(False)), "suppressed").when(F.lit(skip_sent) & F.coalesce(already_sent, F.lit(False)), "already_sent")
        .when(~F.coalesce(status.isin(*allowed), F.lit(False)), "verification_status_not_allowed").when(confidence.isNull(), "verification_confidence_missing")
        .when(confidence < minimum, "verification_confidence_too_low").otherwise("eligible")
    )
    return F.struct((reason == "eligible").alias("allowed"), reason.alias("reason"))


def should_recrawl(collected_at: Column, max_age: timedelta, now: datetime | Column) -> Column:
    """Never collected, or as old as max_age or older. `now` is given, so that a result can be repeated."""
    at = now if isinstance(now, Column) else F.lit(now)
    return collected_at.isNull() | (F.timestamp_diff("MICROSECOND", collected_at, at) >= int(max_age.total_seconds() * 1_000_000))


def normalized_smtp_verdict(verdict: Column, message: Column, markers: list[str]) -> Column:
    """A verdict is `blocked` where the message has one of the markers."""
    return F.when(F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(F.lower(F.coalesce(message, F.lit(""))), m)), "blocked").otherwise(verdict)


def retry_delay(attempt: Column, base: float = 2.0, factor: float = 2.0, most: float = 15.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt - 1), F.lit(most))
