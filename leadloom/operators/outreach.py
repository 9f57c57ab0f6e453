"""Addresses to verify, verification, recipients and their selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import emails, policies
from ..functions.text import bound
from .latest import latest_per


def email_targets(people: DataFrame, observations: DataFrame, latest_only: bool = False) -> DataFrame:
    """Each person with title and profile from its newest observation, or else its own."""
    last = latest_per(observations, ["person_id"], F.col("observed_at").desc_nulls_last(), F.col("id").desc()).select("person_id", F.col("title").alias("o_title"), F.col("linkedin_url").alias("o_link"))
    rows = people.join(last, people["id"] == last["person_id"], "inner" if latest_only else "left")
    pick = lambda o, p: F.coalesce(F.nullif(o, F.lit("")), F.nullif(p, F.lit("")))
    return rows.select(F.col("id").alias("person_id"), "company_id", "name", pick("o_title", "title").alias("title"), pick("o_link", "linkedin_url").alias("source_url"), "email")


def verification_candidates(targets: DataFrame, domain: Column, limit: int = 8) -> DataFrame:
    """person_id, email, attempt (from 0), from_pattern: the known address first, then guessed ones."""
    address = lambda email, guess: F.struct(email.alias("email"), F.lit(guess).alias("from_pattern"))
    # the first is the known one if there is one; what is guessed is never the known one
    guessed = lambda known: F.filter(emails.email_patterns(F.col("name"), domain, limit), lambda e: known.isNull() | (e != known))
    every = lambda known: F.concat(F.filter(F.array(address(known, False)), lambda a: a["email"].isNotNull()), F.transform(guessed(known), lambda e: address(e, True)))
    one = bound(emails.normalize_email(F.col("email")), every)
    return targets.select("person_id", "company_id", F.posexplode(one).alias("attempt", "a")).select("person_id", "company_id", "a.email", "attempt", "a.from_pattern")


def without_verified(candidates: DataFrame, observations: DataFrame) -> DataFrame:
    done = observations.where("verification_result = 'deliverable'").select("person_id", F.col("normalized_email").alias("email"))
    return candidates.join(done, ["person_id", "email"], "left_anti")


def until_qualified(verified: DataFrame) -> DataFrame:
    """The attempts of each person up to and with the first qualified one: what trying them in turn would have seen."""
    before = F.max(F.col("is_qualified").cast("int")).over(Window.partitionBy("person_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1))
    return verified.withColumn("__before", F.coalesce(before, F.lit(0))).where("__before = 0").drop("__before")


def qualify(verdicts: DataFrame) -> DataFrame:
    """verdicts (valid, status, score, smtp_verdict, from_pattern, catch_all) with is_qualified, confidence, reason and method."""
    q = policies.email_qualification(F.col("valid"), F.col("status"), F.col("score"), F.col("smtp_verdict"))
    rows = verdicts.withColumn("__q", q)
    ok = policies.catch_all_override(F.col("__q.is_qualified"), F.col("from_pattern"), F.col("catch_all"), F.col("smtp_verdict"))
    return rows.withColumns({"is_qualified": ok, "confidence": F.col("__q.confidence"), "reason": F.col("__q.reason"), "verification_method": policies.verification_method(F.col("smtp_verdict"))}).drop("__q")


def update_emails(people: DataFrame, qualified: DataFrame) -> DataFrame:
    best = qualified.where("is_qualified").groupBy("person_id").agg(F.min_by("email", "attempt").alias("found"))
    return people.join(best, people["id"] == best["person_id"], "left").withColumn("email", F.coalesce("found", "email")).select(*people.columns)


def recipients(observations: DataFrame, messages: DataFrame, results: list[str], minimum: float, limit: int | None = None, per_address: bool = True) -> DataFrame:
    """Observations that may be mailed: of an accepted result, sure enough, not mailed yet; the surest for each address; best first."""
    rows = observations.where(F.col("verification_result").isin(*results) & (F.col("confidence") >= minimum))
    rows = rows.join(messages.select(F.col("to_email").alias("normalized_email")), "normalized_email", "left_anti")
    order = [F.col("confidence").desc(), F.col("id")]
    if per_address:
        rows = latest_per(rows, ["normalized_email"], *order)
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def send_decisions(context: DataFrame, minimum: float, allowed: list[str]) -> DataFrame:
    d = policies.send_decision(F.col("suppressed"), F.col("already_sent"), F.col("status"), F.col("confidence"), minimum, allowed)
    return context.withColumn("decision", d).select(*context.columns, "decision.allowed", F.col("decision.reason").alias("send_reason"))


def rank_people(people: DataFrame, keep: int | None = None) -> DataFrame:
    """People with score, reasons and rank in their company: decision makers first, then by score, confidence and name."""
    s = policies.score_person(F.col("name"), F.col("role_group"), F.col("is_decision_maker"), F.col("confidence"), F.coalesce(F.col("linkedin_url") != "", F.lit(False)))
    rows = people.withColumn("__s", s).select(*people.columns, F.col("__s.score").alias("score"), F.col("__s.reasons").alias("reasons"))
    order = [F.col("is_decision_maker").desc(), F.col("score").desc(), policies.confidence_rank(F.col("confidence")), F.lower("name"), F.col("person_id")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("company_id").orderBy(*order)))
    if keep is not None:
        nth = F.row_number().over(Window.partitionBy("company_id", "is_decision_maker").orderBy("rank"))
        rows = rows.withColumn("__n", nth).where(~F.col("is_decision_maker") | (F.col("__n") <= keep)).drop("__n")
    return rows


def by_score(people: DataFrame, keys: list[str]) -> DataFrame:
    """Classified people with score, reasons and position among those of their keys: by score, the highest first, then by name and id. Who decides doesn't count on its own."""
    s = policies.score_person(F.col("name"), F.col("role_group"), F.col("is_decision_maker"), F.col("confidence"), F.coalesce(F.col("linkedin_url") != "", F.lit(False)))
    rows = people.withColumn("__s", s).select(*people.columns, F.col("__s.score").alias("score"), F.col("__s.reasons").alias("reasons"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.lower("name"), F.col("person_id"))))


def classification_lookup(classified: DataFrame) -> DataFrame:
    """The best classification for each identity key (field, value): decision makers, then role, then confidence, then the first."""
    rank = F.struct((~F.col("is_decision_maker")).cast("int").alias("a"), policies.role_rank(F.col("role_group")).alias("b"), policies.confidence_rank(F.col("confidence")).alias("c"), F.col("ordinal").alias("d"))
    one = classified.select(F.explode("keys").alias("k"), "role_group", "confidence", "is_decision_maker", rank.alias("rank"))
    best = F.min_by(F.struct("role_group", "confidence", "is_decision_maker"), "rank")
    return one.groupBy("k.field", "k.value").agg(best.alias("b")).select("field", "value", "b.*")


def classify(people: DataFrame, classified: DataFrame) -> DataFrame:
    """people (person_id, keys, ...) with the classification of the first of their keys that has one, and that key's field as matched_by. Keys stand in order of strength (profile, then
    name); people whose keys all have none get the role `unknown` with low confidence. Both sides go to their keys once, all kinds of key together."""
    known = classification_lookup(classified).select("field", "value", F.struct(F.col("field").alias("matched_by"), "role_group", "confidence", "is_decision_maker").alias("found"))
    asked = people.select("person_id", F.posexplode("keys").alias("priority", "key")).select("person_id", "priority", F.col("key.field").alias("field"), F.col("key.value").alias("value"))
    first = asked.join(known, ["field", "value"]).groupBy("person_id").agg(F.min_by("found", "priority").alias("found"))
    default = {"role_group": F.lit("unknown"), "confidence": F.lit("low"), "is_decision_maker": F.lit(False)}
    rows = people.join(first, "person_id", "left").select(*people.columns, "found")
    return rows.select(*people.columns, *[F.when(F.col("found").isNotNull(), F.col(f"found.{c}")).otherwise(d).alias(c) for c, d in default.items()], "found.matched_by")
