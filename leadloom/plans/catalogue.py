"""Registered queries over the driver's tables, and their DuckDB forms where SQL expresses them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import emails, numbering, person, phones, policies, social, text, urls
from ..functions import vocabulary as V
from ..operators import companies as C
from ..operators import extraction, identity, leads, ledger, observations, outreach, plan, state
from ..operators.latest import first_non_null, latest_by_time, latest_per, limit_where
from ..sources import answers, readers, sinks
from ..streaming import landing
from . import jobs
from .base import ctes, frame, pick, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _cases(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in table.items()) + " END"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


# Exports -------------------------------------------------------------------------------------------------------------

FIRST_SOURCE = "fs AS (SELECT company_id, s.name AS source, row_number() OVER (PARTITION BY company_id ORDER BY collected_at, r.id) AS k FROM source_records r JOIN sources s ON r.source_id = s.id)"
LATEST = "lp AS (SELECT * FROM performance QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY observed_at DESC, id DESC) = 1)"
SCORED = "ls AS (SELECT * FROM observations WHERE decision_maker_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY observed_at DESC, id DESC) = 1)"


def distinct_text(value: str, table: str, order: str, where: str = "true") -> str:
    """DuckDB: values once for each company, joined in the order of their first row."""
    return f"(SELECT company_id, string_agg(v, '; ' ORDER BY {order}, v) AS t FROM (SELECT company_id, v, {order.split(' ')[0]} FROM (SELECT company_id, {value} AS v, row_number() OVER (PARTITION BY company_id ORDER BY observed_at DESC, id DESC) AS n FROM {table} WHERE {where}) WHERE v IS NOT NULL AND v <> '' QUALIFY row_number() OVER (PARTITION BY company_id, v ORDER BY n) = 1) GROUP BY company_id)"


@query(ctes("companies", "sources", "source_records") + f", {FIRST_SOURCE} SELECT c.id, c.name AS company_name, website, domain, phone, country, city, address, category, source FROM companies c LEFT JOIN fs ON c.id = fs.company_id AND k = 1")
def lead_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frame(spark, sf_dir, "companies").withColumn("created_at", F.lit(None).cast("timestamp"))
    return leads.lead_rows(c, frame(spark, sf_dir, "source_records"), frame(spark, sf_dir, "sources")).drop("created_at")


TECH = distinct_text("CASE WHEN version IS NULL OR version = '' THEN name ELSE name || ' ' || version END", "technologies", "n")
KIND_SQL = {k: distinct_text("CASE WHEN normalized_value IS NULL OR normalized_value = '' THEN value ELSE normalized_value END", "contacts", "n", f"kind = '{k}'") for k in leads.CONTACT_KINDS}
PIVOT = "cp AS (SELECT company_id, " + ", ".join(f"any_value({k}) AS {k}" for k in leads.CONTACT_KINDS) + " FROM (" + " UNION ALL ".join("SELECT company_id, " + ", ".join(f"t AS {j}" if j == k else f"NULL AS {j}" for j in leads.CONTACT_KINDS) + f" FROM {sql}" for k, sql in KIND_SQL.items()) + ") GROUP BY company_id)"
ONE_PERSON = "p.name || CASE WHEN p.title <> '' THEN ' | ' || p.title ELSE '' END"
MAKER = f"CASE WHEN role_group IN ('primary', 'secondary') THEN {ONE_PERSON} || ' | score=' || decision_maker_score || ' | role=' || role_group || CASE WHEN confidence IS NOT NULL THEN ' | confidence=' || confidence ELSE '' END END"
PEOPLE = (
    f"pj AS (SELECT p.company_id, p.id, {ONE_PERSON} || CASE WHEN p.linkedin_url IS NOT NULL THEN ' | ' || p.linkedin_url ELSE '' END AS one, {MAKER} AS maker FROM people p LEFT JOIN ls ON p.id = ls.person_id), "
    "po AS (SELECT company_id, string_agg(one, '; ' ORDER BY f) AS people FROM (SELECT company_id, one, min(id) AS f FROM pj GROUP BY ALL) GROUP BY company_id), "
    "pm AS (SELECT company_id, string_agg(maker, '; ' ORDER BY f) AS decision_makers FROM (SELECT company_id, maker, min(id) AS f FROM pj WHERE maker IS NOT NULL GROUP BY ALL) GROUP BY company_id), "
    "pp AS (SELECT company_id, people, coalesce(decision_makers, '') AS decision_makers FROM po LEFT JOIN pm USING (company_id))"
)


@query(ctes("technologies") + f"SELECT company_id, t AS technologies FROM {TECH}")
def a7_technologies(spark, sf_dir):
    return leads.technology_text(frame(spark, sf_dir, "technologies"))


@query(ctes("contacts") + f", {PIVOT} SELECT * FROM cp")
def a8_contact_columns(spark, sf_dir):
    return leads.contact_columns(frame(spark, sf_dir, "contacts"))


@query(ctes("people", "observations") + f", {SCORED}, {PEOPLE} SELECT * FROM pp")
def a9_people_columns(spark, sf_dir):
    return leads.people_columns(frame(spark, sf_dir, "people"), frame(spark, sf_dir, "observations"))


@query(
    ctes("companies", "performance", "technologies", "contacts", "people", "observations")
    + f", {LATEST}, {SCORED}, {PIVOT}, {PEOPLE}, te AS {TECH} SELECT c.id AS company_id, c.name AS company_name, website, domain, country, city, address, category, performance_score, seo_score, te.t AS technologies, {', '.join(f'cp.{k} AS {k}' if k in ('email', 'phone') else f'cp.{k} AS {k}_urls' for k in leads.CONTACT_KINDS)}, people, decision_makers "
    "FROM companies c LEFT JOIN lp ON lp.company_id = c.id LEFT JOIN te ON te.company_id = c.id LEFT JOIN cp ON cp.company_id = c.id LEFT JOIN pp ON pp.company_id = c.id"
)
def k2_wide_export(spark, sf_dir):
    return leads.wide_rows(*[frame(spark, sf_dir, t) for t in ("companies", "performance", "technologies", "contacts", "people", "observations")])


@query(ctes("performance") + f", {LATEST} SELECT company_id, id, performance_score, seo_score, observed_at FROM lp")
def a3_latest_performance(spark, sf_dir):
    return latest_by_time(frame(spark, sf_dir, "performance"), "company_id")


@query(ctes("stages") + "SELECT company_id, max(completed_at) AS completed_at FROM stages GROUP BY company_id")
def a4_latest_completion(spark, sf_dir):
    return leads.latest_completion(frame(spark, sf_dir, "stages"))


@query(ctes("observations") + f", {SCORED} SELECT * FROM ls")
def a5_latest_scored(spark, sf_dir):
    return leads.latest_scored(frame(spark, sf_dir, "observations"))


def _filtered(spark, sf_dir, filters):
    f = lambda t: frame(spark, sf_dir, t)
    return leads.filter_companies(f("companies"), filters, f("performance"), f("stages"), f("people"), f("contacts"), f("observations"))


@query(
    ctes("companies", "performance", "stages") + f", {LATEST} SELECT c.* FROM companies c WHERE category ILIKE '%a%' AND website IS NOT NULL AND website <> '' AND EXISTS (SELECT 1 FROM lp WHERE lp.company_id = c.id AND performance_score BETWEEN 5 AND 90 AND seo_score >= 10) "
    "AND EXISTS (SELECT 1 FROM (SELECT company_id, max(completed_at) AS m FROM stages GROUP BY company_id) s WHERE s.company_id = c.id AND m >= TIMESTAMP '2024-01-10 00:00:00' AND m < TIMESTAMP '2024-02-10 00:00:00')"
)
def f1_export_filters(spark, sf_dir):
    return _filtered(spark, sf_dir, leads.ExportFilters(category="a", has_website=True, min_performance=5, max_performance=90, min_seo=10, completed_after=datetime(2024, 1, 10), completed_before=datetime(2024, 2, 10)))


HAS = "(CASE WHEN normalized_value <> '' THEN normalized_value ELSE value END) <> ''"


@query(ctes("companies", "contacts", "people") + f"SELECT c.* FROM companies c WHERE country ILIKE 'nation_1%' AND (EXISTS (SELECT 1 FROM contacts k WHERE k.company_id = c.id AND kind IN ('linkedin_company', 'linkedin_profile') AND {HAS}) OR EXISTS (SELECT 1 FROM people p WHERE p.company_id = c.id AND linkedin_url <> ''))")
def j3_either_linkedin(spark, sf_dir):
    return _filtered(spark, sf_dir, leads.ExportFilters(country="nation_1%", has_linkedin=True))


@query(ctes("companies", "contacts", "people") + f"SELECT c.* FROM companies c WHERE EXISTS (SELECT 1 FROM contacts k WHERE k.company_id = c.id AND kind = 'email' AND {HAS}) AND EXISTS (SELECT 1 FROM people p WHERE p.company_id = c.id)")
def j3_has_email_and_people(spark, sf_dir):
    return _filtered(spark, sf_dir, leads.ExportFilters(has_email=True, has_people=True))


@query(ctes("companies", "observations") + f", {SCORED} SELECT c.* FROM companies c WHERE EXISTS (SELECT 1 FROM ls WHERE ls.company_id = c.id AND role_group IN ('primary', 'secondary'))")
def j4_decision_maker(spark, sf_dir):
    return _filtered(spark, sf_dir, leads.ExportFilters(has_decision_maker=True))


@query(ctes("people", "observations") + ", n AS (SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY observed_at DESC, id DESC) = 1) SELECT p.id AS person_id, p.company_id, p.name, coalesce(nullif(n.title, ''), nullif(p.title, '')) AS title, coalesce(n.linkedin_url, p.linkedin_url) AS source_url, p.email FROM people p LEFT JOIN n ON n.person_id = p.id")
def j2_email_targets(spark, sf_dir):
    return outreach.email_targets(frame(spark, sf_dir, "people"), frame(spark, sf_dir, "observations"))


# Outreach ------------------------------------------------------------------------------------------------------------

ELIGIBLE = "SELECT * FROM email_observations o WHERE verification_result IN ('deliverable', 'risky') AND confidence >= 0.5 AND NOT EXISTS (SELECT 1 FROM messages m WHERE m.to_email = o.normalized_email)"


def _recipients(spark, sf_dir, **more):
    return outreach.recipients(frame(spark, sf_dir, "email_observations"), frame(spark, sf_dir, "messages"), ["deliverable", "risky"], 0.5, **more)


@query(ctes("email_observations", "messages") + ELIGIBLE + " QUALIFY row_number() OVER (PARTITION BY normalized_email ORDER BY confidence DESC, id) = 1 ORDER BY confidence DESC, id LIMIT 50")
def w7_recipients(spark, sf_dir):
    return _recipients(spark, sf_dir, limit=50)


@query(ctes("email_observations", "messages") + ELIGIBLE)
def j5_not_mailed(spark, sf_dir):
    return _recipients(spark, sf_dir, per_address=False)


@query(ctes("observations") + "SELECT id, company_id, is_maker, decision_maker_score FROM (SELECT *, coalesce(decision_maker_score > 90, false) AS is_maker FROM observations) QUALIFY NOT is_maker OR row_number() OVER (PARTITION BY company_id, is_maker ORDER BY decision_maker_score DESC, id) <= 3")
def w4_limit_decision_makers(spark, sf_dir):
    rows = frame(spark, sf_dir, "observations").withColumn("is_maker", F.coalesce(F.col("decision_maker_score") > 90, F.lit(False)))
    return limit_where(rows, ["company_id"], "is_maker", 3, F.col("decision_maker_score").desc(), F.col("id")).select("id", "company_id", "is_maker", "decision_maker_score")


VALID = f"(len(ws) BETWEEN 2 AND 4 AND len(list_filter(ws, lambda w: lower(regexp_replace(w, '^[.,:;!?]+|[.,:;!?]+$', '', 'g')) IN {_in(V.WEAK_NAME_WORDS)})) = 0 AND NOT regexp_matches(name, '[0-9@/=<>]'))"
PERSON_IN = "pi AS (SELECT id, company_id, name, role_group, confidence, maker, linked, string_split(trim(name), ' ') AS ws FROM (SELECT p.id, p.company_id, name, role_group, o.confidence, o.id % 2 = 0 AS maker, p.linkedin_url IS NOT NULL AS linked FROM people p JOIN observations o ON o.person_id = p.id)), pv AS (SELECT *, VALID AS valid FROM pi)".replace("VALID", VALID)
SCORE = f"greatest(0, least(150, {_cases(V.ROLE_SCORES, 'role_group')} + CASE confidence WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 0 END + CASE WHEN linked THEN 15 ELSE 0 END + CASE WHEN valid THEN 10 ELSE -50 END + CASE WHEN maker AND role_group IN ('primary', 'secondary') AND valid THEN 5 ELSE 0 END))"


def _people_in(spark, sf_dir):
    p, o = frame(spark, sf_dir, "people").alias("p"), frame(spark, sf_dir, "observations").alias("o")
    return p.join(o, F.expr("o.person_id = p.id")).selectExpr("p.id AS person_id", "o.id AS observation_id", "p.company_id", "p.name", "o.role_group", "o.confidence", "o.id % 2 = 0 AS is_decision_maker", "p.linkedin_url")


@query(ctes("people", "observations") + f", {PERSON_IN} SELECT id AS person_id, name, {SCORE} AS score, role_group, array_to_string(list_filter([{_cases(V.ROLE_REASONS, 'role_group')}, CASE WHEN maker THEN 'qualified_decision_maker' END, coalesce(confidence, 'low') || '_role_confidence', CASE WHEN linked THEN 'linkedin_profile' END, CASE WHEN valid THEN 'person_name' ELSE 'weak_person_name' END, CASE WHEN maker AND role_group IN ('primary', 'secondary') AND valid THEN 'name_role_combination' END], lambda x: x IS NOT NULL), ',') AS reasons FROM pv")
def p1_score_person(spark, sf_dir):
    s = policies.score_person(F.col("name"), F.col("role_group"), F.col("is_decision_maker"), F.col("confidence"), F.col("linkedin_url").isNotNull())
    return _people_in(spark, sf_dir).withColumn("s", s).select("person_id", "name", "s.score", "s.role_group", F.array_join("s.reasons", ",").alias("reasons"))


@query(ctes("people", "observations") + ", x AS (SELECT o.id AS observation_id, role_group, confidence, o.id % 2 = 0 AS ai FROM people p JOIN observations o ON o.person_id = p.id) SELECT observation_id, coalesce(ai AND (role_group = 'primary' OR (role_group = 'secondary' AND confidence IN ('high', 'medium'))), false) AS accepted FROM x")
def p2_decision_maker(spark, sf_dir):
    return _people_in(spark, sf_dir).select("observation_id", policies.is_decision_maker(F.col("is_decision_maker"), F.col("role_group"), F.col("confidence")).alias("accepted"))


@query(ctes("people", "observations") + f", {PERSON_IN} SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY is_decision_maker DESC, score DESC, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, lower(name), person_id) AS rank FROM (SELECT id AS person_id, company_id, name, confidence, maker AS is_decision_maker, {SCORE} AS score FROM pv QUALIFY row_number() OVER (PARTITION BY id ORDER BY {SCORE} DESC, maker DESC, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END) = 1)")
def w3_rank_people(spark, sf_dir):
    s = policies.score_person(F.col("name"), F.col("role_group"), F.col("is_decision_maker"), F.col("confidence"), F.col("linkedin_url").isNotNull())["score"]
    one = latest_per(_people_in(spark, sf_dir).withColumn("s", s), ["person_id"], F.col("s").desc(), F.col("is_decision_maker").desc(), policies.confidence_rank(F.col("confidence"))).drop("s")
    return outreach.rank_people(one).select("person_id", "company_id", "name", "confidence", "is_decision_maker", "score", "rank")


@query(ctes("people", "observations") + f", {PERSON_IN} SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, lower(name), person_id) AS position FROM (SELECT id AS person_id, company_id, name, confidence, maker AS is_decision_maker, {SCORE} AS score FROM pv QUALIFY row_number() OVER (PARTITION BY id ORDER BY {SCORE} DESC, maker DESC, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END) = 1)")
def w6_score_order(spark, sf_dir):
    s = policies.score_person(F.col("name"), F.col("role_group"), F.col("is_decision_maker"), F.col("confidence"), F.col("linkedin_url").isNotNull())["score"]
    one = latest_per(_people_in(spark, sf_dir).withColumn("s", s), ["person_id"], F.col("s").desc(), F.col("is_decision_maker").desc(), policies.confidence_rank(F.col("confidence"))).drop("s")
    return outreach.by_score(one, ["company_id"]).select("person_id", "company_id", "name", "confidence", "is_decision_maker", "score", "position")


STATUS, VERDICTS = ("deliverable", "risky", "undeliverable", "unknown"), ("deliverable", "undeliverable", "catch_all", "greylisted", "blocked", "timeout", "skipped")
VERDICT_ROWS = {"id": "event_id", "person_id": "user_id", "attempt": "event_id", "valid": "event_id % 13 <> 0", "status": pick(STATUS, "event_id"), "score": "CAST(event_id * 7 % 130 AS INT)", "smtp_verdict": pick(VERDICTS, "event_id % 31"), "from_pattern": "event_id % 2 = 0", "catch_all": "event_id % 5 = 0"}


def _reason_sql(reasons):
    return "CASE smtp_verdict " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reasons.items() if k) + f" ELSE '{reasons[None]}' END"


QUALIFIED_SQL = "v AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in VERDICT_ROWS.items()) + f""" FROM events), q AS (SELECT *, valid AND status = 'deliverable' AND smtp_verdict <> 'undeliverable' AND NOT (from_pattern AND (catch_all OR smtp_verdict = 'catch_all')) AS is_qualified,
    greatest(0.0::DOUBLE, least(score / 100, 1.0::DOUBLE)) AS confidence, CASE WHEN NOT valid THEN '{V.INVALID_REASON}' WHEN status = 'undeliverable' THEN '{V.UNDELIVERABLE_REASON}' WHEN smtp_verdict = 'undeliverable' THEN '{V.REJECTED_REASON}'
    WHEN status = 'deliverable' THEN {_reason_sql(V.DELIVERABLE_REASONS)} WHEN status = 'risky' THEN {_reason_sql(V.RISKY_REASONS)} ELSE {_reason_sql(V.UNKNOWN_REASONS)} END AS reason, CASE WHEN smtp_verdict = 'skipped' THEN 'mx' ELSE 'smtp+mx' END AS verification_method FROM v)"""


def _verdicts(spark, sf_dir):
    return outreach.qualify(read(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in VERDICT_ROWS.items()]))


@query(f"WITH {QUALIFIED_SQL} SELECT * FROM q")
def p3_email_qualification(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query(f"WITH {QUALIFIED_SQL} SELECT id, person_id, is_qualified FROM (SELECT *, coalesce(max(is_qualified::INT) OVER (PARTITION BY person_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM q) WHERE b = 0")
def w10_until_qualified(spark, sf_dir):
    return outreach.until_qualified(_verdicts(spark, sf_dir)).select("id", "person_id", "is_qualified")


@query("SELECT event_id, r = 'eligible' AS allowed, r AS send_reason FROM (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'suppressed' WHEN event_id % 5 = 0 THEN 'already_sent' WHEN event_type NOT IN ('click', 'view') THEN 'verification_status_not_allowed' WHEN event_id % 7 = 0 THEN 'verification_confidence_missing' WHEN value < 10 THEN 'verification_confidence_too_low' ELSE 'eligible' END AS r FROM events)")
def p6_send_policy(spark, sf_dir):
    rows = read(spark, sf_dir, "events").selectExpr("event_id", "event_id % 17 = 0 AS suppressed", "event_id % 5 = 0 AS already_sent", "event_type AS status", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS confidence")
    return outreach.send_decisions(rows, 10.0, ["click", "view"]).select("event_id", "allowed", "send_reason")


@query("WITH k AS (SELECT o_orderkey, o_custkey % 200 AS person, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'primary' WHEN '2' THEN 'secondary' WHEN '3' THEN 'professional' ELSE 'unknown' END AS role_group, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS confidence, o_orderkey % 4 = 0 AS is_decision_maker FROM orders) SELECT 'name' AS field, 'person ' || person AS value, role_group, confidence, is_decision_maker FROM k QUALIFY row_number() OVER (PARTITION BY person ORDER BY is_decision_maker DESC, CASE role_group WHEN 'primary' THEN 0 WHEN 'secondary' THEN 1 WHEN 'professional' THEN 2 ELSE 4 END, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, o_orderkey) = 1")
def a13_classification_lookup(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS ordinal", "array(named_struct('field', 'name', 'value', concat('person ', o_custkey % 200))) AS keys", "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'primary' WHEN '2' THEN 'secondary' WHEN '3' THEN 'professional' ELSE 'unknown' END AS role_group",
        "CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS confidence", "o_orderkey % 4 = 0 AS is_decision_maker",
    )
    return outreach.classification_lookup(rows)


DOMAIN = "CASE c_custkey % 3 WHEN 0 THEN 'https://www.Shop' || CAST(c_custkey % 40 AS STRING) || '.com/about' WHEN 1 THEN 'shop-' || CAST(c_custkey AS STRING) || '.co.uk:8080' ELSE 'nodomain' END"
NAMES = ("Ann Lee", "Dr. José van Dijk", "Kim", "mr Peter O'Connor", "Anne-Marie Jansen", "Zoë Müller")


@query(
    f"WITH c AS (SELECT c_custkey, {pick(NAMES, 'c_custkey')} AS name, {DOMAIN} AS domain FROM customer), d AS (SELECT *, regexp_replace(regexp_extract(regexp_replace(lower(domain), '^[a-z]+://', ''), '^[^/?#]*'), '^www\\.|:[0-9]+$', '', 'g') AS host, "
    f"list_filter(regexp_split_to_array(regexp_replace(lower(strip_accents(name)), '[^a-z0-9 ''-]+', ' ', 'g'), '[ ''-]+'), lambda p: p <> '' AND p NOT IN {_in(V.HONORIFICS)}) AS p FROM c), "
    "e AS (SELECT *, p[1] AS f, p[len(p)] AS l FROM d WHERE contains(host, '.')), g AS (SELECT c_custkey, host, CASE WHEN len(p) = 1 THEN [f] ELSE [f || '.' || l, f, f[1] || l, f || l[1], f || l, array_to_string(p, '.'), array_to_string(p, ''), f || '_' || l, f || '-' || l] END AS x FROM e), "
    "u AS (SELECT c_custkey, host, unnest(x) AS local, generate_subscripts(x, 1) AS i FROM g), o AS (SELECT c_custkey, host, local, min(i) AS i FROM u GROUP BY ALL) "
    "SELECT c_custkey, CAST(k - 1 AS INTEGER) AS position, local || '@' || host AS email FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY i) AS k FROM o) WHERE k <= 8"
)
def x19_email_patterns(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{pick(NAMES, 'c_custkey')} AS name", f"{DOMAIN} AS domain")
    return rows.select("c_custkey", F.posexplode(emails.email_patterns(F.col("name"), F.col("domain"))).alias("position", "email"))


# Text and URLs -------------------------------------------------------------------------------------------------------


@query("SELECT page_id, 'https://' || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS normal FROM pages")
def n4_normalize_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normal"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS domain FROM pages")
def n5_normalize_domain(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.normalize_domain(F.col("url")).alias("domain"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') AS canonical FROM pages")
def n37_canonical_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


RAW = "CASE s_suppkey % 4 WHEN 0 THEN '  ' || s_name || '   LTD ' WHEN 1 THEN '' WHEN 2 THEN ' Nederland ' ELSE 'City A , Street, NL' END"


@query(f"WITH r AS (SELECT s_suppkey, {RAW} AS v FROM supplier), c AS (SELECT *, nullif(trim(regexp_replace(v, '\\s+', ' ', 'g')), '') AS t FROM r) SELECT s_suppkey, t AS cleaned, lower(coalesce(t, '')) AS company, CASE WHEN lower(t) = 'nederland' THEN 'Netherlands' ELSE t END AS country, regexp_replace(regexp_replace(lower(v), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, nullif(trim(string_split(v, ',')[1]), '') AS city, CASE WHEN contains(v, ',') THEN trim(string_split(v, ',')[-1]) END AS nation FROM c")
def n1_clean_text(spark, sf_dir):
    v = F.col("v")
    rows = read(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{RAW} AS v")
    return rows.select("s_suppkey", text.clean_text(v).alias("cleaned"), text.company_name(v).alias("company"), text.country(v).alias("country"), text.slug(v).alias("slug"), text.location(v)["city"].alias("city"), text.location(v)["country"].alias("nation"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text <> '' UNION ALL SELECT page_id + 1000000000, sha256(html) FROM pages")
def n32_content_hash(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.lit("").alias("html")).where("text <> ''")
    p = read(spark, sf_dir, "pages").select((F.col("page_id") + 1000000000).alias("doc_id"), F.lit("").alias("text"), "html")
    return d.unionByName(p).select("doc_id", text.content_hash(F.col("text"), F.col("html")).alias("content_hash"))


EMAIL_RAW = "CASE c_custkey % 6 WHEN 0 THEN 'MAILTO:Info@Example.COM?subject=x' WHEN 1 THEN ' sales+x@shop' || CAST(c_custkey % 9 AS STRING) || '.co.uk ' WHEN 2 THEN 'a@@b.com' WHEN 3 THEN 'someone@gmail.com' WHEN 4 THEN 'x%40y.com' ELSE 'a@b..com' END"


#: n and k: the normal form of each EMAIL_RAW
NORMAL_EMAILS = f"WITH r AS (SELECT c_custkey, url_decode(replace({EMAIL_RAW}, '+', '%2B')) AS v FROM customer), n AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(trim(v)), '^mailto:', ''), '[?#].*$', '')) AS e FROM r), k AS (SELECT c_custkey, CASE WHEN regexp_full_match(e, '[a-z0-9.!#$%&''*+/=?^_`{{|}}~-]+@[a-z0-9-]+(\\.[a-z0-9-]+)+') THEN e END AS email FROM n)"


@query(NORMAL_EMAILS + f" SELECT *, split_part(email, '@', 2) AS domain, CASE WHEN email IS NULL THEN NULL WHEN split_part(email, '@', 2) IN {_in(V.FREE_EMAIL_PROVIDERS)} THEN 'free_provider' WHEN split_part(split_part(email, '@', 1), '+', 1) IN {_in(V.ROLE_EMAIL_PREFIXES)} THEN 'business_role' ELSE 'business_individual' END AS quality FROM k")
def n11_normalize_email(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{EMAIL_RAW} AS v")
    v = F.col("v")
    return rows.select("c_custkey", emails.normalize_email(v).alias("email"), emails.email_domain(v).alias("domain"), emails.email_quality(v).alias("quality"))


@query("WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\\w.+-])([A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+)(?:$|[^\\w.-])', 1)) AS email FROM documents) SELECT DISTINCT doc_id, email FROM t")
def x1_extract_emails(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text like '%@%'").select("doc_id", F.explode(emails.extract_emails(F.col("text"))).alias("email"))


@query()
def x2_extract_phones(spark, sf_dir):
    """DuckDB's patterns can't look around; compared with brute force in tests."""
    return read(spark, sf_dir, "documents").where(r"text rlike '\\d'").select("doc_id", F.explode(phones.extract_phones(F.col("text"))).alias("phone"))


NUMBER = "CASE c_custkey % 5 WHEN 0 THEN '020 7946 ' || lpad(CAST(c_custkey % 1000 AS STRING), 4, '0') WHEN 1 THEN '+44 20 7946 0018' WHEN 2 THEN '123' WHEN 3 THEN '0044 (0)20 7946 0018' ELSE '07700 900' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') END"


@query(f"SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '+44207946' || lpad(CAST(c_custkey % 1000 AS STRING), 4, '0') WHEN 2 THEN NULL WHEN 4 THEN '+447700900' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') ELSE '+442079460018' END AS e164 FROM customer")
def n17_phone_e164(spark, sf_dir):
    return read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{NUMBER} AS v").select("c_custkey", phones.e164(F.col("v"), "GB").alias("e164"))


#: region: (how a number is written there, its E.164 form), where # stands for three digits
REGION_NUMBERS = {
    "NL": ("020 123 4#", "+31201234#"), "DE": ("030 / 123#", "+4930123#"), "FR": ("01 23 45 6#", "+33123456#"), "US": ("(212) 555-0#", "+12125550#"), "BE": ("02 555 0#", "+3225550#"),
    "ES": ("912 345 #", "+34912345#"), "PT": ("212 345 #", "+351212345#"), "CH": ("044 668 1#", "+41446681#"), "SE": ("08-123 #", "+468123#"), "DK": ("32 12 3#", "+4532123#"),
    "PL": ("12 345 6#", "+48123456#"), "AU": ("02 9374 4#", "+61293744#"), "AE": ("04 123 4#", "+97141234#"), "IE": ("01 234 5#", "+35312345#"),
}


def _regional(i: int) -> str:
    return "CASE " + " ".join(f"WHEN s_suppkey % {len(REGION_NUMBERS)} = {k} THEN replace('{v[i]}', '#', lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0'))" for k, v in enumerate(REGION_NUMBERS.values())) + " END"


@query(f"SELECT s_suppkey, {pick(tuple(REGION_NUMBERS), 's_suppkey')} AS region, {_regional(1)} AS e164 FROM supplier")
def n17_phone_regions(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{pick(tuple(REGION_NUMBERS), 's_suppkey')} AS region", f"{_regional(0)} AS v")
    return rows.select("s_suppkey", "region", phones.e164(F.col("v"), F.col("region")).alias("e164"))


#: Numbers of all plans: the country code and digits that vary, so that valid and invalid ones of each type are among them.
COUNTRY_CODES = tuple(dict.fromkeys(v[0] for v in numbering.PLANS.values()))
DIALLED = f"{pick(COUNTRY_CODES, 'c_custkey')} || lpad(CAST(c_custkey * 7368787 % 10000000000 AS STRING), CAST(7 + c_custkey % 4 AS INT), '8')"


def _ranges_sql() -> str:
    """Each prefix with its type and lengths, as rows; DuckDB takes the longest that fits."""
    return "(VALUES " + ", ".join(f"('{p}', '{k}', {list(n)})" for p, k, n in numbering.ranges()) + ") r(prefix, type, lengths)"


@query(f"WITH d AS (SELECT c_custkey, {DIALLED.replace('STRING', 'VARCHAR')} AS digits FROM customer), m AS (SELECT c_custkey, digits, type, lengths FROM d LEFT JOIN {_ranges_sql()} ON starts_with(digits, prefix) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY length(prefix) DESC) = 1) SELECT c_custkey, CASE WHEN list_contains(lengths, length(digits)) THEN '+' || digits END AS e164, CASE WHEN list_contains(lengths, length(digits)) THEN type END AS phone_type FROM m")
def n19_number_types(spark, sf_dir):
    """Validity and type of valid, invalid, mobile and special numbers of all plans; the index of ranges against the longest prefix."""
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", f"concat('+', {DIALLED}) AS v")
    return rows.select("c_custkey", phones.e164(F.col("v")).alias("e164"), phones.phone_type(F.col("v")).alias("phone_type"))


SOCIAL = "CASE s_suppkey % 7 WHEN 0 THEN 'https://www.linkedin.com/company/acme-' || CAST(s_suppkey AS STRING) || '/?x=1' WHEN 1 THEN 'http://twitter.com//acme' || CAST(s_suppkey AS STRING) || '/' WHEN 2 THEN 'https://facebook.com/login' WHEN 3 THEN 'https://www.youtube.com/@acme?utm_source=a&t=1' WHEN 4 THEN 'https://example.com/in/x' WHEN 5 THEN 'https://instagram.com/' ELSE 'https://linkedin.com/in/john-smith/?trk=p' END"


@query(f"WITH v AS (SELECT s_suppkey, {SOCIAL} AS u FROM supplier) SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'https://linkedin.com/company/acme-' || s_suppkey WHEN 1 THEN 'https://x.com/acme' || s_suppkey WHEN 2 THEN 'https://facebook.com/login' WHEN 3 THEN 'https://youtube.com/@acme?t=1' WHEN 5 THEN 'https://instagram.com/' WHEN 6 THEN 'https://linkedin.com/in/john-smith' END AS normal, CASE s_suppkey % 7 WHEN 0 THEN 'linkedin_company' WHEN 1 THEN 'x' WHEN 3 THEN 'youtube' WHEN 6 THEN 'linkedin_profile' END AS kind, CASE WHEN s_suppkey % 7 = 6 THEN 'https://www.linkedin.com/in/john-smith' END AS profile, CASE WHEN s_suppkey % 7 = 6 THEN 'John Smith' END AS slug_name FROM v")
def n21_social_urls(spark, sf_dir):
    u = F.col("u")
    rows = read(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{SOCIAL} AS u")
    return rows.select("s_suppkey", social.normalize_social_url(u).alias("normal"), social.classify_social_url(u)["kind"].alias("kind"), social.normalize_linkedin_url(u).alias("profile"), social.name_from_linkedin_slug(u).alias("slug_name"))


# Pages ---------------------------------------------------------------------------------------------------------------

ANCHORS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"
SITE = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


def _links(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return p.select((F.col("page_id") % 20).alias("company_id"), "page_id", "url", F.transform(hrefs, lambda h: F.when(h.startswith("/"), F.concat(host, h)).otherwise(h)).alias("links"))


@query(f"WITH l AS (SELECT page_id, url, unnest({ANCHORS}) AS h FROM pages), a AS (SELECT page_id, CASE WHEN starts_with(h, '/') THEN {SITE} || h ELSE h END AS u, {SITE} AS s FROM l) SELECT page_id, count(DISTINCT u) AS n FROM a WHERE regexp_matches(u, '^https?://') AND regexp_replace(lower(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') = regexp_replace(lower(regexp_extract(s, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') GROUP BY page_id")
def s9_internal_links(spark, sf_dir):
    own = _links(spark, sf_dir).select("page_id", extraction.internal_links(F.col("links"), F.col("url")).alias("links"))
    return own.select("page_id", F.size("links").cast("long").alias("n")).where("n > 0")


PAGE_SCORE = "list_max(list_transform(parts, lambda p: coalesce(CAST(" + _cases(V.BUSINESS_PAGE_WEIGHTS, "p") + " AS INTEGER), 0)))"
EXTRA = "'/' || CASE page_id % 6 WHEN 0 THEN 'about-us' WHEN 1 THEN 'Team' WHEN 2 THEN 'pages/contact' WHEN 3 THEN 'blog/team' WHEN 4 THEN 'en/our-people' ELSE 'x' END"


@query(f"WITH l AS (SELECT DISTINCT page_id % 20 AS company_id, {SITE} || {EXTRA} AS url FROM pages UNION SELECT page_id % 20, CASE WHEN starts_with(h, '/') THEN {SITE} || h ELSE h END FROM (SELECT page_id, url, unnest({ANCHORS}) AS h FROM pages)), w AS (SELECT company_id, url, list_filter(string_split(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda p: trim(p) <> '') AS parts FROM l WHERE regexp_matches(url, '^https?://')), s AS (SELECT company_id, url, CASE WHEN len(list_filter(parts, lambda p: p IN {_in(V.BUSINESS_PAGE_REJECTED)})) > 0 THEN 0 ELSE {PAGE_SCORE} END AS score, length(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')) AS path_length FROM w WHERE len(parts) > 0) SELECT company_id, url, score::INTEGER AS score, CAST(row_number() OVER (PARTITION BY company_id ORDER BY score DESC, path_length, url) AS INTEGER) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5")
def w1_business_pages(spark, sf_dir):
    p = _links(spark, sf_dir)
    more = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.expr(EXTRA))
    rows = p.withColumn("links", F.array_append("links", more))
    return extraction.business_pages(extraction.page_candidates(rows)).select("company_id", "url", "score", "rank")


@query()
def w2_people_pages(spark, sf_dir):
    """Anchors are parsed in Python; the scores are compared with brute force in tests."""
    p = read(spark, sf_dir, "pages")
    more = F.concat(F.col("html"), F.expr("concat('<a href=\"', " + EXTRA + ", '\">Our <b>team</b></a>')"))
    return extraction.people_pages(p.select(F.col("page_id").alias("site"), "url", more.alias("html")))


@query("WITH d AS (SELECT source, doc_id, 'PAGE URL: doc/' || doc_id || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) AS chunk FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''), b AS (SELECT *, coalesce(sum(length(chunk)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d) SELECT source, md5(trim(string_agg(substr(chunk, 1, CAST(12000 - before AS BIGINT)), chr(10) || chr(10) ORDER BY doc_id), ' ' || chr(9) || chr(10) || chr(13))) AS context FROM b WHERE before < 12000 GROUP BY source")
def x20_model_context(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), "text")
    return extraction.model_context(d, "source", "doc_id").select("source", F.md5("context").alias("context"))


#: People of pages: first names, last names, titles as they stand there and in their usual form.
STAFF_FIRST, STAFF_LAST = ("Ann", "Kim", "Peter", "Maria", "John"), ("Baker", "Stone", "Fischer")
STAFF_TITLES = ("Managing Director", "Owner", "Founder", "CEO")
STAFF = f"{pick(STAFF_FIRST, 's_suppkey')} || ' ' || {pick(STAFF_LAST, 's_suppkey')}"
STAFF_TITLE, STAFF_SLUG = pick(STAFF_TITLES, "s_suppkey"), f"lower(replace({STAFF}, ' ', '-'))"
#: A card whose profile link stands beside name and title; a card with both in its heading; schema.org data.
TEAM_PAGE = f"""'<html><body>' || CASE s_suppkey % 3
    WHEN 0 THEN '<div class="team-member"><h3>' || {STAFF} || '</h3><p>' || {STAFF_TITLE} || '</p><a href="https://linkedin.com/in/' || {STAFF_SLUG} || '/">x</a></div><div class="team-member"><h3>Lee Wood</h3><p>Gardening</p></div>'
    WHEN 1 THEN '<div class="team-member person-card"><h3>' || {STAFF} || ', ' || {STAFF_TITLE} || '</h3><img alt="portrait"></div>'
    ELSE '<script type="application/ld+json">{{"@type": "Person", "name": "' || {STAFF} || '", "jobTitle": "' || {STAFF_TITLE} || '", "sameAs": ["https://www.linkedin.com/in/' || {STAFF_SLUG} || '"]}}</script>' END
    || '<a href="mailto:Info@Shop' || CAST(s_suppkey % 7 AS STRING) || '.com?x">m</a><a href="tel:+31 20 123 4' || lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0') || '">t</a><a href="https://twitter.com/shop' || CAST(s_suppkey AS STRING) || '">s</a></body></html>'"""


def _team_pages(spark, sf_dir):
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS company_id", "0 AS page", "concat('https://shop', s_suppkey, '.com') AS url", "concat('Mail sales@shop', s_suppkey, '.com or +1 (212) 555-01', lpad(s_suppkey % 100, 2, '0'), ' now') AS text", f"{TEAM_PAGE} AS html")


CONTACTS_SQL = (
    "SELECT s_suppkey AS company_id, 'email' AS kind, 'info@shop' || s_suppkey % 7 || '.com' AS value FROM supplier UNION SELECT s_suppkey, 'email', 'sales@shop' || s_suppkey || '.com' FROM supplier "
    "UNION SELECT s_suppkey, 'phone', '+31201234' || lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0') FROM supplier UNION SELECT s_suppkey, 'x', 'https://x.com/shop' || s_suppkey FROM supplier "
    f"UNION SELECT s_suppkey, 'linkedin_profile', 'https://linkedin.com/in/' || {STAFF_SLUG} FROM supplier WHERE s_suppkey % 3 = 0"
)


@query(CONTACTS_SQL)
def x5_contacts(spark, sf_dir):
    found = extraction.contacts(_team_pages(spark, sf_dir))
    return extraction.normalize_contacts(found, "NL").select("company_id", "kind", F.col("normalized_value").alias("value"))


@query(f"SELECT s_suppkey AS company_id, {STAFF} AS name, {STAFF_TITLE} AS title, CASE WHEN s_suppkey % 3 <> 1 THEN 'https://www.linkedin.com/in/' || {STAFF_SLUG} END AS linkedin_url FROM supplier")
def x18_people(spark, sf_dir):
    return extraction.people(extraction.parsed(_team_pages(spark, sf_dir))).select("company_id", "name", "title", "linkedin_url")


# Companies and people ------------------------------------------------------------------------------------------------


@query("WITH l AS (SELECT o_orderkey AS ordinal, o_orderpriority AS title, CASE o_orderkey % 3 WHEN 0 THEN 'p' || o_custkey % 300 END AS place_id, CASE o_orderkey % 4 WHEN 0 THEN 'c' || o_custkey % 100 WHEN 1 THEN ' ' END AS cid, CASE o_orderkey % 5 WHEN 0 THEN 'd' || o_custkey % 50 END AS data_id FROM orders), e AS (SELECT ordinal, title, coalesce(nullif(trim(place_id), ''), nullif(trim(cid), ''), nullif(trim(data_id), '')) AS external_id FROM l) SELECT * FROM e QUALIFY external_id IS NULL OR row_number() OVER (PARTITION BY external_id ORDER BY ordinal) = 1")
def d1_listings_once(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS ordinal", "o_orderpriority AS title", "CASE o_orderkey % 3 WHEN 0 THEN concat('p', o_custkey % 300) END AS place_id", "CASE o_orderkey % 4 WHEN 0 THEN concat('c', o_custkey % 100) WHEN 1 THEN ' ' END AS cid", "CASE o_orderkey % 5 WHEN 0 THEN concat('d', o_custkey % 50) END AS data_id")
    return C.deduplicate_listings(rows).select("ordinal", "title", "external_id")


@query(ctes("companies") + "SELECT id, k.field, k.value FROM companies, LATERAL (VALUES ('domain', domain), ('phone', phone), ('name_location', CASE WHEN coalesce(city, country, address) IS NOT NULL THEN concat_ws('|', normalized_name, city, country, address) END)) k(field, value) WHERE k.value IS NOT NULL")
def d2_match_keys(spark, sf_dir):
    return frame(spark, sf_dir, "companies").select("id", F.explode(C.match_keys()).alias("k")).select("id", "k.field", "k.value")


@query()
def d3_company_fold(spark, sf_dir):
    """Order-dependent folding; compared with brute force in tests."""
    rows = read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS ordinal", "c_name AS name", "concat('company ', c_custkey % 700) AS normalized_name", "CAST(NULL AS STRING) AS website", "CASE WHEN c_custkey % 3 = 0 THEN concat('d', c_custkey % 400, '.com') END AS domain",
        "CASE WHEN c_custkey % 4 = 0 THEN concat('+', c_custkey % 500) END AS phone", "CASE WHEN c_custkey % 2 = 0 THEN concat('N', c_nationkey) END AS country", "CASE WHEN c_custkey % 5 = 0 THEN concat('City ', c_custkey % 7) END AS city", "CAST(NULL AS STRING) AS address", "c_mktsegment AS category",
    )
    return C.fold_companies(rows)


@query()
def d5_resolve_people(spark, sf_dir):
    """Likeness of names is Python's; compared with brute force in tests."""
    rows = frame(spark, sf_dir, "people").select("company_id", F.col("id").alias("ordinal"), "name", "title", "linkedin_url", F.concat(F.lit("https://c"), F.col("company_id"), F.lit(".com/team")).alias("source_url"))
    return identity.resolve_people(rows)


#: The usual forms of base.FIRST, base.LAST and base.TITLES, and the roles of the latter.
FIRST_FORMS = ("Ann", "Jan", "Maria", "Peter", "Anne-Marie", "Dr. John", "Kim", "Lee Ann")
LAST_FORMS = ("Smith", "van der Berg", "de Vries", "O'Connor", "Jansen", "Clinic", "Stone4", "Baker")
TITLE_FORMS = ("CEO", "Co-Founder", "Head Of Marketing", "Eigenaar", "Dentist", "", "Managing Director", "Designer")
TITLE_ROLES = ("primary", "professional", "other", "primary", "professional", "unknown", "primary", "professional")


@query(f"SELECT c_custkey AS id, {pick(FIRST_FORMS, 'c_custkey')} || ' ' || {pick(LAST_FORMS, 'c_custkey % 13')} AS name, nullif({pick(TITLE_FORMS, 'c_custkey % 11')}, '') AS title, {pick(TITLE_ROLES, 'c_custkey % 11')} AS role FROM customer")
def n24_person_names(spark, sf_dir):
    p = frame(spark, sf_dir, "people")
    return p.select("id", person.normalize_person_name(F.col("name")).alias("name"), person.normalize_person_title(F.col("title")).alias("title"), person.title_role(F.col("title")).alias("role"))


@query(f"SELECT c_custkey AS id, {pick(FIRST_FORMS, 'c_custkey')} || ' ' || {pick(LAST_FORMS, 'c_custkey % 13')} AS name, nullif({pick(TITLE_FORMS, 'c_custkey % 11')}, '') AS title, CASE WHEN c_custkey % 4 = 0 THEN 'https://www.linkedin.com/in/p-' || CAST(c_custkey % 50 AS VARCHAR) END AS linkedin_url, 'page ' || c_custkey AS source_url FROM customer")
def n28_normalize_person(spark, sf_dir):
    p = frame(spark, sf_dir, "people")
    one = person.normalize_person(F.col("name"), F.col("title"), F.col("linkedin_url"), F.concat(F.lit("page "), F.col("id").cast("string")))
    return p.select("id", one.alias("p")).select("id", "p.*")


@query(ctes("source_records") + "SELECT * FROM source_records QUALIFY external_id IS NULL OR row_number() OVER (PARTITION BY source_id, external_id ORDER BY collected_at DESC, id DESC) = 1")
def k6_provenance(spark, sf_dir):
    return C.provenance(frame(spark, sf_dir, "source_records"))


@query("WITH s AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'w' || s_suppkey END AS website FROM supplier), i AS (SELECT c_custkey AS id, c_name AS name, 'new' || c_custkey AS website FROM customer) SELECT coalesce(s.id, i.id) AS id, CASE WHEN s.id IS NOT NULL THEN s.name ELSE i.name END AS name, coalesce(s.website, i.website) AS website FROM s FULL JOIN i ON s.id = i.id")
def k3_upsert(spark, sf_dir):
    stored = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "CASE WHEN s_suppkey % 2 = 0 THEN concat('w', s_suppkey) END AS website")
    incoming = read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "concat('new', c_custkey) AS website")
    return C.upsert_snapshot(stored, incoming, "id", ["website"])


@query("SELECT r_name AS name FROM region UNION SELECT n_name FROM nation UNION SELECT r_name FROM region")
def k5_new_sources(spark, sf_dir):
    known, wanted = read(spark, sf_dir, "region").selectExpr("r_name AS name"), read(spark, sf_dir, "nation").selectExpr("n_name AS name")
    return C.new_sources(known, wanted.unionByName(known))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def k_orphans(spark, sf_dir):
    return sinks.orphans(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", read(spark, sf_dir, "supplier"), "s_suppkey")


# Sources -------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, k.name, k.version, k.confidence FROM events, LATERAL (VALUES (event_type, CAST(event_id % 4 AS VARCHAR), CAST(event_id % 100 AS INTEGER)), ('Base', NULL, 100)) k(name, version, confidence)")
def s10_technologies(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr("event_id", """concat('{"https://a.com": {"', event_type, '": {"version": "', event_id % 4, '", "confidence": ', event_id % 100, ', "categories": ["c", "d"]}, "Base": {"version": ""}}}') AS report""")
    return e.select("event_id", F.explode(readers.technologies(F.col("report"))).alias("t")).select("event_id", "t.name", "t.version", "t.confidence")


@query("SELECT event_id, CAST(round_even(event_id % 201 / 200.0 * 100, 0) AS INTEGER) AS performance, CAST(round_even(event_id % 101 / 100.0 * 100, 0) AS INTEGER) AS seo FROM events")
def s11_performance(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr("event_id", """concat('{"lighthouseResult": {"categories": {"performance": {"score": ', CAST(event_id % 201 / 200.0D AS STRING), '}}}, "categories": {"seo": {"score": ', CAST(event_id % 101 / 100.0D AS STRING), '}}}') AS report""")
    return e.select("event_id", readers.category_score(F.col("report"), "performance").alias("performance"), readers.category_score(F.col("report"), "seo").alias("seo"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE event_type END AS status, event_id % 3 <> 0 AS valid, CASE WHEN event_id % 3 = 0 THEN 'blocked' ELSE 'timeout' END AS smtp_verdict, CASE WHEN event_id % 3 = 0 THEN 'smtp_blocked' ELSE 'mailbox_not_found' END AS reasons FROM events")
def s13_email_verdict(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr("event_id", """concat('{"status": "', event_type, '", "valid": true, "score": 50, "smtp": {"verdict": "timeout", "message": "', if(event_id % 3 = 0, '550 Spamhaus listed', 'no answer'), '"}, "reasons": ["mailbox_not_found"]}') AS report""")
    return e.withColumn("v", readers.email_verdict(F.col("report"))).select("event_id", "v.status", "v.valid", "v.smtp_verdict", F.array_join("v.reasons", ",").alias("reasons"))


# Plans, states -------------------------------------------------------------------------------------------------------


def _targets(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return n.selectExpr("'p' AS plan", "n_name AS country", "concat('C', n_nationkey) AS country_code", "concat('seg', n_regionkey) AS segment", "CASE n_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority", "n_nationkey AS target", "array('dentist', 'clinic', concat('k', n_nationkey)) AS keywords", "array('A', 'B') AS cities")


PLAN = "q AS (SELECT 'p' AS plan, n_name AS country, 'C' || n_nationkey AS country_code, 'seg' || n_regionkey AS segment, CASE n_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority, c.city, k.keyword, row_number() OVER (ORDER BY n_nationkey % 3, n_nationkey, c.city, k.i) AS position FROM nation, (VALUES ('A'), ('B')) c(city), LATERAL (VALUES (0, 'dentist'), (1, 'clinic'), (2, 'k' || n_nationkey)) k(i, keyword))"


@query(f"WITH {PLAN} SELECT * FROM q")
def j11_plan_expand(spark, sf_dir):
    from pyspark.sql import Window

    q = plan.expand(_targets(spark, sf_dir))
    return q.withColumn("position", F.row_number().over(Window.orderBy("run_order")).cast("long")).drop("run_order")


@query(f"WITH {PLAN} SELECT plan, segment, keyword, country_code, city FROM q WHERE NOT (keyword = 'dentist' AND city = 'A' AND CAST(substr(country_code, 2) AS INT) % 2 = 0)")
def j10_skip_completed(spark, sf_dir):
    q = plan.expand(_targets(spark, sf_dir))
    runs = q.where("keyword = 'dentist' and city = 'A'").withColumn("status", F.expr("CASE WHEN CAST(substr(country_code, 2) AS INT) % 2 = 0 THEN 'completed' ELSE 'failed' END"))
    return plan.without_completed(q, runs).select("plan", "segment", "keyword", "country_code", "city")


@query(ctes("companies", "stages") + ", n AS (SELECT * FROM stages QUALIFY row_number() OVER (PARTITION BY company_id, stage ORDER BY id DESC) = 1) SELECT c.id AS company_id FROM companies c WHERE NOT EXISTS (SELECT 1 FROM n s WHERE s.company_id = c.id AND s.stage = 'click' AND s.status = 'completed')")
def t1_pending(spark, sf_dir):
    items = frame(spark, sf_dir, "companies").selectExpr("id AS company_id")
    now = latest_per(frame(spark, sf_dir, "stages"), ["company_id", "stage"], F.col("id").desc())
    return state.pending(items, now, "click")


@query("WITH s AS (SELECT user_id AS company_id, event_type AS stage, CAST(count(*) AS INTEGER) AS attempts FROM events GROUP BY ALL), o AS (SELECT user_id * 2 AS company_id, event_type AS stage, max(event_id) % 3 <> 0 AS ok FROM events GROUP BY ALL) SELECT coalesce(s.company_id, o.company_id) AS company_id, coalesce(s.stage, o.stage) AS stage, CASE WHEN ok IS NULL THEN 'failed' WHEN ok THEN 'completed' ELSE 'failed' END AS status, coalesce(attempts, 0) + CASE WHEN ok IS NULL THEN 0 ELSE 1 END AS attempts, CASE WHEN ok IS NULL THEN 'Old' WHEN NOT ok THEN 'Timeout' END AS error_type FROM s FULL JOIN o ON s.company_id = o.company_id AND s.stage = o.stage")
def t2_advance(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    s = e.groupBy(F.col("user_id").alias("company_id"), F.col("event_type").alias("stage")).agg(F.count("*").cast("int").alias("attempts"))
    s = s.selectExpr("*", "'failed' AS status", "'Old' AS error_type", "'m' AS error_message", "CAST(NULL AS timestamp) AS completed_at", "CAST(NULL AS timestamp) AS updated_at")
    o = e.groupBy((F.col("user_id") * 2).alias("company_id"), F.col("event_type").alias("stage")).agg((F.max("event_id") % 3 != 0).alias("ok")).selectExpr("*", "'Timeout' AS error_type", "'slow' AS error_message")
    return state.advance(s, o, datetime(2024, 2, 1)).select("company_id", "stage", "status", "attempts", "error_type")


STEPS = "CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'retrying' END"


@query(f"WITH s AS (SELECT event_id, {STEPS} AS a, {STEPS.replace('event_id % 5', 'event_id * 3 % 5')} AS b FROM events) SELECT event_id, EXISTS (SELECT 1 FROM (VALUES " + ", ".join(f"('{k}', '{x}')" for k, v in state.TRANSITIONS.items() for x in v) + ") t(x, y) WHERE x = a AND y = b) AS legal FROM s")
def t4_transitions(spark, sf_dir):
    rows = read(spark, sf_dir, "events").selectExpr("event_id", f"{STEPS} AS a", f"{STEPS.replace('event_id % 5', 'event_id * 3 % 5')} AS b")
    return rows.select("event_id", state.is_legal(F.col("a"), F.col("b")).alias("legal"))


ERRORS = "CASE event_id % 7 WHEN 0 THEN 'ReadTimeout' WHEN 1 THEN 'ValueError' WHEN 2 THEN 'GroqParseError' WHEN 3 THEN 'IntegrityError' WHEN 4 THEN 'CrawlingProviderError' WHEN 5 THEN 'PageSpeedProviderError' ELSE 'KeyError' END"
MESSAGES = "CASE event_id % 5 WHEN 0 THEN 'HTTP 503 from host' WHEN 1 THEN 'Connection RESET by peer' WHEN 2 THEN 'bad value' WHEN 3 THEN NULL ELSE 'no' END"


@query(f"WITH e AS (SELECT event_id, {ERRORS} AS error, {MESSAGES} AS message FROM events) SELECT event_id, error = 'ReadTimeout' OR event_id % 5 IN (0, 1) AS retry, CASE error WHEN 'ValueError' THEN 'company_validation' WHEN 'GroqParseError' THEN 'people_ai' WHEN 'IntegrityError' THEN 'persistence' WHEN 'CrawlingProviderError' THEN 'homepage' WHEN 'PageSpeedProviderError' THEN 'website_performance' ELSE 'company_enrichment' END AS stage FROM e")
def f12_failures(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr("event_id", f"{ERRORS} AS error", f"{MESSAGES} AS message")
    return e.select("event_id", state.retryable(F.col("error"), F.col("message")).alias("retry"), state.failure_stage(F.col("error")).alias("stage"))


@query("SELECT event_id, event_id % 6 + 1 < 4 AS retry, least(2.0 * pow(2.0, event_id % 6), 15.0) AS delay_seconds FROM events")
def t6_retries(spark, sf_dir):
    return state.retry_schedule(read(spark, sf_dir, "events").selectExpr("event_id", "event_id % 6 + 1 AS attempt"), 4).select("event_id", "retry", "delay_seconds")


@query("WITH p AS (SELECT DISTINCT user_id AS company_id, event_type AS url FROM events UNION ALL SELECT -1, 'none'), c AS (SELECT user_id AS company_id, event_type AS url, max(ts) AS seen FROM events GROUP BY ALL) SELECT company_id, url, seen IS NULL OR TIMESTAMP '2024-01-31 00:00:00' - seen >= INTERVAL 2 DAY AS recrawl FROM p LEFT JOIN c USING (company_id, url)")
def p7_retention(spark, sf_dir):
    crawls = read(spark, sf_dir, "events").select(F.col("user_id").alias("company_id"), F.col("event_type").alias("url"), F.col("event_id").alias("id"), F.col("ts").alias("collected_at"))
    pages = crawls.select("company_id", "url").distinct().unionByName(spark.range(1).selectExpr("-1L AS company_id", "'none' AS url"))
    return state.retention_split(pages, crawls, timedelta(days=2), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).select("company_id", "url", "recrawl")


@query("SELECT count(*) AS found, count(*) FILTER (event_type = 'click') AS new, count(*) FILTER (event_type = 'view') AS duplicates, count(*) FILTER (event_type IN ('click', 'view')) AS stored FROM events")
def a1_run_counters(spark, sf_dir):
    return state.run_counters(read(spark, sf_dir, "events").selectExpr("CASE event_type WHEN 'click' THEN 'new' WHEN 'view' THEN 'duplicate' END AS outcome"))


# Ledgers and counters ------------------------------------------------------------------------------------------------

NOW = "TIMESTAMP '2024-03-01 00:00:00'"
RUN_STATUS = pick(("completed", "failed", "running"), "c_custkey")
RUNS = {
    "id": "c_custkey", "plan_name": "'plan' || CAST(c_nationkey AS STRING)", "segment": "c_mktsegment", "keyword": "c_name", "country_code": "'C' || CAST(c_nationkey AS STRING)", "city": "'A'",
    "status": RUN_STATUS, "started_at": "TIMESTAMP '2024-02-01 00:00:00'", "completed_at": f"CASE WHEN {RUN_STATUS} <> 'running' THEN TIMESTAMP '2024-02-02 00:00:00' END",
}
RUNS_SQL = "WITH r AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RUNS.items()) + " FROM customer) "


def _runs(spark, sf_dir):
    return read(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {c}" for c, e in RUNS.items()])


@query(RUNS_SQL + f"SELECT plan_name, segment, keyword, country_code, city, status, started_at, completed_at FROM r UNION ALL SELECT plan_name, segment, keyword, country_code, city, 'running', {NOW}, NULL FROM r WHERE status <> 'completed'")
def k13_start_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return ledger.start_runs(runs, runs, F.expr(NOW)).drop("id")


@query(RUNS_SQL + f"SELECT id, plan_name, segment, keyword, country_code, city, CASE WHEN status <> 'running' THEN status WHEN id % 2 = 0 THEN 'completed' ELSE 'failed' END AS status, started_at, CASE WHEN status = 'running' THEN {NOW} ELSE completed_at END AS completed_at FROM r")
def k13_finish_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return ledger.finish_runs(runs, runs.selectExpr("id", "id % 2 = 0 AS ok"), F.expr(NOW))


@query(RUNS_SQL + "SELECT plan_name, count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running FROM r GROUP BY plan_name")
def g11_plan_counters(spark, sf_dir):
    return ledger.plan_counters(_runs(spark, sf_dir))


@query(ctes("companies", "people") + ", o AS (SELECT c.id, id % 7 <> 0 AS ok, coalesce(website <> '', false) AS has FROM companies c) SELECT count(*) AS selected, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok AND has) AS companies_with_website, count(*) FILTER (ok AND NOT has) AS companies_without_website, (SELECT count(*) FROM people p JOIN o ON o.id = p.company_id WHERE ok) AS people_found, (SELECT count(*) FROM people p JOIN o ON o.id = p.company_id WHERE ok AND title = 'CEO') AS decision_makers_found FROM o")
def a2_batch_counters(spark, sf_dir):
    c = frame(spark, sf_dir, "companies")
    people = frame(spark, sf_dir, "people").selectExpr("company_id", "title = 'CEO' AS is_decision_maker")
    return ledger.batch_counters(c, c.selectExpr("id AS company_id", "id % 7 <> 0 AS ok"), people)


MAIL = "CASE c_custkey % 5 WHEN 0 THEN 'Info@Example' || CAST(c_custkey % 9 AS STRING) || '.com' WHEN 1 THEN 'no address' END"


@query(f"WITH t AS (SELECT c_custkey, {MAIL} AS email, c_custkey % 10 = 0 AS done, c_custkey % 9 AS generated FROM customer), a AS (SELECT event_type <> 'click' AS ok, event_type = 'purchase' AND value > 20 AS q FROM events), x AS (SELECT count(*) AS attempted, count(*) FILTER (done) AS already_verified, sum(generated) FILTER (NOT done)::BIGINT AS generated, count(*) FILTER (email = 'no address') AS bad FROM t), y AS (SELECT count(*) FILTER (ok) AS verified, count(*) FILTER (q) AS qualified, count(*) FILTER (NOT ok) AS lost FROM a) SELECT attempted, verified, qualified, already_verified, generated, bad + lost AS failed, verified AS persisted FROM x, y")
def a12_email_counters(spark, sf_dir):
    targets = read(spark, sf_dir, "customer").selectExpr("c_custkey AS person_id", f"{MAIL} AS email", "c_custkey % 10 = 0 AS already_verified", "c_custkey % 9 AS generated")
    attempts = read(spark, sf_dir, "events").selectExpr("user_id AS person_id", "event_id AS attempt", "event_type <> 'click' AS ok", "event_type = 'purchase' AND value > 20 AS is_qualified")
    return ledger.email_counters(targets.withColumn("normalized_email", emails.normalize_email(F.col("email"))), attempts)


# Observations --------------------------------------------------------------------------------------------------------

SEEN_AT = f"coalesce(CASE WHEN event_id % 4 > 0 THEN CAST(ts AS TIMESTAMP) END, {NOW})"


@query(f"SELECT user_id AS company_id, k.kind, k.value, k.normal AS normalized_value, 'https://a.com' AS source_url, {SEEN_AT} AS observed_at FROM events, LATERAL (VALUES ('email', 'Info' || event_id || '@Shop.com', 'info' || event_id || '@shop.com'), ('x', 'http://twitter.com/u' || event_id || '/', 'https://x.com/u' || event_id), ('email', 'no address', NULL)) k(kind, value, normal) WHERE normalized_value IS NOT NULL")
def k7_contact_observations(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr("user_id AS company_id", "CASE WHEN event_id % 4 > 0 THEN CAST(ts AS TIMESTAMP) END AS observed_at", "'https://a.com' AS source_url", "inline(array(named_struct('kind', 'email', 'value', concat('Info', event_id, '@Shop.com')), named_struct('kind', 'x', 'value', concat('http://twitter.com/u', event_id, '/')), named_struct('kind', 'email', 'value', 'no address')))")
    return observations.contacts(e, F.expr(NOW))


@query(ctes("people", "observations") + f"SELECT p.id AS person_id, p.company_id, 'site' AS provider_name, p.name, o.title, o.linkedin_url, o.decision_maker_score, o.role_group, o.confidence, {NOW} AS observed_at FROM people p JOIN observations o ON o.person_id = p.id")
def k8_person_observations(spark, sf_dir):
    p, o = frame(spark, sf_dir, "people").select(F.col("id").alias("person_id"), "company_id", "name"), frame(spark, sf_dir, "observations")
    rows = p.join(o.drop("company_id", "id", "observed_at"), "person_id")
    nameless = rows.withColumn("name", F.lit(None).cast("string"))
    return observations.people(rows.unionByName(nameless), "site", F.expr(NOW))


@query(f"WITH {QUALIFIED_SQL} SELECT person_id, id % 50 AS company_id, 'verifier' AS provider_name, 'U' || id || '@Example.com' AS email, 'u' || id || '@example.com' AS normalized_email, confidence, verification_method, status AS verification_result, from_pattern AS pattern_inferred, {NOW} AS observed_at FROM q WHERE id % 6 > 0")
def k9_person_email_observations(spark, sf_dir):
    rows = _verdicts(spark, sf_dir).selectExpr("*", "id % 50 AS company_id", "CASE WHEN id % 6 > 0 THEN concat('U', id, '@Example.com') END AS email")
    return observations.person_emails(rows, "verifier", F.expr(NOW))


@query(ctes("technologies") + f"SELECT company_id, 'detector' AS provider_name, name, version, 100 AS confidence, observed_at FROM technologies WHERE name <> 'click'")
def k10_technology_observations(spark, sf_dir):
    rows = frame(spark, sf_dir, "technologies").selectExpr("company_id", "nullif(name, 'click') AS name", "version", "100 AS confidence", "observed_at")
    return observations.technologies(rows, "detector", F.lit(None).cast("timestamp_ntz")).drop("categories", "groups")


@query(f"SELECT s_suppkey AS company_id, 'lab' AS provider_name, CAST(s_suppkey % 101 AS INTEGER) AS performance_score, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 97 AS INTEGER) END AS seo_score, {NOW} AS observed_at FROM supplier")
def k11_performance_observations(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    seo = s.selectExpr("s_suppkey AS company_id", "CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 97 AS INT) END AS seo_score").where("seo_score is not null")
    return observations.performance(s.selectExpr("s_suppkey AS company_id", "CAST(s_suppkey % 101 AS INT) AS performance_score"), seo, "lab", F.expr(NOW))


@query(f"SELECT DISTINCT user_id AS person_id, user_id % 9 AS company_id, 'mailer' AS provider_name, 'm' || user_id AS provider_message_id, 'u' || user_id || '@a.com' AS to_email, 'Hello' AS subject, {NOW} AS sent_at FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def k14_messages(spark, sf_dir):
    sent = read(spark, sf_dir, "events").selectExpr("user_id AS person_id", "user_id % 9 AS company_id", "concat('m', user_id) AS provider_message_id", "concat('u', user_id, '@a.com') AS to_email", "'Hello' AS subject")
    unconfirmed = sent.withColumn("provider_message_id", F.lit(None).cast("string"))
    known = read(spark, sf_dir, "supplier").selectExpr("concat('m', s_suppkey) AS provider_message_id")
    return observations.messages(sent.unionByName(unconfirmed), known, "mailer", F.expr(NOW)).drop("from_email", "reply_to")


# Model answers -------------------------------------------------------------------------------------------------------

ANSWER_KIND = "s_suppkey % 5"
ONE_ANSWER = f"""'{{"people": [{{"name": "' || {STAFF} || '", "title": "' || {STAFF_TITLE} || '", "decision_maker": true, "role_group": "' || CASE WHEN {ANSWER_KIND} = 2 THEN 'boss' ELSE 'primary' END || '", "decision_maker_confidence": "high", "decision_maker_reason": "runs it"}}]}}'"""
ANSWERS = f"CASE WHEN {ANSWER_KIND} = 1 THEN '```json' || chr(10) || {ONE_ANSWER} || chr(10) || '```' WHEN {ANSWER_KIND} = 3 THEN 'Sorry, no people.' ELSE {ONE_ANSWER} END"


@query(f"SELECT s_suppkey, {ANSWER_KIND} NOT IN (2, 3) AS usable, CASE WHEN {ANSWER_KIND} NOT IN (2, 3) THEN {STAFF} END AS name FROM supplier")
def s15_answers(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{ANSWERS} AS answer").withColumn("people", answers.parse_answer(F.col("answer")))
    return rows.select("s_suppkey", F.col("people").isNotNull().alias("usable"), F.get("people", F.lit(0))["name"].alias("name"))


@query(f"WITH c AS (SELECT s_suppkey, {ANSWER_KIND} NOT IN (2, 3) AND s_suppkey % 4 > 0 AS usable, {STAFF} AS name, {STAFF_TITLE} AS title FROM supplier) SELECT s_suppkey AS company_id, CASE WHEN usable THEN name ELSE 'Old ' || s_suppkey END AS name, CASE WHEN usable THEN title END AS title, 'https://a.com' AS source_url, usable AS is_decision_maker, CASE WHEN usable THEN 'primary' ELSE 'unknown' END AS role_group, CASE WHEN usable THEN 'high' ELSE 'low' END AS confidence, CASE WHEN usable THEN 'runs it' END AS reason, usable AS refined FROM c")
def x21_refine_people(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    told = s.selectExpr("s_suppkey AS company_id", "'https://a.com' AS homepage_url", "CASE WHEN s_suppkey % 4 > 0 THEN 'pages' END AS context", f"{ANSWERS} AS answer")
    known = s.selectExpr("s_suppkey AS company_id", "0L AS ordinal", "concat('Old ', s_suppkey) AS name", "CAST(NULL AS STRING) AS title", "CAST(NULL AS STRING) AS linkedin_url", "'https://a.com' AS source_url")
    return answers.refine_people(known, told).drop("ordinal", "linkedin_url")


# Stages --------------------------------------------------------------------------------------------------------------

LAB_REPORT = """CASE WHEN s_suppkey % 4 > 0 THEN '{"categories": {"performance": {"score": 0.' || CAST(s_suppkey % 9 + 1 AS STRING) || '}' || CASE WHEN s_suppkey % 2 = 0 THEN ', "seo": {"score": 1}' ELSE '' END || '}}' ELSE '{}' END"""
DONE = "s_suppkey % 6 = 5"


def _stage_input(spark, sf_dir, stage: str):
    """Companies, and states in which some have completed the stage."""
    s = read(spark, sf_dir, "supplier")
    states = s.where(DONE).selectExpr("s_suppkey AS company_id", f"'{stage}' AS stage", "'completed' AS status", "1 AS attempts", "CAST(NULL AS STRING) AS error_type", "CAST(NULL AS STRING) AS error_message", f"{NOW} AS completed_at", f"{NOW} AS updated_at")
    return s, s.selectExpr("s_suppkey AS company_id"), states


@query(f"SELECT s_suppkey AS company_id, 'lab' AS provider_name, CAST((s_suppkey % 9 + 1) * 10 AS INTEGER) AS performance_score, CASE WHEN s_suppkey % 2 = 0 THEN 100 END AS seo_score FROM supplier WHERE s_suppkey % 4 > 0 AND NOT {DONE}")
def g4_performance_stage(spark, sf_dir):
    s, items, states = _stage_input(spark, sf_dir, "performance_seo")
    reports = s.selectExpr("s_suppkey AS company_id", f"{LAB_REPORT} AS report")
    return jobs.performance_stage(items, reports, states, datetime(2024, 3, 1))["rows"].drop("observed_at")


@query(f"SELECT s_suppkey AS company_id, 'performance_seo' AS stage, CASE WHEN {DONE} OR s_suppkey % 4 > 0 THEN 'completed' ELSE 'failed' END AS status, 1 AS attempts, CASE WHEN NOT {DONE} AND s_suppkey % 4 = 0 THEN 'PerformanceProviderError' END AS error_type FROM supplier")
def t3_stage_states(spark, sf_dir):
    s, items, states = _stage_input(spark, sf_dir, "performance_seo")
    reports = s.selectExpr("s_suppkey AS company_id", f"{LAB_REPORT} AS report")
    return jobs.performance_stage(items, reports, states, datetime(2024, 3, 1))["states"].select("company_id", "stage", "status", "attempts", "error_type")


@query(f"SELECT s_suppkey AS company_id, 'detector' AS provider_name, k.name, k.version, k.confidence FROM supplier, LATERAL (VALUES ('Shop', CAST(s_suppkey % 5 AS VARCHAR), 80), ('Base', NULL, 100)) k(name, version, confidence) WHERE NOT {DONE}")
def g3_technology_stage(spark, sf_dir):
    s, items, states = _stage_input(spark, sf_dir, "technology_detection")
    reports = s.selectExpr("s_suppkey AS company_id", """concat('{"https://a.com": {"Shop": {"version": "', s_suppkey % 5, '", "confidence": 80}, "Base": {}}}') AS report""")
    return jobs.technology_stage(items, reports, states, datetime(2024, 3, 1))["rows"].drop("observed_at", "categories", "groups")


@query(f"WITH c AS ({CONTACTS_SQL}) SELECT * FROM c WHERE company_id NOT IN (SELECT s_suppkey FROM supplier WHERE {DONE})")
def g1_contacts_stage(spark, sf_dir):
    _, items, states = _stage_input(spark, sf_dir, "contacts")
    rows = jobs.contacts_stage(items, _team_pages(spark, sf_dir), states, datetime(2024, 3, 1), "NL")["rows"]
    return rows.select("company_id", "kind", F.col("normalized_value").alias("value"))


@query(f"SELECT s_suppkey AS company_id, 'https://a' || s_suppkey || '.com/' || k.p AS url, CAST(k.rank AS INTEGER) AS rank FROM supplier, (VALUES ('team', 1), ('about', 2), ('contact', 3)) k(p, rank) WHERE NOT {DONE}")
def g2_business_pages_stage(spark, sf_dir):
    s, items, states = _stage_input(spark, sf_dir, "business_pages")
    site = "concat('https://a', s_suppkey, '.com/', '{}')"
    crawls = s.selectExpr("s_suppkey AS company_id", site.format("") + " AS url", "array(" + ", ".join(site.format(p) for p in ("contact", "team", "shop/team", "x", "about", "team")) + ") AS links")
    return jobs.business_pages_stage(items, crawls, states, datetime(2024, 3, 1))["rows"].select("company_id", "url", "rank")


# Own extensions ------------------------------------------------------------------------------------------------------


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_windows(spark, sf_dir):
    return landing.event_windows(read(spark, sf_dir, "events")).select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, CAST(k AS BIGINT) AS nth FROM s GROUP BY user_id, k")
def events_sessions(spark, sf_dir):
    from pyspark.sql import Window

    s = landing.sessions(read(spark, sf_dir, "events"))
    return s.select("user_id", "n", F.row_number().over(Window.partitionBy("user_id").orderBy("start")).cast("long").alias("nth"))


# Functions and small operators by themselves --------------------------------------------------------------------------


@query(NORMAL_EMAILS + f" SELECT c_custkey, email AS address, split_part(email, '@', 1) AS local_part, split_part(email, '@', 2) AS domain, CASE WHEN split_part(email, '@', 2) IN {_in(V.FREE_EMAIL_PROVIDERS)} THEN split_part(email, '@', 2) END AS provider, split_part(email, '@', 2) IN {_in(V.FREE_EMAIL_PROVIDERS)} AS is_free_provider, split_part(split_part(email, '@', 1), '+', 1) IN {_in(V.ROLE_EMAIL_PREFIXES)} AS is_role_address FROM k WHERE email IS NOT NULL")
def n12_parse_email(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{EMAIL_RAW} AS v")
    return rows.select("c_custkey", emails.parse_email(F.col("v")).alias("e")).where("e is not null").select("c_custkey", "e.*")


@query(NORMAL_EMAILS + " SELECT c_custkey, coalesce(email || ',', '') || 'zz@gmail.com' AS addresses FROM k")
def n16_normalize_emails(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{EMAIL_RAW} AS v")
    many = F.array(F.lit("ZZ@gmail.com"), F.col("v"), F.concat(F.lit(" "), "v", F.lit("  ")), F.lit("none"))
    return rows.select("c_custkey", F.array_join(emails.normalize_emails(many), ",").alias("addresses"))


CALLED = "CASE c_custkey % 5 WHEN 0 THEN 'tel:+1-212-' || CAST(1000000 + c_custkey AS STRING) || ';ext=1' WHEN 1 THEN ' (111) 111-1111 ' WHEN 2 THEN CAST(c_custkey % 1000 AS STRING) WHEN 3 THEN '00 ' || CAST(1000000 + c_custkey AS STRING) || ' ' || CAST(1000000 + c_custkey AS STRING) || '?x=1' ELSE 'call' END"


@query(f"WITH r AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(trim({CALLED}), '^tel:', '', 'i'), '[?;].*$', '')) AS v FROM customer), d AS (SELECT c_custkey, v, regexp_replace(v, '\\D', '', 'g') AS n FROM r) SELECT c_custkey, CASE WHEN n <> '' AND starts_with(v, '+') THEN '+' || n ELSE n END AS candidate, length(n) BETWEEN 7 AND 15 AND n <> repeat(n[1], length(n)) AS plausible FROM d")
def f11_plausible_phones(spark, sf_dir):
    found = phones.phone_candidate(F.col("v"))
    return read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{CALLED} AS v").select("c_custkey", found.alias("candidate"), phones.is_plausible_phone(found).alias("plausible"))


@query(ctes("companies") + "SELECT id FROM companies WHERE created_day >= 10 AND created_day < 30 AND coalesce(website, '') = ''")
def f4_created_range(spark, sf_dir):
    c = frame(spark, sf_dir, "companies").withColumn("created_at", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(created_day)"))
    wanted = leads.ExportFilters(created_after=datetime(2024, 1, 11), created_before=datetime(2024, 1, 31), has_website=False)
    return leads.filter_companies(c, wanted, *[frame(spark, sf_dir, t) for t in ("performance", "stages", "people", "contacts", "observations")]).select("id")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200")
def w11_keyset_page(spark, sf_dir):
    """One page of a keyset scan: the 200 rows after a cursor."""
    return readers.read_table(spark, f"{sf_dir}/events.parquet", ["event_id", "user_id", "event_type"], after_id=500, limit=200, key="event_id")


@query(ctes("technologies") + "SELECT company_id, first(version ORDER BY observed_at, id) FILTER (WHERE version IS NOT NULL) AS version FROM technologies GROUP BY company_id")
def a11_first_non_null(spark, sf_dir):
    return frame(spark, sf_dir, "technologies").groupBy("company_id").agg(first_non_null(F.col("version"), F.col("observed_at"), F.col("id")).alias("version"))


@query(ctes("email_observations") + "SELECT DISTINCT person_id, normalized_email AS email FROM email_observations o WHERE NOT EXISTS (SELECT 1 FROM email_observations d WHERE d.person_id = o.person_id AND d.normalized_email = o.normalized_email AND d.verification_result = 'deliverable')")
def p8_without_verified(spark, sf_dir):
    seen = frame(spark, sf_dir, "email_observations")
    return outreach.without_verified(seen.select("person_id", F.col("normalized_email").alias("email")).distinct(), seen)


GUESS_FIRST, GUESS_LAST = pick(("Ann", "Jan", "Peter"), "c_custkey"), pick(("Smith", "Jansen", "Baker", "Stone"), "c_custkey % 13")
GUESS_HOST = "'shop' || CAST(c_custkey % 9 AS STRING) || '.com'"
GUESS_KNOWN = f"CASE c_custkey % 4 WHEN 0 THEN 'Info@Example.com' WHEN 1 THEN {GUESS_FIRST} || '.' || {GUESS_LAST} || '@' || {GUESS_HOST} WHEN 2 THEN 'none' END"


@query(
    f"WITH r AS (SELECT c_custkey AS person_id, lower({GUESS_FIRST}) AS f, lower({GUESS_LAST}) AS l, '@' || {GUESS_HOST} AS h, nullif(lower({GUESS_KNOWN}), 'none') AS known FROM customer), "
    "p AS (SELECT person_id, known, list_filter([f || '.' || l || h, f || h, f[1] || l || h, f || l[1] || h, f || l || h, f || '_' || l || h, f || '-' || l || h], lambda e: known IS NULL OR e <> known) AS guessed FROM r), "
    "a AS (SELECT person_id, known, CASE WHEN known IS NULL THEN guessed ELSE list_prepend(known, guessed) END AS every FROM p) "
    "SELECT person_id, unnest(every) AS email, CAST(generate_subscripts(every, 1) - 1 AS INTEGER) AS attempt, unnest(every) IS DISTINCT FROM known AS from_pattern FROM a"
)
def p11_verification_candidates(spark, sf_dir):
    people = read(spark, sf_dir, "customer").selectExpr("c_custkey AS person_id", "c_custkey % 90 AS company_id", f"{GUESS_FIRST} || ' ' || {GUESS_LAST} AS name", f"{GUESS_HOST} AS host", f"{GUESS_KNOWN} AS email")
    return outreach.verification_candidates(people, F.col("host")).drop("company_id")


@query("SELECT user_id AS company_id, count(*) FILTER (WHERE event_id % 4 = 0) AS discarded, count(*) AS found FROM events GROUP BY user_id")
def p10_discarded_contacts(spark, sf_dir):
    good = pick(("a@b.com", "+44 20 7946 0018", "https://www.linkedin.com/in/x"), "event_id")
    bad = pick(("a@b", "12", "https://example.com/x"), "event_id")
    rows = read(spark, sf_dir, "events").selectExpr("user_id AS company_id", f"{pick(('email', 'phone', 'linkedin_profile'), 'event_id')} AS kind", f"CASE WHEN event_id % 4 = 0 THEN {bad} ELSE {good} END AS value")
    return extraction.discarded_contacts(rows)


LISTED = {
    "ordinal": "s_suppkey", "title": "CASE WHEN s_suppkey % 7 = 0 THEN '  ' ELSE ' ' || s_name || ' ' END", "website": "CASE WHEN s_suppkey % 5 > 0 THEN 'https://www.Shop' || CAST(s_suppkey AS STRING) || '.com:8080/x?y=1' END",
    "phone": "CASE WHEN s_suppkey % 3 > 0 THEN ' 020 123 ' ELSE '' END", "address": "CASE WHEN s_suppkey % 2 > 0 THEN 'Street 1' ELSE ' ' END", "complete_address": "CASE WHEN s_suppkey % 4 > 0 THEN 'Street 1, Utrecht' END", "category": "'shop '",
    "place_id": "CASE WHEN s_suppkey % 4 > 0 THEN 'p' || CAST(s_suppkey % 60 AS STRING) END", "cid": "' '", "data_id": "CASE WHEN s_suppkey % 8 > 0 THEN 'd' || CAST(s_suppkey % 6 AS STRING) END",
}


@query(
    f"WITH r AS (SELECT {', '.join(f'{e} AS {c}' for c, e in LISTED.items())} FROM supplier), e AS (SELECT *, coalesce(place_id, data_id) AS external_id FROM r QUALIFY external_id IS NULL OR row_number() OVER (PARTITION BY external_id ORDER BY ordinal) = 1) "
    "SELECT trim(title) AS name, website, lower(regexp_extract(website, 'www\\.([^/:]*)', 1)) AS domain, nullif(trim(phone), '') AS phone, 'Nederland' AS country, 'Utrecht' AS city, coalesce(nullif(trim(address), ''), complete_address) AS address, trim(category) AS category, external_id FROM e WHERE trim(title) <> ''"
)
def s6_load_results(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").selectExpr(*[f"{e} AS {c}" for c, e in LISTED.items()])
    return readers.load_results(rows, "Utrecht", "Nederland").drop("source_name")


RECORD = {
    "id": "s_suppkey", "name": "'  ' || s_name || '   B.V. '", "website": "CASE WHEN s_suppkey % 5 > 0 THEN ' HTTP://WWW.Shop' || CAST(s_suppkey AS STRING) || '.Com:80/Home/?q=1' END", "domain": "CASE WHEN s_suppkey % 3 > 0 THEN 'www.Own' || CAST(s_suppkey AS STRING) || '.nl' ELSE '' END",
    "phone": "' 020   123 '", "country": pick(("nederland", " Belgium ", " "), "s_suppkey"), "city": "' Den   Haag'", "address": "' '", "category": "'a  b'",
}


@query(
    f"WITH r AS (SELECT {', '.join(f'{e} AS {c}' for c, e in RECORD.items())} FROM supplier) SELECT id, trim(regexp_replace(name, ' +', ' ', 'g')) AS name, lower(trim(regexp_replace(name, ' +', ' ', 'g'))) AS normalized_name, CASE WHEN website IS NOT NULL THEN 'https://shop' || id || '.com/Home' END AS website, "
    f"CASE WHEN domain <> '' THEN 'own' || id || '.nl' WHEN website IS NOT NULL THEN 'shop' || id || '.com' END AS domain, '020 123' AS phone, CASE WHEN country = 'nederland' THEN '{V.COUNTRY_ALIASES['nederland']}' ELSE nullif(trim(country), '') END AS country, 'Den Haag' AS city, CAST(NULL AS VARCHAR) AS address, 'a b' AS category FROM r"
)
def n7_normalize_records(spark, sf_dir):
    return C.normalize_records(read(spark, sf_dir, "supplier").selectExpr(*[f"{e} AS {c}" for c, e in RECORD.items()]))


@query(ctes("people") + f"SELECT id, k.field, k.value FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 'https://www.linkedin.com/in/p-' || CAST(id % 50 AS STRING) END AS url, lower({pick(STAFF_FIRST, 'id')} || ' ' || {pick(STAFF_LAST, 'id')}) AS name FROM people), LATERAL (VALUES ('linkedin', url), ('name', name)) k(field, value) WHERE k.value IS NOT NULL")
def d4_person_match_keys(spark, sf_dir):
    p = frame(spark, sf_dir, "people").withColumn("name", F.expr(f"'  ' || upper({pick(STAFF_FIRST, 'id')}) || '   ' || {pick(STAFF_LAST, 'id')}"))
    return p.select("id", F.explode(person.person_match_keys(F.col("name"), F.col("linkedin_url"))).alias("k")).select("id", "k.field", "k.value")


@query(ctes("people") + f"SELECT id, CASE WHEN id % 4 = 0 THEN 'linkedin' ELSE 'name' END AS field, CASE WHEN id % 4 = 0 THEN 'https://www.linkedin.com/in/p-' || CAST(id % 50 AS STRING) ELSE lower({pick(STAFF_FIRST, 'id')} || ' ' || {pick(STAFF_LAST, 'id')}) END AS value FROM people")
def d11_person_identity(spark, sf_dir):
    p = frame(spark, sf_dir, "people").withColumn("name", F.expr(f"{pick(STAFF_FIRST, 'id')} || ' ' || upper({pick(STAFF_LAST, 'id')})"))
    return p.select("id", person.person_identity(F.col("name"), F.col("linkedin_url")).alias("k")).select("id", "k.field", "k.value")


@query(f"SELECT * FROM ({SQL['w3_rank_people']}) WHERE rank = 1 AND is_decision_maker")
def w5_best_decision_maker(spark, sf_dir):
    return w3_rank_people(spark, sf_dir).where("rank = 1 and is_decision_maker")


@query(f"SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'x' WHEN 2 THEN 'facebook' WHEN 3 THEN 'youtube' WHEN 5 THEN 'instagram' WHEN 6 THEN 'linkedin' END AS platform, CASE s_suppkey % 7 WHEN 0 THEN 'https://linkedin.com/company/acme-' || s_suppkey || ' https://tiktok.com/@shop' WHEN 1 THEN 'https://tiktok.com/@shop https://x.com/acme' || s_suppkey WHEN 2 THEN 'https://facebook.com/login https://tiktok.com/@shop' WHEN 3 THEN 'https://tiktok.com/@shop https://youtube.com/@acme?t=1' WHEN 4 THEN 'https://tiktok.com/@shop' WHEN 5 THEN 'https://instagram.com/ https://tiktok.com/@shop' ELSE 'https://linkedin.com/in/john-smith https://tiktok.com/@shop' END AS urls FROM supplier")
def n22_social_platforms(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{SOCIAL} AS u")
    several = F.array(F.lit("http://www.tiktok.com/@shop/"), F.col("u"), F.lit("https://tiktok.com/@shop"))
    return rows.select("s_suppkey", social.social_platform(F.col("u")).alias("platform"), F.array_join(social.normalize_social_urls(several), " ").alias("urls"))


@query(f"SELECT page_id, len({ANCHORS}) AS n, md5(array_to_string({ANCHORS}, '|')) AS hrefs FROM pages")
def x3_hrefs(spark, sf_dir):
    links = read(spark, sf_dir, "pages").select("page_id", extraction.page_hrefs(F.col("html")).alias("h"))
    return links.select("page_id", F.size("h").cast("long").alias("n"), F.md5(F.array_join("h", "|")).alias("hrefs"))


LOOSE = "CASE o_orderkey % 4 WHEN 0 THEN '  ' || o_orderpriority || chr(10) WHEN 1 THEN chr(9) || ' ' WHEN 2 THEN o_orderpriority || '   ' || chr(10) || ' x' END"


@query(f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 2 THEN o_orderpriority || '   ' || chr(10) || ' x' END AS optional, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 2 THEN o_orderpriority || ' x' END AS phone FROM orders")
def f10_optional_text(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{LOOSE} AS v")
    return rows.select("o_orderkey", text.optional_text(F.col("v")).alias("optional"), text.business_phone(F.col("v")).alias("phone"))


def _people_of(spark, sf_dir, html: str) -> DataFrame:
    pages = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS company_id", "0 AS page", "'' AS text", f"{html} AS html")
    return extraction.people(pages).select("company_id", "name", "title", "linkedin_url")


STAFF_ROWS = f"SELECT s_suppkey AS company_id, {STAFF} AS name, {STAFF_TITLE} AS title, 'https://www.linkedin.com/in/' || {STAFF_SLUG} AS linkedin_url FROM supplier"


@query(STAFF_ROWS)
def x13_json_ld_people(spark, sf_dir):
    """A person nested in an organisation, in a list."""
    return _people_of(spark, sf_dir, f"""'<script type="application/ld+json">[{{"@type": "Organization", "employee": [{{"@type": ["http://schema.org/Person"], "name": " ' || {STAFF} || ' ", "jobTitle": "' || {STAFF_TITLE} || '", "sameAs": ["https://x.com/a", "https://www.linkedin.com/in/' || {STAFF_SLUG} || '"]}}]}}]</script><script type="application/ld+json">not json</script>'""")


@query(STAFF_ROWS)
def x14_microdata_people(spark, sf_dir):
    return _people_of(spark, sf_dir, f"""'<div itemscope itemtype="https://schema.org/Person"><span itemprop="name">' || {STAFF} || '</span> <span itemprop="jobTitle" content="' || {STAFF_TITLE} || '">x</span><a itemprop="sameAs" href="https://www.linkedin.com/in/' || {STAFF_SLUG} || '">in</a></div>'""")


@query(STAFF_ROWS.replace(f"{STAFF_TITLE} AS title", "CAST(NULL AS VARCHAR) AS title"))
def x17_profile_link_people(spark, sf_dir):
    """A profile link with nothing around it: the name is that of its slug."""
    return _people_of(spark, sf_dir, f"""'<p><a href="https://www.linkedin.com/in/' || {STAFF_SLUG} || '/?trk=x">profile</a><a href="https://www.linkedin.com/company/shop">shop</a></p>'""")


@query(f"WITH s AS (SELECT s_suppkey AS company_id, {STAFF} AS name, {STAFF_TITLE} AS title FROM supplier) SELECT * FROM s UNION ALL SELECT company_id, title, title FROM s WHERE company_id % 2 = 0 AND title = 'Managing Director'")
def x10_text_people(spark, sf_dir):
    """Names beside titles in running text, on either side. A title of two capitalised words that aren't both roles passes the rules for names too, as `Managing Director` does where it stands first."""
    said = f"CASE s_suppkey % 2 WHEN 0 THEN {STAFF_TITLE} || ': ' || {STAFF} ELSE {STAFF} || ', ' || {STAFF_TITLE} END"
    pages = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS company_id", "0 AS page", f"{said} AS text", "CAST(NULL AS STRING) AS html")
    return extraction.people(pages).select("company_id", "name", "title")
