"""The engine's tables as projections of the driver's star schema. The expressions are SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST = ("Ann", "Jan", "MARIA", "peter", "Anne-Marie", "Dr. John", "Kim", "Lee Ann")
LAST = ("Smith", "van der Berg", "DE VRIES", "O'Connor", "Jansen", "Clinic", "Stone4", "Baker")
TITLES = ("CEO", "co founder", "Head of Marketing", "eigenaar", "Dentist", "", "managing director", "Designer")
KINDS = ("email", "phone", "linkedin_company", "linkedin_profile", "facebook", "instagram", "x", "youtube", "tiktok", "github")


def pick(values, index: str) -> str:
    """A CASE that picks a value by index."""
    quoted = ["'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE ({index}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


#: table: (source, {column: expression})
TABLES = {
    "companies": ("supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", {
        "id": "s_suppkey", "name": "s_name", "normalized_name": "lower(s_name)",
        "website": "CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN '' ELSE 'HTTPS://WWW.' || replace(s_name, '#', '-') || '.Example.COM:443/Home/?q=1' END",
        "domain": "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE lower(replace(s_name, '#', '-')) || '.example.com' END",
        "phone": "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '+1 212 555 ' || CAST(1000 + s_suppkey % 9000 AS STRING) END", "country": "n_name",
        "city": "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'City ' || CAST(s_suppkey % 11 AS STRING) END", "address": "CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'Street ' || CAST(s_suppkey % 17 AS STRING) END",
        "category": "r_name", "created_day": "s_suppkey % 60", "acctbal": "s_acctbal",
    }),
    "sources": ("region", {"id": "r_regionkey", "name": "r_name"}),
    "source_records": ("orders", {"id": "o_orderkey", "company_id": "o_custkey % 80", "source_id": "CAST(o_orderkey % 5 AS INT)", "external_id": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'ext' || CAST(o_orderkey % 400 AS STRING) END", "collected_at": "o_orderdate"}),
    "performance": ("events", {"id": "event_id", "company_id": "user_id", "performance_score": "CAST(floor(value) AS INT) % 101", "seo_score": "CAST(event_id % 101 AS INT)", "observed_at": "ts"}),
    "stages": ("events", {"company_id": "user_id", "stage": "event_type", "status": "CASE WHEN value > 20 THEN 'completed' ELSE 'failed' END", "attempts": "CAST(event_id % 3 AS INT)", "completed_at": "CASE WHEN value > 20 THEN ts END", "id": "event_id"}),
    "contacts": ("events", {"id": "event_id", "company_id": "user_id", "kind": pick(KINDS, "event_id"), "value": "'v' || CAST(event_id % 23 AS STRING)", "normalized_value": "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'n' || CAST(event_id % 13 AS STRING) END", "observed_at": "ts"}),
    "technologies": ("events", {"id": "event_id", "company_id": "user_id", "name": "event_type", "version": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 5 AS STRING) END", "observed_at": "ts"}),
    "people": ("customer", {"id": "c_custkey", "company_id": "c_custkey % 90", "name": f"{pick(FIRST, 'c_custkey')} || ' ' || {pick(LAST, 'c_custkey % 13')}", "title": pick(TITLES, "c_custkey % 11"), "linkedin_url": "CASE WHEN c_custkey % 4 = 0 THEN 'https://linkedin.com/in/p-' || CAST(c_custkey % 50 AS STRING) || '/?trk=x' END", "email": "CASE WHEN c_custkey % 5 = 0 THEN 'Info@Example' || CAST(c_custkey % 9 AS STRING) || '.com' END"}),
    "observations": ("orders", {"id": "o_orderkey", "person_id": "o_custkey", "company_id": "o_custkey % 90", "title": pick(TITLES, "o_orderkey"), "linkedin_url": "CASE WHEN o_orderkey % 6 = 0 THEN 'https://linkedin.com/in/q-' || CAST(o_orderkey % 70 AS STRING) END", "decision_maker_score": "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(floor(o_totalprice) AS INT) % 151 END", "role_group": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'primary' WHEN '2' THEN 'secondary' WHEN '3' THEN 'professional' WHEN '4' THEN 'other' ELSE 'unknown' END", "confidence": "CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END", "observed_at": "o_orderdate"}),
    "email_observations": ("events", {"id": "event_id", "person_id": "user_id", "normalized_email": "'u' || CAST(event_id % 700 AS STRING) || '@example.com'", "verification_result": "CASE event_id % 3 WHEN 0 THEN 'deliverable' WHEN 1 THEN 'risky' ELSE 'unknown' END", "confidence": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 97 AS DOUBLE) / 96 END"}),
    "messages": ("events", {"to_email": "'u' || CAST(event_id % 350 * 2 AS STRING) || '@example.com'", "id": "event_id"}),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = TABLES[name]
    if name == "companies":
        s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
        df = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    else:
        df = read(spark, sf_dir, source)
    return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def ctes(*names: str) -> str:
    """WITH clause of the named tables."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in TABLES[n][1].items())} FROM {TABLES[n][0]})" for n in names) + " "
