"""Readers of landed provider output: listings, technologies, performance reports, e-mail verdicts, pages."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LoadError
from ..functions import text, urls
from ..functions.policies import normalized_smtp_verdict
from ..operators.companies import deduplicate_listings

LISTING = "title string, website string, address string, complete_address string, phone string, category string, place_id string, cid string, data_id string, _corrupt_record string"
TECHNOLOGIES = "map<string,map<string,struct<version:string,confidence:int,categories:array<string>,groups:array<string>>>>"
VERDICT = "struct<status:string,valid:boolean,score:int,risk:string,smtp:struct<verdict:string,code:int,message:string,catchAll:boolean,latencyMs:int>,reasons:array<string>>"
# Parts of SMTP messages by which a probe was refused for where it came from, and not for the mailbox.
BLOCK_MARKERS = [
    "blocked using spamhaus", "spamhaus", "client blocked", "client host rejected", "client rejected", "client denied", "client blacklisted",
    "client is blacklisted", "ip blacklisted", "ip address blacklisted", "sender ip blocked", "connection blocked", "service unavailable; client",
]


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Raw listings, all strings. Columns are taken by name from the header, so extra ones and another order do no harm."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [f.split(" ")[0] for f in LISTING.split(", ")[:-1]]
    return raw.select(*[F.col(f"`{n}`") if n in raw.columns else F.lit(None).cast("string").alias(n) for n in names], F.col("_metadata.file_path").alias("file"))


def count_listings(spark: SparkSession, path: str) -> int:
    """Rows of the file; 0 if it can't be read."""
    from pyspark.errors import AnalysisException, PySparkException

    try:
        return read_listings(spark, path).count()
    except (AnalysisException, PySparkException):
        return 0


def read_final(spark: SparkSession, path: str, attempts: int = 3, pause: float = 0.5) -> DataFrame:
    """The listings of a finished search, its last one even without a line end. A file that can't be read yet is tried again; one that never can, or that has no rows, is an error."""
    from pyspark.errors import PySparkException

    from .landed import read_landed

    for attempt in range(1, attempts + 1):
        try:
            rows = read_landed(spark, path, final=True)
            if not rows.isEmpty():
                return rows
            raise LoadError(f"no listings in {path}")
        except PySparkException as e:
            if attempt == attempts:
                raise LoadError(f"{path} can't be read") from e
            time.sleep(pause)
    raise ValueError("attempts must be 1 or more")


def business_records(rows: DataFrame, city: str | None, country: str | None, source: str = "google_maps", keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of listings with a title; city and country are those of the query. Columns of `keep` stay beside them."""
    return rows.select(
        text.optional_text(F.col("title")).alias("name"), text.optional_text(F.col("website")).alias("website"), urls.extract_domain(F.col("website")).alias("domain"),
        text.optional_text(F.col("phone")).alias("phone"), F.lit(country).cast("string").alias("country"), F.lit(city).cast("string").alias("city"),
        F.coalesce(text.optional_text(F.col("address")), text.optional_text(F.col("complete_address"))).alias("address"), text.optional_text(F.col("category")).alias("category"),
        F.lit(source).alias("source_name"), F.coalesce(*[text.optional_text(F.col(c)) for c in ("place_id", "cid", "data_id")]).alias("external_id"), *keep,
    ).where("name is not null")


def load_results(rows: DataFrame, city: str | None, country: str | None, limit: int | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Listings once for each id, the first `limit` of them, as records."""
    once = deduplicate_listings(rows, ordinal)
    return business_records(once if limit is None else once.orderBy(ordinal).limit(limit), city, country)


def technologies(report: Column) -> Column:
    """An array of struct(url, name, version, confidence, categories, groups) of a detector's JSON; confidence is 100 where it isn't told."""
    pages = F.map_entries(F.from_json(report, TECHNOLOGIES))
    rows = lambda p: F.transform(F.map_entries(p["value"]), lambda t: F.struct(p["key"].alias("url"), t["key"].alias("name"), F.nullif(t["value"]["version"], F.lit("")).alias("version"), F.coalesce(t["value"]["confidence"], F.lit(100)).alias("confidence"), t["value"]["categories"].alias("categories"), t["value"]["groups"].alias("groups")))
    return F.flatten(F.transform(pages, rows))


def category_score(report: Column, category: str) -> Column:
    """A lab report's category as 0 to 100, rounded half to even."""
    score = F.coalesce(F.get_json_object(report, f"$.lighthouseResult.categories.{category}.score"), F.get_json_object(report, f"$.categories.{category}.score"))
    return F.bround(score.cast("double") * 100).cast("int")


def email_verdict(report: Column) -> Column:
    """struct of a verifier's JSON; a blocked probe says nothing about the mailbox, so it makes the status unknown."""
    v = F.from_json(report, VERDICT)
    verdict = normalized_smtp_verdict(v["smtp"]["verdict"], v["smtp"]["message"], BLOCK_MARKERS)
    blocked = F.coalesce(verdict == "blocked", F.lit(False))
    reasons = F.when(blocked, F.array_append(F.filter(v["reasons"], lambda r: r != "mailbox_not_found"), F.lit("smtp_blocked"))).otherwise(v["reasons"])
    return F.struct(F.when(blocked, "unknown").otherwise(v["status"]).alias("status"), (v["valid"] & ~blocked).alias("valid"), v["score"].alias("score"), v["risk"].alias("risk"), verdict.alias("smtp_verdict"), F.coalesce(v["smtp"]["catchAll"], F.lit(False)).alias("catch_all"), F.array_distinct(reasons).alias("reasons"))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, after_id: int | None = None, created_from=None, limit: int | None = None, key: str = "id", created: str = "created_at") -> DataFrame:
    """A table's rows after a cursor, in order of `key` where limited; predicates and columns reach the scan."""
    df = spark.read.parquet(path)
    df = df if columns is None else df.select(*columns)
    df = df if after_id is None else df.where(F.col(key) > after_id)
    df = df if created_from is None else df.where(F.col(created) >= F.lit(created_from))
    return df if limit is None else df.orderBy(key).limit(limit)
