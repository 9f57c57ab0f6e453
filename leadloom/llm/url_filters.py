"""URL filters: sort-merge range join between page hosts and prefix rules.

A host is turned into a canonical key, its labels reversed and each ended by a dot (`www.example.org` gives `org.example.www.`), so that a
rule's host and all its subdomains are one interval [key, key with the last dot raised to '/'). Such intervals nest or are disjoint. The rules give two
breakpoints a host: at its start the stack of rules active from there (its own and its ancestors'), at its end the ancestors' stack.
Breakpoints and pages are sorted together and a running last-breakpoint carries the current stack to each page; the page then takes the
longest stacked rule whose path starts its own. Sorting is by (first label, salt), so a domain that holds a third of all pages is spread.

Defined cases: null url or no `://` gives empty host and path; a page that no rule fits has a null rule and the default verdict; repeated
pages stay repeated; of equal rules block wins over allow; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (action, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _key(host: Column) -> Column:
    return F.concat(F.array_join(_labels(host), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def breakpoints(rules: DataFrame) -> DataFrame:
    """(label, key, stack): from `key` on, until the next breakpoint of that label, the rules of `stack` are active."""
    entry = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.col("action"), F.col("path"), F.concat("host", "path").alias("rule"))
    own = rules.where("host is not null and path is not null").groupBy("host").agg(F.collect_set(entry).alias("own"))
    labels = F.split("host", r"\.", -1)
    ancestors = own.select(F.col("host").alias("origin"), F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("host"))
    stacked = ancestors.join(own, "host").groupBy("origin").agg(
        F.flatten(F.collect_list("own")).alias("all"), F.flatten(F.collect_list(F.when(F.col("host") != F.col("origin"), F.col("own")))).alias("outer")
    )
    label, key = F.element_at(_labels(F.col("origin")), 1), _key(F.col("origin"))
    opens = stacked.select(label.alias("label"), key.alias("key"), F.col("all").alias("stack"))
    closes = stacked.select(label.alias("label"), F.regexp_replace(key, r"\.$", "/").alias("key"), F.col("outer").alias("stack"))
    return opens.unionByName(closes)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages (page_id, url)."""
    spark = pages.sparkSession
    salts = salts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    host = url_host(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), url_path(F.col("url")).alias("path"), F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt"))
    points = breakpoints(rules)
    stack_type = points.schema["stack"].dataType.simpleString()
    rows = rows.select("page_id", "host", "path", "salt", F.element_at(_labels(F.col("host")), 1).alias("label"), _key(F.col("host")).alias("key"), F.lit(None).cast(stack_type).alias("stack"), F.lit(1).alias("kind"))
    points = points.select(
        F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "label", "key", "stack", F.lit(0).alias("kind"),
    )
    sweep = Window.partitionBy("label", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.unionByName(points).withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    best = F.array_max(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])))
    return swept.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark))


def _sql() -> str:
    values = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    return f"""
    WITH r(action, rhost, rpath) AS (VALUES {values}),
    p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS rid FROM pages),
    m AS (SELECT rid, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
          FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
    SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (rid)
    """


SQL = _sql()
