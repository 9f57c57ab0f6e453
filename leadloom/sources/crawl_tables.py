"""Stored crawls and their links, bucketed by the crawl's id, so that pages are joined where they lie: neither html nor links are shuffled to find them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTENT = ["url", "status_code", "html", "text", "title", "meta_description", "collected_at"]


def write_crawls(crawls: DataFrame, links: DataFrame, name: str, path: str, buckets: int | None = None) -> None:
    """crawls (id, company_id, CONTENT) and links (website_crawl_id, url) as the tables name_crawls and name_links, in files below path. Both have the same buckets: as many as the session's shuffle partitions, unless told
    otherwise, for a task reads one of them."""
    buckets = buckets or int(crawls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for df, key, what in ((crawls, "id", "crawls"), (links.distinct(), "website_crawl_id", "links")):
        df.repartition(buckets, key).write.mode("overwrite").option("path", f"{path}/{what}").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{name}_{what}")


def last_crawls(spark: SparkSession, name: str, states: DataFrame) -> DataFrame:
    """company_id, crawl_id, CONTENT and links (sorted) of the last crawl that each state names (company_id, last_crawl_id). First the ids, which are a few bytes each and go to the
    buckets of the crawls; then their pages, from where they lie. States without a crawl, or with one that isn't stored, have no row."""
    wanted = states.where("last_crawl_id is not null").select("company_id", F.col("last_crawl_id").alias("id"))
    links = spark.table(f"{name}_links").groupBy(F.col("website_crawl_id").alias("id")).agg(F.sort_array(F.collect_list("url")).alias("links"))
    pages = spark.table(f"{name}_crawls").select("id", *CONTENT)
    found = wanted.join(pages, "id").join(links, "id", "left")
    return found.select("company_id", F.col("id").alias("crawl_id"), *CONTENT, F.coalesce("links", F.array().cast("array<string>")).alias("links"))
