"""Table-generating operators over crawled pages: links, contacts, people."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import emails, phones, social, text, urls
from .latest import top_k

PEOPLE = "array<struct<name:string,title:string,linkedin_url:string>>"


def _vector(function, kind: str):
    """A function of values over Arrow batches; made when it is used, for types are parsed by a running session."""
    made = to_arrow_type(T.DataType.fromDDL(kind))

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([function(*row) for row in zip(*(c.to_pylist() for c in columns))], made)

    return F.arrow_udf(run, kind)


def page_hrefs(html: Column) -> Column:
    def found(page):
        from ..functions.html import hrefs

        return hrefs(page)

    return _vector(found, "array<string>")(html)


def page_links(html: Column, url: Column) -> Column:
    def found(page, source):
        from ..functions.people import people_page_links

        return [{"url": a, "path": b, "anchor": c} for a, b, c in people_page_links(page, source)]

    return _vector(found, "array<struct<url:string,path:string,anchor:string>>")(html, url)


def page_people(plain: Column, html: Column) -> Column:
    def found(words, page):
        from ..functions.people import people_of_page

        return [{"name": a, "title": b, "linkedin_url": c} for a, b, c in people_of_page(words, page)]

    return _vector(found, PEOPLE)(plain, html)


def parsed(pages: DataFrame) -> DataFrame:
    """pages with the hrefs and people of each, parsed once; contacts and people below then take them from there."""
    def found(words, page):
        from ..functions.html import hrefs
        from ..functions.people import people_of_page

        return {"hrefs": hrefs(page), "people": [{"name": a, "title": b, "linkedin_url": c} for a, b, c in people_of_page(words, page)]}

    once = _vector(found, f"struct<hrefs:array<string>,people:{PEOPLE}>")(F.col("text"), F.col("html"))
    return pages.withColumn("__parsed", once).select(*pages.columns, "__parsed.hrefs", F.col("__parsed.people").alias("found_people"))


def titles_in(words: Column) -> Column:
    def found(t):
        from ..functions.people import find_titles

        return [{"start": a, "end": b, "title": c} for a, b, c in find_titles(t or "")]

    return _vector(found, "array<struct<start:int,end:int,title:string>>")(words)


def internal_links(links: Column, url: Column) -> Column:
    """The http links of the same host, each once, in order."""
    host = lambda c: F.regexp_replace(urls.hostname(c), r"^www\.", "")
    return F.array_distinct(F.filter(links, lambda x: x.rlike("(?i)^https?://") & (host(x) == host(url))))


def page_candidates(pages: DataFrame) -> DataFrame:
    """company_id, url, position of the absolute links of pages (company_id, links), each once for a company."""
    one = pages.select("company_id", F.posexplode("links").alias("position", "url")).where(F.col("url").rlike("(?i)^https?://"))
    return one.groupBy("company_id", "url").agg(F.min("position").alias("position"))


def business_pages(candidates: DataFrame, k: int = 5) -> DataFrame:
    """The k best business pages of each company: by score, then by shorter path, then by url."""
    scored = candidates.withColumn("score", urls.business_page_score(F.col("url"))).where("score > 0")
    size = F.length(urls.no_slash(urls.path(F.col("url"))))
    return top_k(scored.withColumn("path_length", size), ["company_id"], k, F.col("score").desc(), F.col("path_length"), F.col("url"))


def people_pages(pages: DataFrame, k: int = 10) -> DataFrame:
    """The k pages of each site (site, url, html) that most likely show people."""
    links = pages.where("html is not null and html <> ''").select("site", F.explode(page_links(F.col("html"), F.col("url"))).alias("l")).select("site", "l.*")
    scored = links.select("site", "url", urls.people_page_score(F.col("path"), F.col("anchor")).alias("score")).where("score > 0")
    best = scored.groupBy("site", "url").agg(F.max("score").alias("score"))
    return top_k(best, ["site"], k, F.col("score").desc(), F.col("url"))


def contacts(pages: DataFrame) -> DataFrame:
    """company_id, page, kind, value, ordinal of every contact on pages (company_id, page, url, text, html): e-mails, phones, then social pages.
    Only pages with a link are parsed, or none that already are."""
    own = pages if "hrefs" in pages.columns else pages.withColumn("hrefs", F.when(F.col("html").ilike("%href%"), page_hrefs(F.col("html"))).otherwise(F.array().cast("array<string>")))
    mail, tel = F.filter("hrefs", lambda h: h.ilike("mailto:%")), F.filter("hrefs", lambda h: h.ilike("tel:%"))
    found = F.filter(F.transform("hrefs", social.classify_social_url), lambda s: s.isNotNull())
    kinded = lambda xs, kind: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))
    rows = F.concat(kinded(emails.extract_emails(F.col("text"), mail), "email"), kinded(phones.extract_phones(F.col("text"), tel), "phone"), F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["url"].alias("value"))))
    return own.select("company_id", "page", "url", F.posexplode(rows).alias("ordinal", "c")).select("company_id", "page", F.col("url").alias("source_url"), "c.kind", "c.value", "ordinal")


def normalized_contact(kind: Column, value: Column, region: Column | str | None = None) -> Column:
    return F.when(kind == "email", emails.normalize_email(value)).when(kind == "phone", phones.e164(value, region)).otherwise(social.normalize_social_url(value))


def normalize_contacts(found: DataFrame, region: Column | str | None = None) -> DataFrame:
    """Contacts with normalized_value, the first of each (company, kind, value)."""
    rows = found.withColumn("normalized_value", normalized_contact(F.col("kind"), F.col("value"), region)).where("normalized_value is not null")
    rank = F.row_number().over(Window.partitionBy("company_id", "kind", "normalized_value").orderBy("page", "ordinal"))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def discarded_contacts(found: DataFrame, region: Column | str | None = None) -> DataFrame:
    lost = normalized_contact(F.col("kind"), F.col("value"), region).isNull()
    return found.groupBy("company_id").agg(F.count_if(lost).alias("discarded"), F.count("*").alias("found"))


def people(pages: DataFrame) -> DataFrame:
    """company_id, page, ordinal, name, title, linkedin_url of the people on pages (company_id, page, text, html)."""
    found = F.col("found_people") if "found_people" in pages.columns else page_people(F.col("text"), F.col("html"))
    return pages.select("company_id", "page", F.posexplode(found).alias("ordinal", "p")).select("company_id", "page", "ordinal", "p.*")


def model_context(pages: DataFrame, key: str, order: str, most: int = 12_000) -> DataFrame:
    """The pages of each key as one text, in order: each with its url, cut where `most` characters of pages are reached. Only pages that can still be in it are gathered."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    rows = pages.withColumn("bare", bare).where("bare <> ''")
    rows = rows.withColumn("chunk", F.concat(F.lit("PAGE URL: "), F.coalesce("url", F.lit("")), F.lit("\n"), F.col("bare"), F.lit("\n")))
    # a chunk has 13 characters or more, so few pages of a key can be in it; Spark drops the others before they are shuffled, and of each no more than fits is sent. A key's pages are
    # dealt to 64 groups first: what has too much before it in its own group has too much before it in all
    group = Window.partitionBy(key, "__group").orderBy(order)
    rows = rows.select(key, order, F.substring("chunk", 1, most).alias("chunk"), F.pmod(F.xxhash64(order), F.lit(64)).alias("__group"))
    rows = rows.withColumn("__rank", F.row_number().over(group)).where(F.col("__rank") <= most // 13 + 1)
    rows = rows.withColumn("__ahead", F.sum(F.length("chunk")).over(group.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("__ahead", F.lit(0)) < most)
    before = F.coalesce(F.sum(F.length("chunk")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = rows.withColumn("before", before).where(F.col("before") < most).withColumn("chunk", F.substring("chunk", F.lit(1), (F.lit(most) - F.col("before")).cast("int")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("chunk")))), lambda x: x["chunk"])
    return near.groupBy(key).agg(F.regexp_replace(F.array_join(parts, "\n\n"), r"(?U)^\s+|\s+$", "").alias("context"))


def crawl_links(crawls: DataFrame) -> DataFrame:
    """crawl_id, position, url of the links of each crawl (id, links), each once."""
    return crawls.select(F.col("id").alias("crawl_id"), F.posexplode(F.array_distinct("links")).alias("position", "url"))


def crawl_rows(pages: DataFrame) -> DataFrame:
    return pages.withColumn("content_hash", text.content_hash(F.col("text"), F.col("html")))
