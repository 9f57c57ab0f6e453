"""Company deduplication, upsert and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..sources.store import materialized

FILLED = ("website", "domain", "phone", "country", "city", "address", "category")


def normalize_records(records: DataFrame) -> DataFrame:
    """Candidates from raw business records; other columns pass through."""
    website = urls.normalize_url(F.col("website"))
    return records.withColumns({
        "name": F.coalesce(text.clean_text(F.col("name")), F.col("name")), "normalized_name": text.company_name(F.col("name")), "website": website,
        "domain": urls.normalize_domain(F.coalesce(F.nullif("domain", F.lit("")), website)), "phone": text.business_phone(F.col("phone")),
        "country": text.country(F.col("country")), "city": text.clean_text(F.col("city")), "address": text.clean_text(F.col("address")), "category": text.clean_text(F.col("category")),
    })


def match_keys():
    """The keys of a candidate in order of priority: domain, phone, then name with location."""
    place = F.array_compact(F.array("city", "country", "address"))
    name = F.when(F.size(place) > 0, F.array_join(F.concat(F.array("normalized_name"), place), "|"))
    keys = [("domain", F.col("domain")), ("phone", F.col("phone")), ("name_location", name)]
    return F.filter(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(f).alias("field"), v.alias("value"))) for f, v in keys]), lambda x: x.isNotNull())


def listing_id():
    return F.coalesce(*[text.optional_text(F.col(c)) for c in ("place_id", "cid", "data_id")])


def deduplicate_listings(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The first row of each listing id; rows without one all stay, and don't meet in one task."""
    marked = rows.withColumn("external_id", listing_id())
    rank = F.row_number().over(Window.partitionBy("external_id", F.when(F.col("external_id").isNull(), F.col(ordinal))).orderBy(ordinal))
    return marked.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


#: What a company is found by: a domain, a phone, or a name with parts of a location (those that aren't null).
KEY = ("field", "value", "city", "country", "address")
PLACE = ("city", "country", "address")
CHUNKS = 64


def lookup_keys() -> Column:
    """The keys that a candidate looks for, in order of priority: array of struct(priority, *KEY)."""
    null = F.lit(None).cast("string")
    located = F.coalesce(*PLACE).isNotNull()
    one = lambda p, f, v, place: F.struct(F.lit(p).alias("priority"), F.lit(f).alias("field"), v.alias("value"), *[x.alias(n) for x, n in zip(place, PLACE)])
    keys = [
        F.when(F.col("domain").isNotNull(), one(1, "domain", F.col("domain"), [null] * 3)), F.when(F.col("phone").isNotNull(), one(2, "phone", F.col("phone"), [null] * 3)),
        F.when(located & F.col("normalized_name").isNotNull(), one(3, "name", F.col("normalized_name"), [F.col(n) for n in PLACE])),
    ]
    return F.array_compact(F.array(*keys))


def held_keys(value=F.col, since=lambda name: F.lit(0)) -> Column:
    """The keys under which a company is found: array of struct(since, *KEY). A name is found under every part of its location, alone and with the others; since(field) is when
    the company got a field."""
    null = F.lit(None).cast("string")
    out = []
    for f in ("domain", "phone"):
        out.append(F.when(value(f).isNotNull(), F.struct(since(f).alias("since"), F.lit(f).alias("field"), value(f).alias("value"), *[null.alias(n) for n in PLACE])))
    for mask in range(1, 1 << len(PLACE)):
        used = [n for i, n in enumerate(PLACE) if mask >> i & 1]
        all_there = value("normalized_name").isNotNull()
        for n in used:
            all_there &= value(n).isNotNull()
        last = F.greatest(since("normalized_name"), *[since(n) for n in used])
        out.append(F.when(all_there, F.struct(last.alias("since"), F.lit("name").alias("field"), value("normalized_name").alias("value"), *[(value(n) if n in used else null).alias(n) for n in PLACE])))
    return F.array_compact(F.array(*out))


def _least_before(held: DataFrame, asked: DataFrame, chunks: int, low: int, high: int) -> DataFrame:
    """asked (key, at, priority) with `found`: the least company among held (key, since, company) with since < at, or null. A running minimum over time in two levels: within
    (key, chunk of time), and over the chunks before, of which there is a row for each key that a chunk has. So no key is one task."""
    both = held.select("key", F.col("since").alias("at"), F.lit(1).alias("held"), "company", F.lit(None).cast("int").alias("priority")).unionByName(
        asked.select("key", "at", F.lit(0).alias("held"), F.lit(None).cast("long").alias("company"), "priority"))
    both = both.withColumn("chunk", F.width_bucket(F.greatest("at", F.lit(low)).cast("double"), F.lit(float(low)), F.lit(float(high) + 1), F.lit(chunks)))
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("key", "chunk").agg(F.min("company").alias("company")).select("key", "chunk", F.min("company").over(before).alias("earlier")).where("earlier is not null")
    # what was got at a time counts after it only: a row that asks comes first
    inside = Window.partitionBy("key", "chunk").orderBy("at", "held").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("within", F.min("company").over(inside)).where("held = 0")
    return seen.join(carried.hint("merge"), ["key", "chunk"], "left").select("key", "at", "priority", F.least("within", "earlier").alias("found"))


def fold_companies(candidates: DataFrame, ordinal: str = "ordinal", stored: DataFrame | None = None, chunks: int = CHUNKS) -> DataFrame:
    """Candidates folded in order into companies, as repeated upserts would: each takes the lowest company that its domain matches, or else its phone, or
    else its name with every part of its location that it has; it fills what that company lacks, or becomes a company. `stored` companies (with an ordinal below all
    candidates') are there from the start; they are never folded into each other. Ordinals are unique.

    What a candidate takes depends on candidates before it only. So the fold is the one assignment that gives itself: from any assignment follow the fields that each company has
    and since when, from these what each candidate finds at its turn, and that is the next assignment, until nothing changes. A company whose first row has itself joined another
    is found as that other, so a chain of wrong joins doesn't take a round for each of its links; in the assignment that gives itself there is none. Each round settles at least the
    first open candidate of every group that hangs together; usually all settle in a few. A round is joins and windows over keys, split by time: no group is gathered in one task,
    and, since tables of rows are small files and large hash tables, no side is broadcast.

    Returns company_ordinal (of the row that began it), the company's columns and the number of rows, the stored one included."""
    columns = ["name", "normalized_name", *FILLED]
    rows = candidates.select(F.col(ordinal).cast("long").alias("o"), *columns, F.lit(False).alias("fixed"))
    if stored is not None:
        rows = rows.unionByName(stored.select(F.col(ordinal).cast("long").alias("o"), *columns, F.lit(True).alias("fixed")))
    # only rows that share a value with another row can meet, and only those with a key look for a company or are found
    values = rows.where(F.size(lookup_keys()) > 0).select("o", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in ("domain", "phone", "normalized_name")])).alias("k")).where("k.v is not null")
    meeting = values.join(values.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").hint("merge"), "k", "left_semi").groupBy("o").agg(F.lit(True).alias("meets"))
    rows = materialized(rows.join(meeting.hint("merge"), "o", "left").withColumn("meets", F.coalesce("meets", F.lit(False))), "fold")
    low, high = rows.where("meets and not fixed").agg(F.min("o"), F.max("o")).first()
    first = lambda f: F.min(F.when(F.col(f).isNotNull(), F.struct("o", F.col(f).alias("v")))).alias(f)
    key = F.struct(*[F.col(f"k.{k}") for k in KEY]).alias("key")
    now, seen = rows.where("meets").withColumn("company", F.col("o")), None
    asked = rows.where("meets and not fixed").select(F.col("o").alias("at"), F.explode(lookup_keys()).alias("k")).select("at", "k.priority", key)
    while low is not None:
        has = now.groupBy("company").agg(*[first(f) for f in ("normalized_name", *FILLED)])
        moved = now.where("company <> o").select(F.col("o").alias("company"), F.col("company").alias("joined"))
        has = has.join(moved.hint("merge"), "company", "left").withColumn("company", F.coalesce("joined", "company"))
        held = has.select("company", F.explode(held_keys(lambda f: F.col(f"{f}.v"), lambda f: F.col(f"{f}.o"))).alias("k")).select("company", "k.since", key)
        best = _least_before(held, asked, chunks, low, high).where("found is not null").groupBy(F.col("at").alias("o")).agg(F.min(F.struct("priority", "found"))["found"].alias("found"))
        took = now.drop("company").join(best.hint("merge"), "o", "left").withColumn("company", F.coalesce("found", "o")).drop("found")
        told = Observation()
        now = materialized(took.observe(told, F.sum(F.xxhash64("o", "company").cast("decimal(20,0)")).alias("state")), "fold")
        if told.get["state"] == seen:
            break
        seen = told.get["state"]
    rows = now.unionByName(rows.where("not meets").withColumn("company", F.col("o")))
    out = rows.groupBy(F.col("company").alias("company_ordinal")).agg(F.min_by("name", "o").alias("name"), F.min_by("normalized_name", "o").alias("normalized_name"), *[first(f) for f in FILLED], F.count("*").alias("rows"))
    return out.select("company_ordinal", "name", "normalized_name", *[F.col(f"{f}.v").alias(f) for f in FILLED], "rows")


def upsert_snapshot(stored: DataFrame, incoming: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """A new snapshot: stored rows with what they lack filled from incoming ones of the same key, and the incoming rows that are new."""
    s, i = stored.alias("s"), incoming.alias("i")
    picked = [F.coalesce(f"s.{c}", f"i.{c}").alias(c) if c in fill or c == key else F.when(F.col(f"s.{key}").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"i.{c}")).alias(c) for c in stored.columns]
    return s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full").select(*picked)


def provenance(records: DataFrame) -> DataFrame:
    """The latest record of each (source, external id); records without an external id all stay."""
    from .latest import latest_per

    known = latest_per(records.where("external_id is not null"), ["source_id", "external_id"], F.col("collected_at").desc_nulls_last(), F.col("id").desc())
    return known.unionByName(records.where("external_id is null"))


def new_sources(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sources by name: those known, and the wanted ones that aren't."""
    return sources.unionByName(wanted.dropDuplicates(["name"]).join(sources.select("name"), "name", "left_anti").select(*sources.columns))
