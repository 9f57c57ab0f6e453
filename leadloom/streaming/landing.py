"""Streams of landed files: listings as they come, sessions of events. Own extensions; results equal those of the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.companies import listing_id
from ..sources.readers import LISTING, business_records


def listing_stream(spark: SparkSession, folder: str, city: str | None = None, country: str | None = None, late: str = "1 day") -> DataFrame:
    """Records of CSV files as they land. A listing id is taken once within `late` of its file's time; records without one all come through."""
    schema = LISTING.removesuffix(", _corrupt_record string")
    raw = spark.readStream.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    landed = raw.withColumn("landed_at", F.col("_metadata.file_modification_time")).withWatermark("landed_at", late)
    marked = landed.withColumn("listing_id", listing_id())
    once = marked.where("listing_id is not null").dropDuplicatesWithinWatermark(["listing_id"]).unionByName(marked.where("listing_id is null"))
    return business_records(once, city, country)


def event_windows(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts and sums by window and type, with a watermark where events stream."""
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    at = at.withWatermark("at", late) if events.isStreaming else at
    return at.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    at = at.withWatermark("at", late) if events.isStreaming else at
    return at.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
