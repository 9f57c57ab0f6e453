"""Sets of ids as bitmaps: rows of (bucket, bits), 4 KB for each 32,768 neighbouring ids. Exact, a bit for each id, and sets are united by bits without meeting ids again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap(ids: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """keys, bucket, bits of the ids (nulls are no members). Bits are set before the shuffle, so a task sends a row for each bucket that it meets."""
    known = ids.where(F.col(column).isNotNull())
    return known.groupBy(*(keys or []), F.bitmap_bucket_number(column).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bits"))


def united(bitmaps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The union of bitmaps for each of the keys (or of all)."""
    return bitmaps.groupBy(*(keys or []), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def sizes(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """How many ids the bitmaps of each key have."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("ids"))


def has(bits: Column, position: Column) -> Column:
    """Whether the bit at a position (from 0) is set."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), F.pmod(position, F.lit(8))).cast("int")) != 0, F.lit(False))


def members(rows: DataFrame, column: str, bitmaps: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose id is in the set (or isn't). What the rows are joined to is a row for each 32,768 ids, which Spark broadcasts while that is small, so the rows stay where they
    lie; no list of ids is made."""
    b = bitmaps.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    joined = rows.join(b, F.bitmap_bucket_number(column) == F.col("__bucket"), "inner" if inside else "left")
    found = has(F.col("__bits"), F.bitmap_bit_position(column))
    return joined.where(found if inside else ~found).select(*rows.columns)
