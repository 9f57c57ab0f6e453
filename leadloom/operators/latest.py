"""Latest rows, ranked rows and ordered string aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order. The rank is limited before the shuffle, so a hot key sends few rows."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def latest_by_time(df: DataFrame, key: str, time: str = "observed_at", ident: str = "id") -> DataFrame:
    """The latest row of each key as an aggregate (map-side combined): the largest (time, id). Null times come before all others."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(F.col(time), F.col(ident)))
    return df.groupBy(key).agg(best.alias("__best")).select(key, "__best.*")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    if k <= 0:
        return df.limit(0).withColumn(rank, F.lit(0))
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def limit_where(df: DataFrame, keys: list[str], flag: str, k: int, *order: Column) -> DataFrame:
    """All rows without the flag, and the first k with it, for each key."""
    rank = F.row_number().over(Window.partitionBy(*keys, flag).orderBy(*order))
    return df.withColumn("__rank", rank).where(~F.col(flag) | (F.col("__rank") <= k)).drop("__rank")


def ordered_distinct(df: DataFrame, keys: list[str], value: Column, *order: Column) -> DataFrame:
    """keys, value, at: each distinct value that isn't null or empty, and the least order that it has. Values meet before they are gathered as text."""
    return df.withColumn("__v", value).where("__v <> ''").groupBy(*keys, "__v").agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("__at"))


def joined_text() -> Column:
    """An aggregate over rows of ordered_distinct: the values in order, joined by '; '; empty without any."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__v"))), lambda r: r["__v"]), "; ")


def first_non_null(value: Column, *order: Column) -> Column:
    """An aggregate: the first value that isn't null, in order."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])))
