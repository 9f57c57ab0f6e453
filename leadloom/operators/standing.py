"""Latest rows that stand: what the latest row of each key is, kept as a table into which each batch of observations is merged.

A batch is reduced to one row for each of its keys before it meets the table, and only the buckets of its keys are read and written. Which row is latest is a total order (time, then
id, then all other columns), so batches may come in any order, late or twice, and cut in any way: the table is always what a query over the whole history gives. Rows without a time
come before all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import Store


def latest_store(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], buckets: int = 64) -> Store:
    """An empty store of rows like the given ones, one for each of the keys."""
    return Store(spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]), keys, buckets)


def latest_row(rows: DataFrame, keys: list[str], time: str, ident: str) -> DataFrame:
    """The latest row of each of the keys, as an aggregate that is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, time, ident)]
    best = F.max(F.struct(time, ident, *rest)).alias("__best")
    return rows.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in rows.columns])


def merge_latest(store: Store, run: str, rows: DataFrame, time: str = "observed_at", ident: str = "id") -> None:
    """A batch of observations into the standing latest rows."""
    known = rows.where(" and ".join(f"{k} is not null" for k in store.key))
    store.update(run, latest_row(known, store.key, time, ident), lambda current, deltas: latest_row(current.unionByName(deltas.select(*current.columns)), store.key, time, ident))


def merge_largest(store: Store, run: str, rows: DataFrame, value: str) -> None:
    """A batch into the standing largest value of each key (a latest completion, say)."""
    def largest(df: DataFrame) -> DataFrame:
        return df.groupBy(*store.key).agg(F.max(value).alias(value))

    store.update(run, largest(rows), lambda current, deltas: largest(current.unionByName(deltas.select(*current.columns))))
