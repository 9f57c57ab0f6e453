"""Writers: snapshots, appended observations, lead files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def printable(df: DataFrame) -> DataFrame:
    """Every column as text: null is empty, times are ISO 8601 in UTC."""
    def one(name: str, kind: str) -> Column:
        c = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'") if kind.startswith("timestamp") else F.col(name).cast("string")
        return F.coalesce(c, F.lit("")).alias(name)

    return df.select(*[one(c, k) for c, k in df.dtypes])


def write_leads(df: DataFrame, path: str, order: list[str] | None = None, single: bool = False, mark: bool = False) -> None:
    """Lead rows as CSV with a header, range-partitioned by `order`; one file only if asked. With `mark` each file begins with a byte order mark."""
    rows = df if order is None else df.orderBy(*order)
    out = printable(rows)
    out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0]) if mark else out
    (out.coalesce(1) if single else out).write.option("header", True).option("emptyValue", "").option("escape", '"').mode("error").csv(path)


def write_stamped(df: DataFrame, folder: str, name: str, now: datetime) -> str:
    """A wide lead file as spreadsheets open it: marked, in a new path that tells the time. Returns the path."""
    path = f"{folder.rstrip('/')}/{name}_{now:%Y-%m-%d_%H-%M-%S}.csv"
    write_leads(df, path, single=True, mark=True)
    return path


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Append observations, by day of `partition` if it is given."""
    if partition:
        df = df.withColumn("day", F.to_date(partition))
        df.write.mode("append").partitionBy("day").parquet(path)
    else:
        df.write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """A new snapshot at a path of its own: a table that is being read is never overwritten."""
    df.write.mode("error").parquet(path)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose key isn't null and has no parent: what a foreign key would refuse."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
