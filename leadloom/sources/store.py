"""Tables that are updated in part. Rows lie in hash buckets of their key; an update reads the buckets that its rows fall in, and rewrites those alone.

An update first stores its merged buckets as a version of their own, named by its run, and then puts them in place of the live ones with Spark's dynamic partition overwrite. What
it reads is never what it overwrites, so a run that was lost half-way is repeated from its stored version and gives the same table, even if its merge isn't idempotent (a counter
of attempts, say); a run that was applied is applied once. The number of buckets is fixed with the table: a bucket is the unit that an update rewrites. Updates of one table come
one after the other; until an update has ended readers may see some of its buckets only.

    path/live/bucket=7/...      the table
    path/runs/<run>/bucket=7/   the buckets that the run changed, as it left them
    path/plans/<run>            rows that a run of several tables goes by
    path/log                    (run, step): planned, stored, applied
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "bucket"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; on local[...] a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="leadloom-")
    return f"{base.rstrip('/')}/leadloom/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs nothing of what came before."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """A table of unique keys. A null in a key is a value like any other."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _stored(self, folder: str) -> DataFrame:
        whole = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        try:
            return self.spark.read.schema(whole).parquet(f"{self.path}/{folder}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], whole)

    def read(self) -> DataFrame:
        return self._stored("live").drop(BUCKET)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that rows with the key's columns fall in: at most as many as there are."""
        return sorted(r[0] for r in keys.select(self.bucket().alias(BUCKET)).distinct().collect())

    def among(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is one of `keys`: only their buckets are scanned, and the keys are a semi-join."""
        wanted = keys.select(*self.key).distinct().withColumn(BUCKET, self.bucket())
        own = self._stored("live").where(F.col(BUCKET).isin(self.touched(keys))).alias("own")
        same = F.col(f"own.{BUCKET}") == F.col(f"wanted.{BUCKET}")
        for k in self.key:
            same &= F.col(f"own.{k}").eqNullSafe(F.col(f"wanted.{k}"))
        return own.join(wanted.alias("wanted"), same, "left_semi").drop(BUCKET)

    def _steps(self, run: str) -> set[str]:
        try:
            return {r[0] for r in self.spark.read.schema("run string, step string").parquet(f"{self.path}/log").where(F.col("run") == run).select("step").distinct().collect()}
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return set()

    def _note(self, run: str, step: str) -> None:
        self.spark.createDataFrame([(run, step)], "run string, step string").coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def planned(self, run: str, make: Callable[[], DataFrame]) -> DataFrame:
        """make()'s rows, stored for the run: one that is repeated goes on with the same rows, whatever it has changed already."""
        path = f"{self.path}/plans/{run}"
        if "planned" not in self._steps(run):
            make().write.mode("overwrite").parquet(path)
            self._note(run, "planned")
        return self.spark.read.parquet(path)

    def all_planned(self, ending: str) -> DataFrame:
        """The planned rows of all runs whose name ends so."""
        runs = self.spark.read.schema("run string, step string").parquet(f"{self.path}/log").where(F.col("step") == "planned").where(F.col("run").endswith(ending)).select("run").distinct()
        return self.spark.read.parquet(*[f"{self.path}/plans/{r[0]}" for r in runs.collect()])

    def update(self, run: str, deltas: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Put merge(current, deltas) in place of the buckets that the deltas' keys fall in. `current` are those buckets' rows; merge keeps every one of them (changed or not)
        and adds new ones. `run` names the update: repeated, it changes nothing."""
        done = self._steps(run)
        if "applied" in done:
            return
        if "stored" not in done:
            current = self._stored("live").where(F.col(BUCKET).isin(self.touched(deltas))).drop(BUCKET)
            rows = merge(current, deltas).select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn(BUCKET, self.bucket())
            rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/runs/{run}")
            self._note(run, "stored")
        merged = self._stored(f"runs/{run}")
        merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/live")
        self._note(run, "applied")


def replaced(key: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge: the deltas in place of the rows of their keys, which aren't null."""
    return lambda current, deltas: current.join(deltas.select(*key), key, "left_anti").select(*current.columns).unionByName(deltas.select(*current.columns))


def least(key: list[str], value: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge: the least value of each key."""
    return lambda current, deltas: current.unionByName(deltas.select(*current.columns)).groupBy(*key).agg(F.min(value).alias(value))
