"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local runs)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="leadloom-")
        sc.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/leadloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage is cut, a lost executor costs nothing, and the next plan knows the true size."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Jobs that run inside move rows to Python in batches of `rows` at most, so that buffers outside the heap stay small where rows are wide. A session that sets
    spark.sql.execution.arrow.maxRecordsPerBatch keeps its own value."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.unset(name)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def gapless_index(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int | None = None, bounded_groups: bool = False) -> DataFrame:
    """Number the rows of each group from 0 without gaps and without gathering a group in one task.

    Rows are dealt to `buckets` hash buckets of `order` (1024, or twice the session's shuffle partitions where that is more, so that no bucket outgrows a task); bucket counts give each bucket its first number, and rows are ranked within
    (group, bucket) only. Equal rows are interchangeable. `group` columns must not be null. With bounded_groups the number of groups is
    a parameter of the caller, so that the table of counts has a fixed size and is summed in one task.
    """
    buckets = buckets or max(1024, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = d.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    if bounded_groups:
        counts = counts.coalesce(1)
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    rank = F.row_number().over(Window.partitionBy(*group, "__b").orderBy(*order))
    return d.withColumn("__r", rank).join(offsets, [*group, "__b"]).withColumn(out, F.col("__off") + F.col("__r") - 1).drop("__b", "__off", "__r")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for each node with an edge.

    Alternating large-star and small-star rounds; each round's edges are checkpointed in the shared folder. Minima are combined before
    they are shuffled and hubs are split by adaptive skew joins, so no neighbourhood is gathered in one task. Null ends are ignored.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    seen = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("e")).select("e.*").distinct()
        pairs = small.checkpoint()
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def by_row(function, columns: list[str]):
    """For mapInArrow: call function(row values) -> list of output rows (dicts), batch by batch, in slices of bounded size."""

    def run(batches, schema):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = [y for x in zip(*(part.column(c).to_pylist() for c in columns)) for y in function(*x)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run
