"""Connected components by star contraction."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="leadloom-"))
    return df.checkpoint()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node with an edge (a, b): the least node that it reaches. Each round joins neighbours to the least of
    them, first the larger ones, then the smaller; minima are combined before the shuffle."""
    now = _checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    for _ in range(rounds):
        both = now.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        upper = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = upper.groupBy("u").agg(F.min("v").alias("m"))
        lower = upper.join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        now = _checkpointed(lower.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
