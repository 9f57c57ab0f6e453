"""Sharding: a hierarchical weighted hash tree, descended by weighted hash draws (region, rack, shard).

At each level every child draws ln(u) / weight, u in (0, 1] from a hash of (doc_id, child), and the largest draw wins. A child's draw
depends on its own name and weight only, so when weights change rows move only into subtrees that gained or out of those that lost. A
new shard comes as a region of its own: it takes rows only into itself. Weights are counts of equal shards here, so shares are even.

Law: `key`. doc_id and the tree alone decide. Slots are gapless within a shard without gathering a shard in one task.

Defined cases: null text has size 1 and crc32 0; a null doc_id is hashed as a key of its own; rows with equal doc_id share a shard, and
repeated rows get slots of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gapless_index, table

#: region -> rack -> (shard, weight); 8 equal shards.
TREE = {
    "r0": {"r0.k0": [(0, 1.0), (1, 1.0)], "r0.k1": [(2, 1.0), (3, 1.0)]},
    "r1": {"r1.k0": [(4, 1.0), (5, 1.0)], "r1.k1": [(6, 1.0), (7, 1.0)]},
}
#: The same with one more shard, in a region of its own.
GROWN = TREE | {"r2": {"r2.k0": [(8, 1.0)]}}


def _draw(key: list[Column], name: str, weight: float) -> Column:
    # 53 bits of the hash as u in (0, 1]
    u = (F.shiftrightunsigned(F.xxhash64(*key, F.lit(name)), 11).cast("double") + 1.0) / float(2**53)
    return F.log(u) / F.lit(weight)


def _choose(key: list[Column], children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the largest draw; of equal draws the first child's."""
    if len(children) == 1:
        return children[0][2]
    draws = F.array(*[F.struct(_draw(key, n, w).alias("d"), F.lit(-i).alias("i")) for i, (n, w, _) in enumerate(children)])
    best = -F.array_max(draws)["i"]
    out = None
    for i, (_, _, value) in enumerate(children[:-1]):
        out = F.when(best == i, value) if out is None else out.when(best == i, value)
    return out.otherwise(children[-1][2])


def shard_of(key: list[Column], tree: dict = TREE) -> Column:
    """Descend region, rack and shard levels; children of weight 0 or less take nothing."""
    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            leaves = [(f"shard{s}", w, F.lit(s)) for s, w in shards if w > 0]
            if leaves:
                inner.append((rack, float(sum(w for _, w, _ in leaves)), _choose(key, leaves)))
        if inner:
            regions.append((region, float(sum(w for _, w, _ in inner)), _choose(key, inner)))
    if not regions:
        raise ValueError("the tree has no shard of positive weight")
    return _choose(key, regions)


def stored_order(docs: DataFrame) -> DataFrame:
    """docs as read from Parquet files, with the place where each row is stored: __file (sorts as the parts were written) and __row."""
    name = F.col("_metadata.file_name")
    return docs.select("*", F.concat(F.lpad(F.regexp_extract(name, r"part-(\d+)", 1), 12, "0"), name).alias("__file"), F.col("_metadata.row_index").alias("__row"))


def assign_shards(docs: DataFrame, tree: dict = TREE, grown: dict = GROWN, buckets: int | None = None, stored: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row. With `stored`, docs are read from files and slots follow the
    order in which the rows are stored."""
    text, key = F.coalesce("text", F.lit("")), [F.col("doc_id")]
    place = ["__file", "__row"] if stored else []
    rows = (stored_order(docs) if stored else docs).select(
        *place, "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, tree).cast("int").alias("shard"), shard_of(key, grown).cast("int").alias("grown_shard"),
    )
    if stored:
        # rows of earlier files, then the rank within the file
        counts = rows.groupBy("shard", "__file").agg(F.count("*").alias("__n"))
        before = Window.partitionBy("shard").orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("shard", "__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
        rank = F.row_number().over(Window.partitionBy("shard", "__file").orderBy("__row"))
        slots = rows.withColumn("__r", rank).join(offsets, ["shard", "__file"]).withColumn("slot", F.col("__off") + F.col("__r") - 1)
    else:
        slots = gapless_index(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot", buckets, bounded_groups=True)
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
