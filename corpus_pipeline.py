"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, documents that hold benchmark items go, the rest are
put in the order of the mix and dealt to shards.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents, but for the last,
which returns each document's shard and slot; slots of a shard follow the order of the mix, as the stage before stored it. No SQL expresses it: a learnt classifier, a sketch join and a schedule are in it.

Defined cases: a null text equals an empty one; of rows that repeat a doc_id and text one stays, rows that share a doc_id only are documents of their own; a document without a
doc_id is compared and scheduled like any other, and of equal texts the one with the smallest doc_id stays, before those without; texts without words are near-duplicates of equal
texts only and hold no benchmark item; a null source is a source of its own; without labels no document is toxic; an empty table gives an empty result; other columns pass through
all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import decontamination, mixing, sharding, simhash, toxicity
from leadloom.llm.common import materialize, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, stored=True)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; each stage's result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
