"""Audit of how filters interact: five filters in all 120 orders, from a histogram of failure masks.

Native expressions give each document a mask of four bits (A to D, functions of its text alone); a grouping by the text's digest supplies the smallest doc_id, which decides
the fifth (E). What is left of the documents are at most 32 cells for each part: how many of its documents have exactly this mask, and how many of those are labelled good or
toxic. Every number of every order follows from the cells: a step removes the cells that have its bit and none of the bits of the steps before.

    A  under 200 words                        D  holds one of # $ % & * |
    B  distinct words under half of all       E  identical to the text of a smaller doc_id, anywhere in the table
    C  over 3 % of the characters are A-Z

Copies of a text never meet as rows: they are counted by (digest, part, mask, labels) before and after the shuffle, so a group of copies that holds a third of all rows is no hot key.

Defined cases: null text equals an empty one, which has no words, fails A only (and E, if another has it); a null lang is the part ''; a row without a doc_id never fails E and
makes no other row fail it; rows that repeat a doc_id and text don't make each other fail E; a document of several label rows is good (or toxic) if any of them says so; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
_SAME = 1 << FILTERS.index("E")
_CELLS = range(1 << len(FILTERS))


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: which of A, B, C and D the text fails."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        F.size(words) < MIN_WORDS, F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_PERCENT, upper.cast("long") * 100 > F.length(text).cast("long") * UPPER_PERCENT,
        text.rlike("[#$%&*|]"),
    ]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def mask_histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail exactly the filters of the mask."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_mask(text).alias("mask"))
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("g"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    # rows without a doc_id are spread over keys that no label has
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none "), F.hex("digest")))
    marked = rows.withColumn("key", key).join(marks, "key", "left").withColumns({"g": F.coalesce("g", F.lit(0)), "t": F.coalesce("t", F.lit(0))})
    known = F.col("doc_id").isNotNull()
    cells = marked.groupBy("digest", "part", "mask", "g", "t").agg(
        F.sum("n").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unknown"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    cells = cells.withColumn("passes", F.col("unknown") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    both = F.array(F.struct("mask", F.col("passes").alias("n")), F.struct((F.col("mask") + _SAME).alias("mask"), (F.col("n") - F.col("passes")).alias("n")))
    split = cells.select("part", "g", "t", F.explode(both).alias("c")).select("part", "g", "t", "c.*")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("g")).alias("good"), F.sum(F.col("n") * F.col("t")).alias("toxic")).where("n > 0")


def _total(counts: str, chosen) -> Column:
    """The sum of counts[mask] over the masks for which chosen(mask) holds."""
    return F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(len(_CELLS) - 1)), chosen), F.lit(0).cast("long"), lambda s, m: s + F.get(counts, m))


def interactions(histogram: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step, for all orders, from mask_histogram."""
    dense = histogram.groupBy("part").agg(*[F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in _CELLS]).alias(c) for c in ("n", "good", "toxic")])
    steps = dense.select("*", F.explode(F.lit(ORDERS)).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = {f: F.instr("filter_order", f) for f in FILTERS}
    bits = lambda holds: sum((F.when(holds(place[f]), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"bit": bits(lambda p: p == F.col("step")), "before": bits(lambda p: p < F.col("step"))})
    own, earlier = lambda m: m.bitwiseAND(F.col("bit")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: own(m) & ~earlier(m)
    # of the orders, the filter comes first among the k that a document fails in one of k
    share = F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(len(_CELLS) - 1)), own), F.lit(0).cast("long"), lambda s, m: s + F.get("n", m) * F.get(F.lit([len(ORDERS) // max(1, k) for k in range(len(FILTERS) + 1)]), F.bit_count(m)))
    return steps.select(
        "part", "filter_order", "step", _total("n", lambda m: ~own(m) & ~earlier(m)).alias("kept"), _total("n", removed).alias("removed"), _total("n", lambda m: own(m) & earlier(m)).alias("redundant"),
        F.get("n", F.col("bit")).alias("unique_fails"), _total("good", removed).alias("good_lost"), _total("toxic", removed).alias("toxic_lost"), share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(mask_histogram(docs, labels))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
least AS (SELECT text, min(doc_id) AS least FROM w GROUP BY text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS g, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS t FROM labels GROUP BY doc_id),
m AS (SELECT w.doc_id, part, coalesce(g, 0) AS g, coalesce(t, 0) AS t,
  [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails
  FROM w JOIN least USING (text) LEFT JOIN l ON w.doc_id = l.doc_id),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || f FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) x(f) WHERE NOT contains(filter_order, f)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
c AS (SELECT part, filter_order, step, f, g, t, fails[ascii(f) - 64] AS own, len(list_filter(fails, lambda x: x)) AS k, len(list_filter([1, 2, 3, 4, 5], lambda i: fails[i] AND contains(earlier, chr(64 + CAST(i AS INTEGER))))) > 0 AS gone FROM m, s),
n AS (SELECT part, filter_order, step, f, count(*) FILTER (NOT own AND NOT gone) AS kept, count(*) FILTER (own AND NOT gone) AS removed, count(*) FILTER (own AND gone) AS redundant, count(*) FILTER (own AND k = 1) AS unique_fails,
  count(*) FILTER (own AND NOT gone AND g = 1) AS good_lost, count(*) FILTER (own AND NOT gone AND t = 1) AS toxic_lost FROM c GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM n
"""
