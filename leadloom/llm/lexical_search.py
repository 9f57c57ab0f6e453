"""Ranked lexical search: hierarchical max trees over document ranges, searched best first with branch and bound.

    postings   each task cuts its documents into ranges and keeps, for the terms that some item has, how often each document of a range holds them; a range is one stored row
    figures    N, L and each term's df are sums over the stored ranges; they fix a term's weight and what tf is worth in a document of n terms
    trees      over a range, a node of level k covers FAN ** k neighbouring documents and holds, for each term, the most that the term is worth in any of them (a sparse max tree for
               each term, all of one shape); what a node can score at most for an item is the sum of weight * most over the item's terms
    search     nodes are opened in order of that bound, the highest first, down to single documents, whose bound is their score. A node goes unopened only if its bound is below
               the k-th best score so far: one of equal bound may hold a smaller doc_id. The k-th best carries on from range to range within a task
    ranks      each task's best k of an item are merged by item in two steps, so that no item's rows from all tasks meet at once

Texts are read once for each block of items (ITEM_BYTES of text), and never shuffled. Weights and scores are integers as the formula has them, so ties are exact. Within a task, terms
go by 64-bit names.

Defined cases: null text has no terms, and counts neither for N nor for any item; rows that repeat a doc_id are ranked each for itself, equal scores by ascending doc_id with missing
ids last; of items that repeat item_id and text one counts, items that share an item_id only share its ranks, as one list of each text's best; items without terms, without an item_id
or whose terms no document holds have no rows; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

K = 10
FAN = 16
#: A range ends with so many documents or postings.
RANGE_DOCS, RANGE_POSTINGS = 4096, 1 << 20
ITEM_BYTES = 4 << 20
_RANGE = "part int, ids array<long>, missing array<int>, lengths array<int>, terms array<int>, docs array<int>, tfs array<int>, df_terms array<int>, dfs array<int>"
_FOUND = "part int, item int, doc_id long, score long"


def find_terms(text, starts):
    """(first, end, doc) of each term: runs of ASCII letters, digits and all other characters beyond ASCII, within texts."""
    import numpy as np

    if not len(text):
        z = np.zeros(0, np.int64)
        return z, z, z
    kind = np.zeros(256, bool)
    for low, high in ((48, 58), (65, 91), (97, 123), (128, 256)):
        kind[low:high] = True
    inside = kind[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[starts] = True
    first = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    return first, end, np.searchsorted(starts, first, "right") - 1


def _names(column):
    """(name, doc) of each term of an Arrow binary column."""
    from . import words

    text, starts = words.raw(column)
    text = words.lowered(text)
    first, end, doc = find_terms(text, starts)
    return words.word_hashes(text, first, end), doc


class Items:
    """A block of items as term numbers: the block's terms are numbered by name."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        import numpy as np
        import pyarrow as pa

        self.ids = [i for i, _ in rows]
        name, item = _names(pa.array([t for _, t in rows], pa.binary()))
        self.names = np.unique(name)
        term = np.searchsorted(self.names, name)
        cut = np.searchsorted(item, np.arange(len(rows) + 1))
        # (distinct terms, repeats) of each item
        self.terms = [np.unique(term[a:b], return_counts=True) for a, b in zip(cut, cut[1:])]


def item_blocks(items: DataFrame, most: int = ITEM_BYTES):
    """The items in blocks of about `most` bytes."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // most) or 1
    for i in range(parts):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else rows
        yield Items(sorted((r[0], bytes(r[1])) for r in part.collect()))


def _ranges(shared, most_docs, most_postings):
    """Rows of _RANGE from batches of doc_id, text: the postings of the block's terms."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from . import words

        names, part = shared.value, TaskContext.get().partitionId()
        held: list = []
        docs = postings = 0

        def row():
            base = np.cumsum([0, *(len(h[0]) for h in held)])
            term = np.concatenate([h[3] for h in held])
            doc = np.concatenate([h[4] + b for h, b in zip(held, base)])
            df_terms, dfs = np.unique(term, return_counts=True)
            arrays = [*(np.concatenate([h[i] for h in held]) for i in range(3)), term, doc, np.concatenate([h[5] for h in held]), df_terms, dfs]
            kinds = [pa.int64()] + [pa.int32()] * 7
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, k)) for a, k in zip(arrays, kinds)]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *lists], ["part", "ids", "missing", "lengths", "terms", "docs", "tfs", "df_terms", "dfs"])

        for batch in batches:
            ids, missing = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for offset, piece in words.slices(words.binary(batch.column("text")), 1 << 21):
                name, doc = _names(piece)
                lengths = np.bincount(doc, minlength=len(piece))
                at = np.minimum(np.searchsorted(names, name), max(len(names) - 1, 0))
                hit = names[at] == name if len(names) else np.zeros(len(name), bool)
                pair, tf = np.unique(doc[hit] * max(len(names), 1) + at[hit], return_counts=True)
                doc, term = pair // max(len(names), 1), pair % max(len(names), 1)
                # cut where a range is full
                start = 0
                while start < len(piece):
                    ends = np.searchsorted(doc, np.arange(start, len(piece)), "right") - np.searchsorted(doc, start)
                    stop = start + max(1, int(min(np.searchsorted(ends, most_postings - postings, "right"), most_docs - docs)))
                    a, b = np.searchsorted(doc, [start, stop])
                    held.append((ids[offset + start : offset + stop], missing[offset + start : offset + stop], lengths[start:stop], term[a:b], doc[a:b] - start, tf[a:b]))
                    docs, postings, start = docs + len(held[-1][0]), postings + int(b - a), stop
                    if docs >= most_docs or postings >= most_postings:
                        yield row()
                        held, docs, postings = [], 0, 0
        if held:
            yield row()

    return run


class Tree:
    """The max trees of one range. levels[k] is (begin, term, node, most): entries of level k grouped by their parent node, and sorted by term within it; begin[p] is where
    parent p's entries start. The last level has one parent, the root."""

    def __init__(self, term, doc, worth, docs: int, fan: int):
        import numpy as np

        self.fan, self.levels = fan, []
        node, size = doc, docs
        while True:
            parent, parents = node // fan, -(-size // fan)
            order = np.lexsort((node, term, parent))
            term, node, worth, parent = term[order], node[order], worth[order], parent[order]
            self.levels.append((np.searchsorted(parent, np.arange(parents + 1)), term, node, worth))
            if parents <= 1:
                break
            first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (parent[1:] != parent[:-1]))) if len(term) else np.zeros(0, np.int64)
            worth = np.maximum.reduceat(worth, first) if len(first) else worth
            term, node, size = term[first], parent[first], parents

    def open(self, level: int, parent: int, terms, weights):
        """(children, bounds) of a node for the item's terms; children that hold none of them are left out."""
        import numpy as np

        begin, term, node, most = self.levels[level]
        a, b = begin[parent], begin[parent + 1]
        low, high = np.searchsorted(term[a:b], terms), np.searchsorted(term[a:b], terms, "right")
        n = high - low
        total = int(n.sum())
        if not total:
            return [], []
        at = np.repeat(a + low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(total)
        bounds = np.zeros(self.fan, np.int64)
        np.add.at(bounds, node[at] - parent * self.fan, np.repeat(weights, n) * most[at])
        children = np.flatnonzero(bounds)
        return (children + parent * self.fan).tolist(), bounds[children].tolist()


def best(tree: Tree, terms, weights, ids, k: int, top: list) -> list:
    """The k best (score, doc key) of `top` and the range, highest score and then least key first. ids: the key of each document."""
    import heapq

    queue = [(0, len(tree.levels) - 1, 0)]
    least = top[-1][0] if len(top) == k else 0  # no node below it can matter
    root = True
    while queue:
        bound, level, node = heapq.heappop(queue)
        if not root and -bound < least:
            break
        root = False
        for child, most in zip(*tree.open(level, node, terms, weights)):
            if most >= least:
                if level:
                    heapq.heappush(queue, (-most, level - 1, child))
                else:
                    top.append((most, ids[child]))
        if not level:
            top.sort(key=lambda x: (-x[0], x[1]))
            del top[k:]
            least = top[-1][0] if len(top) == k else 0
    return top


def _search(shared, k, fan):
    """Rows of _FOUND from stored ranges: each task's best k of each item."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        items, weights, count, length = shared.value
        tops: list[list] = [[] for _ in items]
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r].values.to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
                n, term, doc, tf = get("lengths"), get("terms"), get("docs"), get("tfs")
                m = 25 + (75 * n * count) // length
                tree = Tree(term, doc, (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]), len(n), fan)
                keys = list(zip(get("missing").tolist(), get("ids").tolist()))
                for i, (terms, repeats) in enumerate(items):
                    if len(terms):
                        tops[i] = best(tree, terms, weights[terms] * repeats, keys, k, tops[i])
        part = TaskContext.get().partitionId()
        found = [(part, i, None if x[0] else x[1], s) for i, top in enumerate(tops) for s, x in top]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["part", "item", "doc_id", "score"])

    return run


def weight(df, n: int):
    """floor(1000 ln((2N + 2) / (2df + 1))) in doubles."""
    import numpy as np

    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def search(docs: DataFrame, items: DataFrame, k: int = K, fan: int = FAN, range_docs: int = RANGE_DOCS, range_postings: int = RANGE_POSTINGS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    import numpy as np

    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = None
    for block in item_blocks(items, item_bytes):
        send = spark.sparkContext.broadcast
        ranges = materialize(texts.mapInArrow(_ranges(send(block.names), range_docs, range_postings), _RANGE), "postings")
        figures = ranges.select(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + F.when(x > 0, 1).otherwise(0)).alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("l"))
        count, length = figures.agg(F.sum("n"), F.sum("l")).first()
        if not count:
            continue
        # a df of each of the block's terms, as many as the block's bytes bound
        dfs = ranges.select(F.explode(F.arrays_zip("df_terms", "dfs")).alias("x")).groupBy("x.df_terms").agg(F.sum("x.dfs").alias("df")).toArrow()
        df = np.zeros(len(block.names), np.int64)
        df[dfs["df_terms"].to_numpy()] = dfs["df"].to_numpy()
        found = ranges.mapInArrow(_search(send((block.terms, weight(df, count), count, length)), k, fan), _FOUND)
        ids = F.broadcast(spark.createDataFrame([(i, x) for i, x in enumerate(block.ids)], "item int, item_id long"))
        found = found.join(ids, "item").select("item_id", "part", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = out.withColumn("__r", F.row_number().over(Window.partitionBy("item_id", F.pmod("part", F.lit(64))).orderBy(*order))).where(F.col("__r") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM b),
qt AS (SELECT item_id, term, count(*) AS r FROM q GROUP BY ALL),
f AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS wt FROM p, f GROUP BY term, n),
s AS (SELECT item_id, d.rid, d.doc_id, sum(r * wt * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.w) * n) // l))))::BIGINT AS score
  FROM qt JOIN p USING (term) JOIN t USING (term) JOIN d ON d.rid = p.rid, f GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""
