"""Benchmark decontamination by size-partitioned MinHash containment search.

Short items hide in long documents, where the Jaccard similarity of whole shingle sets is near zero. So items are partitioned by size (powers of two),
and for each size c a document is cut into windows of 2c shingles that start every c: wherever an item of c shingles or fewer stands, one window
holds it and at most 2c others. Window minima for `PERMUTATIONS` hash functions come from minima of smaller blocks. A window
that shares one minimum with an item of its size makes the document a candidate for the item, and exact containment of the item's shingle set
in that of the whole document decides. A window that holds a piece of j of an item's shingles is missed with probability (1 - j / 3c) ** PERMUTATIONS at most.

Items of one shingle are looked up by its hash, without minima.

Items are the query set: they go to all documents in blocks of at most ITEM_BYTES of text, whatever their number. Documents
aren't shuffled.

Defined cases: null and empty texts have no shingles and match nothing; texts of fewer than five words are one shingle; repeated rows are
judged one by one; an empty table on either side gives no pairs; other columns pass through drop_contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WIDTH = 5
CONTAINMENT = 0.8
PERMUTATIONS = 64
ITEM_BYTES = 32 << 20
PAIRS = "doc_id long, item_id long, item_shingles int, shared int, containment double"


def _permutations():
    import numpy as np

    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def byte_shingles(text: bytes) -> set[bytes]:
    words = text.lower().split()
    if not words:
        return set()
    return {b" ".join(words)} if len(words) <= WIDTH else {b" ".join(x) for x in zip(*(words[i:] for i in range(WIDTH)))}


class Items:
    """A block of items, by size class, with the minima of each."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        import numpy as np
        import pyarrow as pa

        from . import words

        rows = [x for x in rows if x[1] and x[1].split()]
        self.ids, self.texts = [x[0] for x in rows], [x[1] for x in rows]
        self.shingles, self.classes, self.single = [], {}, {}
        self.single_filter = np.zeros(1 << 16, bool)
        mul, add = _permutations()
        for i, (_, text) in enumerate(rows):
            h = np.unique(hashed(pa.array([text], pa.binary()), words)[0])
            self.shingles.append(h)
            if len(h) == 1:  # looked up as it is
                self.single.setdefault(int(h[0]), []).append(i)
                self.single_filter[int(h[0]) >> 8 & 0xFFFF] = True
                continue
            size = max(8, 1 << (len(h) - 1).bit_length())
            least = (h[:, None] * mul[None, :] + add[None, :]).min(0)
            by = self.classes.setdefault(size, [{} for _ in range(PERMUTATIONS)])
            for p, v in enumerate(least.tolist()):
                by[p].setdefault(v, []).append(i)
        self.filters = {}
        for size, by in self.classes.items():
            seen = np.zeros((PERMUTATIONS, 1 << 16), bool)
            for p, values in enumerate(by):
                for v in values:
                    seen[p, v >> 8 & 0xFFFF] = True
            self.filters[size] = seen


def hashed(column, words):
    """(shingle hash, doc) of the texts of a binary column."""
    text, starts = words.raw(column)
    text = words.lowered(text)
    first, end, doc = words.find_words(text, starts)
    return words.shingle_hashes(words.word_hashes(text, first, end), doc, WIDTH)


def candidates(h, doc, items: Items) -> set[tuple[int, int]]:
    """(doc, item) pairs that share a minimum in some window of the item's size."""
    import numpy as np

    found: set[tuple[int, int]] = set()
    if len(h) and items.single:
        hit = np.flatnonzero(items.single_filter[(h >> np.uint64(8)).astype(np.int64) & 0xFFFF])
        for v, d in zip(h[hit].tolist(), doc[hit].tolist()):
            for i in items.single.get(v, ()):
                found.add((d, i))
    if not len(h) or not items.classes:
        return found
    mul, add = _permutations()
    sizes = sorted(items.classes)
    base = sizes[0]
    # blocks of `base` shingles within each document
    counts = np.bincount(doc)
    counts = counts[counts > 0]
    docs = doc[np.concatenate([[0], np.cumsum(counts)[:-1]])]
    blocks = -(-counts // base)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    nth = np.arange(first_block[-1]) - np.repeat(first_block[:-1], blocks)
    at = np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), blocks) + nth * base
    layout = [(docs, first_block, blocks)]
    for p in range(PERMUTATIONS):
        least = np.minimum.reduceat(h * mul[p] + add[p], at)
        size, k = base, 0
        while size <= sizes[-1]:
            owner, begin, many = layout[k]
            if size in items.classes:
                # a window is a block and the one after it in the same document
                window = least.copy()
                inner = np.ones(len(least), bool)
                inner[begin[1:] - 1] = False
                at_inner = np.flatnonzero(inner)
                window[at_inner] = np.minimum(least[at_inner], least[at_inner + 1])
                hit = np.flatnonzero(items.filters[size][p][(window >> np.uint64(8)).astype(np.int64) & 0xFFFF])
                if len(hit):
                    by = items.classes[size][p]
                    who = owner[np.searchsorted(begin, hit, "right") - 1]
                    for v, d in zip(window[hit].tolist(), who.tolist()):
                        for i in by.get(v, ()):
                            found.add((d, i))
            # pairs of blocks make the blocks of the next size
            pairs = -(-many // 2)
            next_begin = np.concatenate([[0], np.cumsum(pairs)])
            if len(layout) == k + 1:
                layout.append((owner, next_begin, pairs))
            within = np.arange(next_begin[-1]) - np.repeat(next_begin[:-1], pairs)
            least = np.minimum.reduceat(least, np.repeat(begin[:-1], pairs) + 2 * within)
            size, k = size * 2, k + 1
    return found


def contained(column, items: Items) -> list[tuple[int, int, int, int]]:
    """(row, item, item shingles, shared) for the texts of a binary column, exactly verified."""
    import numpy as np

    from . import words

    out = []
    for offset, part in words.slices(column):
        h, doc = hashed(part, words)
        by_doc: dict[int, list[int]] = {}
        for d, i in candidates(h, doc, items):
            by_doc.setdefault(d, []).append(i)
        for d, wanted in by_doc.items():
            own = h[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
            own = np.unique(own)
            wanted = [i for i in wanted if np.isin(items.shingles[i], own, assume_unique=True).sum() >= CONTAINMENT * len(items.shingles[i])]
            if wanted:
                whole = byte_shingles(part[d].as_py())
                for i in wanted:
                    mine = byte_shingles(items.texts[i])
                    shared = len(mine & whole)
                    if shared >= CONTAINMENT * len(mine):
                        out.append((offset + d, i, len(mine), shared))
    return out


def item_blocks(benchmark: DataFrame, most: int = ITEM_BYTES):
    """The items in blocks of about `most` bytes: lists of (item_id, text)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // most) or 1
    for i in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else items
        yield [(r[0], bytes(r[1])) for r in part.collect()]


def _pairs(shared):
    def run(batches):
        import pyarrow as pa

        from . import words

        items = Items(shared.value)
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_shingles", pa.int32()), ("shared", pa.int32()), ("containment", pa.float64())])
        for batch in batches:
            ids = batch.column("doc_id")
            found = [{"doc_id": ids[d].as_py(), "item_id": items.ids[i], "item_shingles": n, "shared": k, "containment": k / n} for d, i, n, k in contained(words.binary(batch.column("text")), items)]
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment: the items of which a document holds CONTAINMENT of the shingles or more."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = None
    for rows in item_blocks(benchmark):
        part = texts.mapInArrow(_pairs(spark.sparkContext.broadcast(rows)), PAIRS)
        out = part if out is None else out.unionByName(part)
    return out


def _clean(shared, name):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from . import words

        items = Items(shared.value)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for d, *_ in contained(words.binary(batch.column(name)), items):
                keep[d] = False
            yield batch.filter(pa.array(keep))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item."""
    for rows in item_blocks(benchmark):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(rows), "text"), docs.schema)
    return docs


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0b\\f\\r]+') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS bid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0b\\f\\r]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT rid, doc_id, unnest(CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d WHERE len(w) > 0),
bs AS (SELECT DISTINCT bid, item_id, unnest(CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM b WHERE len(w) > 0),
n AS (SELECT bid, count(*) AS n FROM bs GROUP BY bid),
m AS (SELECT rid, doc_id, bid, item_id, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n::INTEGER AS item_shingles, k::INTEGER AS shared, k / n AS containment FROM m JOIN n USING (bid) WHERE k >= 0.8 * n
"""
