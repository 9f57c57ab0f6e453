"""SimHash near-duplicates by a binary trie self-join.

Fingerprints that differ in at most 2 of 64 bits agree in two of four blocks of them. So each distinct fingerprint goes, once for each two blocks, to the
trie node that their bits name; below that node the trie is joined with itself: pairs of nodes are descended together, differing bits add
up, and a pair is pruned when they exceed the budget. A node with more than LEAF fingerprints isn't gathered but descended in the same way: its
32 open bits are four blocks again, then 16, and with 8 open bits a node can't hold more than 256. Links are spanning edges, not all pairs,
and components come from star contraction.

`near_duplicates` finds documents whose sets of five-word shingles have Jaccard similarity J of 0.8 or more. Fingerprints by majority differ in
too many bits there, so each text has BANDS keys, each of BAND_ROWS minima of hashed shingles, and a sketch of one bit of each minimum. A pair meets in a key
but for a probability of (1 - J ** BAND_ROWS) ** BANDS (1.3e-7 at 0.8), wherever the edits are.
1. In each key every text is compared with one, that which meets the most others (most often what the rest were copied from). That is linear, and makes
   a large group of copies one component.
2. Where a key still has several components, the texts outside the largest one meet all others in units of bounded size: the tries of both
   sides' sketches are descended together within a Hamming budget, in the first key only that a pair shares. Texts that still have a partner send their shingle
   sets to the unit, where all overlaps are counted exactly. Only spanning links leave it, so no list of pairs is made, whatever a group's size.
All links are verified on whole shingle sets at `similarity`.

Defined cases: a null text equals an empty one, with fingerprint 0; fewer words than a shingle give the whole sequence; equal texts share
fingerprint and component; a null doc_id is never the smallest of a group that has another, but its text is compared like any other; texts without words
are near-duplicates of equal texts only; an empty table gives an empty result; other columns are not read (deduplicate passes them through).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_row, connected_components, materialize, small_batches, table

BUDGET = 2
#: A trie node with more fingerprints is descended further.
LEAF = 1024


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text's shingles, repeats included."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_digest, b" ".join
    if len(words) <= width:
        hashes = [digest(join(words), 42)]
    else:
        hashes = [digest(join(x), 42) for x in zip(*(words[i:] for i in range(width)))]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(np.frombuffer(b"".join(hashes[i : i + (1 << 16)]), np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(width: int):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
        yield from by_row(lambda i, t: [{"doc_id": i, "fp": signed(fingerprint(t, width))}], ["doc_id", "text"])(batches, schema)

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints(width), "doc_id long, fp long")


def trie_pairs(values: list[int], budget: int):
    """Index pairs (i < j) of sorted unsigned values that differ in at most `budget` bits, by descending node pairs of their trie."""
    from bisect import bisect_left

    n = len(values)
    if n < 2:
        return
    # a node: the slice [lo, hi) of values that agree in all bits above `bit`
    todo = [(0, n, 0, n, (values[0] ^ values[-1]).bit_length() - 1, 0)]
    while todo:
        lo, hi, lo2, hi2, bit, diff = todo.pop()
        if hi - lo == 1 and hi2 - lo2 == 1:
            if lo != lo2 and diff + ((values[lo] ^ values[lo2]) & ((1 << (bit + 1)) - 1)).bit_count() <= budget:
                yield min(lo, lo2), max(lo, lo2)
            continue
        if bit < 0:
            yield from ((i, j) for i in range(lo, hi) for j in range(lo2, hi2) if i < j or lo != lo2 and i != j)
            continue
        low, step = values[lo] >> (bit + 1) << (bit + 1), 1 << bit
        mid = bisect_left(values, low | step, lo, hi)
        if (lo, hi) == (lo2, hi2):
            if mid - lo > 1:
                todo.append((lo, mid, lo, mid, bit - 1, diff))
            if hi - mid > 1:
                todo.append((mid, hi, mid, hi, bit - 1, diff))
            if lo < mid < hi and diff < budget:
                todo.append((lo, mid, mid, hi, bit - 1, diff + 1))
            continue
        low2 = values[lo2] >> (bit + 1) << (bit + 1)
        mid2 = bisect_left(values, low2 | step, lo2, hi2)
        for a, b, c, d, more in ((lo, mid, lo2, mid2, 0), (mid, hi, mid2, hi2, 0), (lo, mid, mid2, hi2, 1), (mid, hi, lo2, mid2, 1)):
            if a < b and c < d and diff + more <= budget:
                todo.append((a, b, c, d, bit - 1, diff + more))


def _children(fp: str, bits: str, budget: int, blocks: int = 4) -> Column:
    """An array of (open, key) of a fingerprint: for each set of blocks of its open bits (an array of bit positions) that stay intact within the budget,
    the bits still open and the value of all others."""
    width = F.size(bits) / blocks
    cut = [F.slice(bits, (width * i + 1).cast("int"), width.cast("int")) for i in range(blocks)]
    out = []
    for lost in combinations(range(blocks), budget):
        left = F.concat(*(cut[b] for b in lost))
        mask = F.aggregate(left, F.lit(-1).cast("long"), lambda m, i: m.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
        out.append(F.struct(left.alias("open"), F.col(fp).bitwiseAND(mask).alias("key")))
    return F.array(*out)


def _groups(batches, by, columns, function, schema):
    """Call function(key, rows) for each run of rows that are equal in the columns `by`; rows come sorted, and runs may cross batches."""
    import pyarrow as pa

    out, last, rows = [], None, []
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            for key, x in zip(zip(*(part.column(c).to_pylist() for c in by)), zip(*(part.column(c).to_pylist() for c in columns))):
                if key != last:
                    if rows:
                        out += function(last, rows)
                    last, rows = key, []
                rows.append(x)
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
    if rows:
        out += function(last, rows)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def spanning(n: int, pairs) -> list[tuple[int, int]]:
    """Edges (root, member) that connect what the pairs connect."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(find(i), i) for i in range(n) if find(i) != i]


def _link(budget):
    def one(_, rows):
        values = sorted(x[0] & 0xFFFFFFFFFFFFFFFF for x in rows)
        return [{"a": signed(values[i]), "b": signed(values[j])} for i, j in spanning(len(values), trie_pairs(values, budget))]

    def run(batches):
        import pyarrow as pa

        yield from _groups(batches, ["open", "key"], ["fp"], one, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def link_fingerprints(distinct: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """Spanning edges (a, b) among distinct fingerprints (fp) that differ in at most `budget` (1 or 2) bits."""
    if budget not in (1, 2):
        raise ValueError("four blocks of bits are exact and narrow enough for a budget of 1 or 2")
    links, nodes = None, distinct.select("fp", F.array(*(F.lit(i) for i in range(64))).alias("open"))
    for level in range(3):  # 64 open bits become 32, 16 and 8 for a budget of 2
        nodes = nodes.select("fp", F.inline(_children("fp", "open", budget))).withColumn("open", F.array_join("open", ","))
        counts = nodes.groupBy("open", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = materialize(nodes.join(counts, ["open", "key"]), "trie")
        small = shared.where(F.col("n") <= leaf) if level < 2 else shared
        pairs = small.repartition("open", "key").sortWithinPartitions("open", "key", "fp").mapInArrow(_link(budget), "a long, b long")
        links = pairs if links is None else links.unionByName(pairs)
        nodes = shared.where(F.col("n") > leaf).select("fp", F.split("open", ",").cast("array<int>").alias("open"))
        if level == 2 or nodes.isEmpty():
            break
    return links


def simhash_components(docs: DataFrame, width: int = 3, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    marked = materialize(fingerprints(docs, width), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    nodes = connected_components(link_fingerprints(distinct.select("fp"), budget))
    joined = distinct.join(nodes, distinct["fp"] == nodes["node"])
    low = joined.groupBy("component").agg(F.min("low").alias("component_low"))
    joined = joined.select("fp", "component").join(low, "component").select("fp", "component_low")
    ids = materialize(distinct.join(joined, "fp", "left").select("fp", F.coalesce("component_low", "low").alias("component_id")), "ids")
    return marked.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


# Near-duplicate documents -------------------------------------------------------------------------------------------

#: Keys of a text's shingle set, and minima in each key.
BANDS = 40
BAND_ROWS = 5
#: Of BANDS * BAND_ROWS bits, one of each minimum, a pair at J = 0.8 differs in 20 on average (deviation 4.24); in more than 44 with probability 1e-7.
FAR = 44
SIMILARITY = 0.8
SHINGLE = 5
#: Texts, and shingles of them, that meet as many others in one unit.
UNIT = 512
UNIT_SHINGLES = 500_000


def _hashes():
    import numpy as np

    rng = np.random.default_rng(11)
    n = BANDS * BAND_ROWS
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def bands_and_bits(shingles: bytes, hashes=None):
    """The band keys of a set of shingles (64-bit numbers), and one bit of each minimum, packed and padded to 256 bits."""
    import numpy as np

    mul, add = hashes or _hashes()
    h = np.frombuffer(shingles, np.uint64)
    least = np.full(len(mul), np.iinfo(np.uint64).max)
    for i in range(0, len(h), 1 << 12):
        least = np.minimum(least, (h[i : i + (1 << 12), None] * mul + add).min(0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for x in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    bits = np.packbits(least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63) == 1)
    return key, np.pad(bits, (0, 32 - len(bits))).tobytes()


def shingle_set(text: bytes | None, width: int = SHINGLE) -> bytes:
    """Sorted distinct 64-bit hashes of a text's shingles, as bytes."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    join, h = b" ".join, xxhash.xxh64_digest
    shingles = {join(words)} if len(words) <= width else {join(x) for x in zip(*(words[i:] for i in range(width)))}
    return np.sort(np.frombuffer(b"".join(map(h, shingles)), np.uint64)).tobytes()


def jaccard(a: bytes, b: bytes) -> float:
    import numpy as np

    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _print_rows(batches):
    import numpy as np
    import pyarrow as pa

    hashes = _hashes()

    def one(i, d, t):
        shingles = shingle_set(t) if (t or b"").split() else b""
        if not shingles:
            return [{"doc_id": i, "digest": d, "size": 0, "bits": b"", "marks": b"", "bands": []}]
        bands, bits = bands_and_bits(shingles, hashes)
        return [{"doc_id": i, "digest": d, "size": len(shingles) // 8, "bits": bits, "marks": bands.astype(np.uint32).tobytes(), "bands": bands.view(np.int64).tolist()}]

    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("size", pa.int32()), ("bits", pa.binary()), ("marks", pa.binary()), ("bands", pa.list_(pa.int64()))])
    yield from by_row(one, ["doc_id", "digest", "text"])(batches, schema)


def _shingle_rows(batches):
    import pyarrow as pa

    yield from by_row(lambda d, t: [{"digest": d, "shingles": shingle_set(t)}], ["digest", "text"])(batches, pa.schema([("digest", pa.binary()), ("shingles", pa.binary())]))


def _verify(similarity):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
        keep = lambda a, b, x, y: [{"a": a, "b": b}] if jaccard(x, y) >= similarity else []
        yield from by_row(keep, ["a", "b", "x", "y"])(batches, schema)

    return run


def _levels(sketches):
    """A trie of the sketches (rows of 16-bit digits): their sorted order, and for each level the digits of its nodes and where the children of each begin."""
    import numpy as np

    order = np.lexsort(sketches.T[::-1])
    rows = sketches[order]
    new, at, levels = np.zeros(len(rows), bool), np.array([0]), []
    new[0] = True
    for d in range(rows.shape[1]):
        new[1:] |= rows[1:, d] != rows[:-1, d]
        first = np.flatnonzero(new)
        levels.append((rows[first, d], np.append(np.searchsorted(first, at), len(first))))
        at = first
    return order, [*levels, (None, np.append(at, len(rows)))]


def trie_join(left, right, budget: int):
    """Index pairs (i, j) of rows of left and right, sketches as arrays of 16-bit digits, that differ in at most `budget` bits.

    Both tries are descended together, sixteen bits at a time: a pair of nodes has the pairs of their children, differing bits add up,
    and a pair that exceeds the budget is pruned with all below it.
    """
    import numpy as np

    (order, ours), (order2, theirs) = _levels(left), _levels(right)
    p = q = np.zeros(1, np.int64)
    diff = np.zeros(1, np.int64)
    for (digit, begin), (digit2, begin2) in zip(ours, theirs):
        wide = begin2[q + 1] - begin2[q]
        n = (begin[p + 1] - begin[p]) * wide
        of = np.repeat(np.arange(len(p)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        p, q, diff = begin[p[of]] + k // wide[of], begin2[q[of]] + k % wide[of], diff[of]
        if digit is not None:
            diff = diff + np.bitwise_count(digit[p] ^ digit2[q])
            keep = diff <= budget
            p, q, diff = p[keep], q[keep], diff[keep]
    return order[p], order2[q]


def _possible(similarity):
    """Of each unit, the rows that may have a partner in it: by size, by sketch, and in the first key only that a pair shares."""

    def one(key, rows):
        import numpy as np

        role, digest, c, size, bits, marks = zip(*rows)
        sides = [np.flatnonzero(np.array(role) == r) for r in (0, 1)]
        if not all(map(len, sides)):
            return []
        sketch = np.frombuffer(b"".join(bits), np.uint16).reshape(len(rows), -1)
        mark = np.frombuffer(b"".join(marks), np.uint32).reshape(len(rows), -1)
        names = {x: i for i, x in enumerate(dict.fromkeys(c))}
        part, n = np.array([names[x] for x in c]), np.array(size)
        i, j = (s[x] for s, x in zip(sides, trie_join(sketch[sides[0]], sketch[sides[1]], FAR)))
        keep = (part[i] != part[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
        i, j = i[keep], j[keep]
        seen = set()
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            first = (mark[x] == mark[y]).argmax(1) == key[0]
            seen.update(x[first].tolist(), y[first].tolist())
        return [dict(zip(UNIT_KEY, key), role=role[x], digest=digest[x], c=c[x]) for x in sorted(seen)]

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("band", pa.int32()), ("key", pa.int64()), ("block", pa.int64()), ("chunk", pa.int64()), ("role", pa.int32()), ("digest", pa.binary()), ("c", pa.binary())])
        yield from _groups(batches, UNIT_KEY, ["role", "digest", "c", "size", "bits", "marks"], one, schema)

    return run


def overlaps(sets, sets2):
    """A matrix of the sizes of the intersections of each of `sets` with each of `sets2` (sorted arrays)."""
    import numpy as np

    out = np.zeros((len(sets), len(sets2)), np.float32)
    everything = np.concatenate([*sets, *sets2])
    owner = np.repeat(np.arange(len(sets) + len(sets2)), [len(x) for x in (*sets, *sets2)])
    order = np.argsort(everything, kind="stable")
    everything, owner = everything[order], owner[order]
    starts = np.flatnonzero(np.append(True, everything[1:] != everything[:-1]))
    count = np.diff(np.append(starts, len(everything)))
    keep = np.repeat(count > 1, count)
    column = np.repeat(np.cumsum(count > 1) - 1, count)[keep]
    owner = owner[keep]
    step = 2048
    for at in range(0, int((count > 1).sum()), step):
        lo, hi = np.searchsorted(column, [at, at + step])
        dense = np.zeros((len(sets) + len(sets2), step), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        out += dense[: len(sets)] @ dense[len(sets) :].T
    return out


def _settle(similarity):
    """The spanning links between components of a unit, by exact similarity."""

    def one(_, rows):
        import numpy as np

        ours, theirs = ([x for x in rows if x[0] == r] for r in (0, 1))
        if not ours or not theirs:
            return []
        sets, sets2 = ([np.frombuffer(x[3], np.uint64) for x in side] for side in (ours, theirs))
        both = overlaps(sets, sets2)
        sizes = np.array([len(x) for x in sets])[:, None] + np.array([len(x) for x in sets2])[None, :] - both
        names = {x: i for i, x in enumerate(dict.fromkeys(x[2] for x in rows))}
        i, j = np.nonzero(both >= similarity * sizes.astype(np.float64))
        pairs = {}
        for x, y in zip(i.tolist(), j.tolist()):
            a, b = names[ours[x][2]], names[theirs[y][2]]
            if a != b:
                pairs.setdefault((min(a, b), max(a, b)), (ours[x][1], theirs[y][1]))
        root = list(range(len(names)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for (a, b), (x, y) in pairs.items():
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append({"a": x, "b": y})
        return out

    def run(batches):
        import pyarrow as pa

        yield from _groups(batches, UNIT_KEY, ["role", "digest", "c", "shingles"], one, pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    return run


UNIT_KEY = ["band", "key", "block", "chunk"]


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def near_duplicate_texts(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Each distinct text of docs: its digest, low (its smallest doc_id), and the group of near-duplicate texts that it is in (named by a digest)."""
    with small_batches(docs.sparkSession):  # all its Python work is done when it returns
        return _near_duplicate_texts(docs, similarity)


def _near_duplicate_texts(docs: DataFrame, similarity: float) -> DataFrame:
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    marked = keyed.mapInArrow(_print_rows, "doc_id long, digest binary, size int, bits binary, marks binary, bands array<long>")
    texts = marked.groupBy("digest").agg(F.min("doc_id").alias("low"), *(F.first(x).alias(x) for x in ("size", "bits", "marks", "bands")))
    texts = materialize(texts, "texts")
    rows = texts.select("digest", "low", "size", F.posexplode("bands").alias("band", "key"))
    shared = materialize(rows.join(rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), ["band", "key"]), "bands")

    need = shared.select("digest", F.col("low").alias("doc_id")).distinct()
    same = keyed["doc_id"].eqNullSafe(need["doc_id"]) & (keyed["digest"] == need["digest"])
    sets = keyed.join(need, same, "left_semi").select("digest", "text").dropDuplicates(["digest", "text"]).mapInArrow(_shingle_rows, "digest binary, shingles binary")
    sets = materialize(sets.dropDuplicates(["digest"]), "shingles")

    # each text of a key against that which meets the most others; sizes and sketches tell chance meetings from copies before any shingles move
    score = shared.groupBy("digest").agg(F.sum("n").alias("score"))
    hubs = shared.join(score, "digest").groupBy("band", "key").agg(F.max_by("digest", F.struct("score", "digest")).alias("hub"))
    stars = shared.join(hubs, ["band", "key"]).where("digest <> hub").select(F.least("digest", "hub").alias("a"), F.greatest("digest", "hub").alias("b")).distinct()
    side = lambda x: texts.where("size > 0").select(F.col("digest").alias(x), F.col("size").alias(f"n{x}"), *(F.conv(F.hex(F.substring("bits", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"{x}{i}") for i in range(4)))
    far = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, 4)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    likely = stars.join(side("a"), "a").join(side("b"), "b").where((far <= FAR) & (F.least("na", "nb") >= similarity * F.greatest("na", "nb"))).select("a", "b")
    x, y = (sets.select(F.col("digest").alias(a), F.col("shingles").alias(b)) for a, b in ("ax", "by"))
    edges = materialize(likely.join(x, "a").join(y, "b").mapInArrow(_verify(similarity), "a binary, b binary"), "links")
    nodes = connected_components(edges)

    # keys that still have several components: what is outside the largest meets everything
    placed = shared.join(nodes, F.col("digest") == F.col("node"), "left").select("band", "key", "digest", "size", F.coalesce("component", "digest").alias("c"))
    parts = placed.groupBy("band", "key", "c").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    keys = parts.groupBy("band", "key").agg(F.max_by("c", F.struct("n", "c")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("words").alias("words"), F.count("*").alias("parts")).where("parts > 1")
    units = lambda n: F.greatest(F.ceil(n / F.lit(UNIT)), F.ceil(F.col("words") / F.lit(UNIT_SHINGLES)))
    keys = keys.select("band", "key", "largest", units(F.col("n") - F.col("most")).alias("blocks"), units(F.col("n")).alias("chunks"))
    apart = materialize(placed.drop("size").join(keys, ["band", "key"]), "apart")
    deal = lambda salt, n: F.pmod(F.xxhash64("digest", F.lit(salt)), F.col(n)).alias(n[:-1])
    columns = ["band", "key", "digest", "c"]
    outer = apart.where("c <> largest").select(*columns, F.lit(0).alias("role"), deal(1, "blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    whole = apart.select(*columns, F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), deal(2, "chunks"))
    meet = outer.unionByName(whole).join(texts.select("digest", "size", "bits", "marks"), "digest")
    unit = lambda df: df.repartition(*UNIT_KEY).sortWithinPartitions(*UNIT_KEY)
    possible = materialize(unit(meet).mapInArrow(_possible(similarity), "band int, key long, block long, chunk long, role int, digest binary, c binary"), "possible")
    more = unit(possible.join(sets, "digest")).mapInArrow(_settle(similarity), "a binary, b binary")
    nodes = connected_components(edges.unionByName(more))
    return texts.join(nodes, texts["digest"] == nodes["node"], "left").select("digest", "low", F.coalesce("component", "digest").alias("group"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Groups of near-duplicate documents: doc_id, digest of the text, and group_id, the smallest doc_id of the group (null if it has none), one
    row for each doc_id and text. Equal texts are one group; different texts are linked at `similarity` of their five-word shingle sets."""
    texts = near_duplicate_texts(docs, similarity)
    groups = texts.groupBy("group").agg(F.min("low").alias("group_id"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest")).distinct().join(texts.join(groups, "group").select("digest", "group_id"), "digest")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: one with the smallest doc_id."""
    best = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "digest"))
    kept = near_duplicate_texts(docs, similarity).groupBy("group").agg(best.alias("x")).select(F.col("x.low").alias("__id"), F.col("x.digest").alias("__kept"))
    kept = materialize(kept, "kept")
    keyed = docs.withColumn("__digest", _digest())
    out = keyed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__kept")))
    return out.dropDuplicates(["__id", "__kept"]).select(*docs.columns)
