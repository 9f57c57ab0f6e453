"""Suffix-array deduplication: remove every byte covered by a LENGTH-byte string that starts anywhere else too.

1. Anchors. Of every LENGTH-byte window the k-gram with the least hash is its anchor. Equal windows have equal anchors, so a window whose anchor
   is an anchor once in the corpus is not repeated. Texts that are equal as a whole are looked up by digest and sorted once.
2. Contexts. The windows of each repeated anchor, one run of bytes for each place, meet by anchor.
3. Suffix array. In pieces of about a megabyte (whole anchor groups) the contexts are sorted by the difference-cover algorithm: sampled positions
   (1 and 2 modulo 3) are sorted by triples, their names are sorted recursively, the remaining suffixes are merged in, and neighbours in suffix order are compared over
   LENGTH bytes. Names cover 3, 9, 27, 81 and 243 bytes, so five levels settle a LENGTH of 200.
4. An anchor with more than HOT contexts, whether of one text or of many, is dealt in parts by context. What is repeated within a part is found there; of the rest, and of one window
   of each class found, 128-bit names are counted over the parts with partial aggregation. That is exact too, and spreads a passage that a third of all documents share, or a line
   that one very long text repeats, over all tasks. A context has at most 2 * LENGTH - GRAM bytes, so this bounds what is sorted at once, whatever the texts are.

Equal contexts are repeated as a whole, so each is sorted once. Windows of one text that repeat within it are found there, so long runs of a pattern send one context each.

Defined cases: null text is empty; a null doc_id is carried, and its text is judged like any other; texts under LENGTH bytes keep all; equal texts of LENGTH bytes or more go wholly; repeated rows are texts
like any other; overlaps count; marks are judged on the input; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

LENGTH = 200
GRAM = 64
WINDOW = LENGTH - GRAM + 1
HOT = 512
PIECE = 1_000_000
NO_ID = -(1 << 63)
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def rolling(text, k: int, seed: int = 0):
    """Hashes of all k-grams of an array of bytes."""
    import numpy as np

    from . import words

    n = len(text) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = words.powers(len(text) + 1)
    letter = text.astype(np.uint64) + np.uint64(1)
    if seed:  # an independent family: other values for the bytes
        letter = words.mixed(letter * np.uint64(2 * seed + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letter * up[: len(text)])])
    return words.mixed((total[k:] - total[:-k]) * down[:n])


def anchors(text):
    """(hash, place, first window, last window) of the anchors of an array of bytes, in order."""
    import numpy as np

    x = rolling(text, GRAM)
    n = len(x) - WINDOW + 1  # windows
    if n <= 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    bits = np.uint64(28)
    y = (x >> bits << bits) | np.arange(len(x), dtype=np.uint64)
    padded = np.full(-(-len(y) // WINDOW) * WINDOW, np.iinfo(np.uint64).max)
    padded[: len(y)] = y
    rows = padded.reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[WINDOW - 1 : WINDOW - 1 + n]) & np.uint64((1 << 28) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    return x[at[first]], at[first], first, last


# The difference-cover suffix sort ------------------------------------------------------------------------------------


def suffix_ranks(s, levels: int = 4):
    """For each suffix of s (values of 1 or more), how many suffixes are less; suffixes that agree in their first 3 ** (levels + 1) values may share a rank. Three names make one
    64-bit key, so names may have 21 bits; longer arrays are an error."""
    import numpy as np

    n = len(s)
    if n < 3:
        return np.array([sum(tuple(s[j:]) < tuple(s[i:]) for j in range(n)) for i in range(n)], np.int64)
    t = np.concatenate([s, np.zeros(3, np.int64)])
    width = max(1, int(s.max()).bit_length())
    if max(3 * width, 2 * width + n.bit_length()) > 63:
        raise OverflowError(f"{n} suffixes of {width}-bit values are too many for one sort")
    one = np.arange(1, n + (n % 3 == 1), 3)  # with a last, empty suffix where its triple is needed as an end mark
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triple = (t[sample] << (2 * width)) | (t[sample + 1] << width) | t[sample + 2]
    order = np.argsort(triple)
    new = np.concatenate([[True], triple[order][1:] != triple[order][:-1]])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if levels and not new.all():
        names = suffix_ranks(names, levels - 1) + 1
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    deep = int(names.max()).bit_length()
    zero = np.arange(0, n, 3)
    pair = lambda i: (t[i] << deep) | rank[i + 1]
    three = lambda i: (t[i] << (width + deep)) | (t[i + 1] << deep) | rank[i + 2]
    one, two = one[one < n], two
    key0, key0b, key1, key2 = pair(zero), three(zero), pair(one), three(two)
    s0, s0b, s1, s2 = (np.sort(k) for k in (key0, key0b, key1, key2))
    s12 = np.sort(rank[np.concatenate([one, two])])
    out = np.empty(n, np.int64)
    out[zero] = np.searchsorted(s0, key0) + np.searchsorted(s1, key0) + np.searchsorted(s2, key0b)
    out[one] = np.searchsorted(s12, rank[one]) + np.searchsorted(s0, key1)
    out[two] = np.searchsorted(s12, rank[two]) + np.searchsorted(s0b, key2)
    return out


def repeated_windows(contexts: list[tuple[int, int, bytes]]):
    """For contexts (text, start, bytes): two boolean arrays for each, of the windows that start at another place of another context too, and of
    the first window of each class of equal ones."""
    import numpy as np

    size = np.array([len(c[2]) for c in contexts])
    joined = np.frombuffer(b"".join(c[2] for c in contexts), np.uint8)
    # one end mark after each context, less than any byte
    place = np.arange(len(joined)) + np.repeat(np.arange(len(size)), size)
    s = np.zeros(len(joined) + len(size), np.int64)
    s[place] = joined.astype(np.int64) + 2
    s[s == 0] = 1
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    count = size - LENGTH + 1
    context = np.repeat(np.arange(len(size)), count)
    offset = np.arange(len(context)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    at = begin[context] + offset
    order = np.argsort(suffix_ranks(s)[at])
    p = at[order]
    # neighbours in suffix order, compared seven bytes at a time
    b = np.concatenate([s, np.zeros(8, np.int64)]).astype(np.uint64) & np.uint64(0x1FF)
    seven = np.zeros(len(s), np.uint64)
    for k in range(7):  # values have nine bits
        seven |= b[k : k + len(s)] << np.uint64(9 * k)
    same = np.arange(len(p) - 1)
    for k in range(0, LENGTH, 7):
        step = min(k, LENGTH - 7)
        same = same[seven[p[same] + step] == seven[p[same + 1] + step]]
    equal = np.zeros(len(p), bool)
    equal[same + 1] = True
    group = np.flatnonzero(~equal)
    text = np.array([c[0] for c in contexts], np.int64)
    start = np.array([c[1] for c in contexts], np.int64)
    source = (text[context] << 32 | (start[context] + offset))[order]
    low, high = np.minimum.reduceat(source, group), np.maximum.reduceat(source, group)
    hit, first = np.empty(len(p), bool), np.empty(len(p), bool)
    hit[order] = np.repeat(low != high, np.diff(np.concatenate([group, [len(p)]])))
    first[order] = ~equal
    cut = np.cumsum(count)[:-1]
    return list(zip(np.split(hit, cut), np.split(first, cut)))


# Texts ---------------------------------------------------------------------------------------------------------------


def contexts(text, hits: dict[int, int]):
    """([(anchor, contexts of it in all, start, bytes)], intervals) of a text: contexts of its repeated anchors, those that occur several times in the
    text once only, and the intervals covered by such."""
    import numpy as np

    data = np.frombuffer(text, np.uint8)
    h, _, first, last = anchors(data)
    known = np.isin(h.view(np.int64), np.fromiter(hits, np.int64, len(hits)))
    seen: dict[bytes, int] = {}
    rows, marked, twice = [], [], set()
    for i in np.flatnonzero(known).tolist():
        a, b = int(first[i]), int(last[i]) + LENGTH
        run = text[a:b]
        if run in seen:
            twice.add(run)
            marked.append((a, b))
        else:
            seen[run] = a
            anchor = int(h[i].view(np.int64))
            rows.append((anchor, hits[anchor], a, run))
    marked += [(seen[run], seen[run] + len(run)) for run in twice]
    return rows, marked


def _anchor_rows(batches):
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("times", pa.int64())])
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            found, times, rows = [], [], []
            for i, text in enumerate(part.column("text")):
                x, n = np.unique(anchors(np.frombuffer(text.as_py() or b"", np.uint8))[0], return_counts=True)
                found.append(x.view(np.int64))
                times.append(n)
                rows.append(np.full(len(x), i))
            rows = pa.array(np.concatenate(rows))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), part.column("doc_id").take(rows), part.column("h").take(rows), pa.array(np.concatenate(times))], schema=schema)


def _context_rows(batches):
    """Contexts, and with a null anchor the intervals (start, n) that repeat within their text."""
    import pyarrow as pa

    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("run", pa.binary())])
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part, out = batch.slice(begin, 256), []
            for i, h, text, hits in zip(*(part.column(c).to_pylist() for c in ("doc_id", "h", "text", "hits"))):
                rows, marked = contexts(text, {x["anchor"]: x["n"] for x in hits})
                out += [{"anchor": a, "n": n, "doc_id": i, "h": h, "start": s, "run": run} for a, n, s, run in rows]
                out += [{"anchor": None, "n": b, "doc_id": i, "h": h, "start": a, "run": None} for a, b in marked]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)


#: A marked interval [a, b) of a text; or with x and y the name of the window at a, and whether it is still open.
FOUND = "doc_id long, h long, a int, b int, x long, y long, open boolean"


def _found_schema():
    import pyarrow as pa

    return pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("open", pa.bool_())])


def covered(hit, start: int) -> list[tuple[int, int]]:
    """The intervals that the marked windows from `start` on cover."""
    import numpy as np

    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [(start + a, start + b - 1 + LENGTH) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


class Piece:
    """Contexts of whole groups, to be sorted together."""

    def __init__(self):
        self.contexts, self.size = [], 0
        self.marks: list = []  # doc_id, h, a, b
        self.names: list = []  # columns of names

    def add(self, group: list, hot: bool) -> None:
        """Equal contexts are repeated as a whole and are sorted once; a group of one context has nothing to compare, unless other parts of a hot group do."""
        by: dict[bytes, list] = {}
        for i, h, start, run in group:
            by.setdefault(run, []).append((i, h, start))
        for run, places in by.items():
            many = len(set(places)) > 1
            if many:
                self.marks += [(i, h, start, start + len(run)) for i, h, start in places]
            if hot or len(by) > 1:
                self.contexts.append((*places[0], run, many, hot))
                self.size += len(run) + 1

    def settle(self):
        import numpy as np
        import pyarrow as pa

        ids: dict[tuple[int, int], int] = {}
        if self.contexts:
            results = repeated_windows([(ids.setdefault((i, h), len(ids)), start, run) for i, h, start, run, _, _ in self.contexts])
            for (i, h, start, run, many, hot), (hit, first) in zip(self.contexts, results):
                if not many:
                    self.marks += [(i, h, a, b) for a, b in covered(hit, start)]
                if hot:  # other parts of the group may hold what is alone here
                    at = np.flatnonzero(first)
                    data = np.frombuffer(run, np.uint8)
                    x, y = (rolling(data, LENGTH, seed)[at].view(np.int64) for seed in (0, 1))
                    self.names.append((np.full(len(at), i), np.full(len(at), h), (start + at).astype(np.int32), x, y, ~hit[at] & (not many)))
        schema = _found_schema()
        if self.marks:
            cols = [pa.array(c, t) for c, t in zip(zip(*self.marks), schema.types)]
            none = lambda t: pa.nulls(len(self.marks), t)
            yield pa.RecordBatch.from_arrays([*cols, none(pa.int64()), none(pa.int64()), none(pa.bool_())], schema=schema)
        if self.names:
            i, h, at, x, y, alone = (np.concatenate(c) for c in zip(*self.names))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(h, pa.int64()), pa.array(at), pa.array(at + np.int32(LENGTH)), pa.array(x), pa.array(y), pa.array(alone)], schema=schema)
        self.__init__()


def _sorted_runs(most_contexts: int, most: int):
    """Contexts come sorted by anchor and part; whole groups are gathered into pieces of `most` bytes and sorted."""

    def run(batches):
        piece, group, last, hot, size = Piece(), [], None, False, 0
        for batch in batches:
            for anchor, part, n, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "part", "n", "doc_id", "h", "start", "run"))):
                if (anchor, part) != last:
                    if piece.contexts and piece.size + size > most or len(piece.marks) > 50_000:
                        yield from piece.settle()
                    piece.add(group, hot)
                    group, last, hot, size = [], (anchor, part), n > most_contexts, 0
                group.append(tuple(row))
                size += len(row[3]) + 1
        if piece.contexts and piece.size + size > most:
            yield from piece.settle()
        piece.add(group, hot)
        yield from piece.settle()

    return run


def _trimmed(batches):
    import hashlib

    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part, out = batch.slice(start, 256), []
            for i, h, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "h", "text", "spans"))):
                edge = np.zeros(len(text) + 1, np.int64)
                for x in spans:
                    edge[x["a"]] += 1
                    edge[x["b"]] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                begins = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append({"doc_id": i, "h": h, "n_removed": int(gone.sum()), "n_spans": begins, "kept_sha256": hashlib.sha256(kept).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    # inside, a row goes by its doc_id, or NO_ID, and the hash of its text
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = materialize(keyed.select("id", "doc_id", "h", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "rows")
    texts = rows.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.first("h").alias("h"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"))
    texts = materialize(texts, "texts")
    keyed = keyed.drop("id")
    found = materialize(keyed.mapInArrow(_anchor_rows, "anchor long, doc_id long, h long, times long"), "anchors")
    repeated = found.groupBy("anchor").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("times").alias("most"), F.sum("times").alias("n")).where("low <> high or most > 1").select("anchor", "n")
    hits = found.join(repeated, "anchor").groupBy("doc_id", "h").agg(F.collect_set(F.struct("anchor", "n")).alias("hits"))
    hits = hits.join(texts.where(f"n_bytes >= {LENGTH}").select(F.col("rep").alias("doc_id"), "h"), ["doc_id", "h"])
    wanted = materialize(keyed.join(hits, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]), "candidates")
    runs = materialize(wanted.mapInArrow(_context_rows, "anchor long, n long, doc_id long, h long, start int, run binary"), "contexts")
    parts = F.pmod(F.xxhash64("doc_id", "h", "start"), F.expr(f"(n + {HOT} - 1) div {HOT}"))
    groups = runs.where("anchor is not null").withColumn("part", parts).repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    seen = materialize(groups.select("anchor", "part", "n", "doc_id", "h", "start", "run").mapInArrow(_sorted_runs(HOT, PIECE), FOUND), "found")
    names = seen.where("x is not null")
    place = F.struct("doc_id", "h", "a")
    again = names.groupBy("x", "y").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("open").alias("any")).where("low <> high and any").select("x", "y")
    spread = names.where("open").join(again, ["x", "y"]).select("doc_id", "h", "a", "b")
    own = runs.where("anchor is null").select("doc_id", "h", F.col("start").alias("a"), F.col("n").cast("int").alias("b"))
    spans = seen.where("x is null").select("doc_id", "h", "a", "b").unionByName(own).unionByName(spread).groupBy("doc_id", "h").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    trimmed = wanted.select("doc_id", "h", "text").join(spans, ["doc_id", "h"]).select("doc_id", "h", "text", "spans").mapInArrow(_trimmed, "doc_id long, h long, n_removed long, n_spans long, kept_sha256 string")
    part = texts.join(trimmed.select(F.col("doc_id").alias("rep"), "h", "n_removed", "n_spans", "kept_sha256"), ["rep", "h"], "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    per_text = part.select(
        "sha", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
    return rows.join(per_text, "sha").select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
