"""Token counts: pieces are counted once for each distinct pre-token and joined to the pre-token frequencies of the documents; no ids of a document are ever made.

A pre-token is what lies between two boundaries that no piece spans. The model joins neighbouring symbols only to pieces that it knows, so where no piece has two characters side by
side, nothing is ever joined across them, and each side is cut up as if it stood alone. The pairs of characters that do stand side by side in some piece are read from the model; all
other neighbours are boundaries. This is exact, and gives far fewer distinct pre-tokens than words (`,` and digits stand alone, for example).

    vocabulary   pre-token, occurrences, tokens    each distinct pre-token is given to the library once
    frequent     those with 1/FREQUENT of all occurrences or more, so FREQUENT at most whatever the corpus is; 12 bytes of each are broadcast
    documents    frequencies by pre-token: sums over frequent ones in place; the others are stored and joined to the vocabulary by their text

No pre-token that is joined by a shuffle has more than 1/FREQUENT of all occurrences, so the join has no hot key. Within a task pre-tokens go by 64-bit names (a wrong match has a
chance of about 1e-4 over 10^10 distinct ones).

Defined cases: null text is empty, and an empty text has no tokens; each row is counted by itself, rows that repeat a doc_id (or have none) included; strings of special tokens are
ordinary text, as the library takes them; bytes that aren't UTF-8 count as U+FFFD; very long texts are taken in segments that end at boundaries; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
FREQUENT = 500_000
SEGMENT = 1 << 21
SPACE = "▁"  # how the library writes a space
LEAD = "\x01"  # stands in no piece of several characters, so counts behind it are those of the rest


class Pieces:
    """A model, and which neighbouring characters it may join."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a  b\t\r\n ﬁ² Å "
        if m.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError(f"{path} changes texts before it cuts them up")
        kinds = range(m.get_piece_size())
        if not any(map(m.is_byte, kinds)):
            raise ValueError(f"{path} has no pieces for single bytes")
        pieces = [m.id_to_piece(i) for i in kinds if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i) or m.is_unused(i))]
        known = sorted({c for p in pieces if len(p) > 1 for c in p})
        if LEAD in known:
            raise ValueError(f"{path} has pieces with {LEAD!r}")
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.n = len(known) + 1
        joined = np.zeros((self.n, self.n), bool)
        for p in pieces:
            at = self.place[[ord(c) for c in p]]
            joined[at[:-1], at[1:]] = True
        self.joined = joined.ravel()
        self.base = len(m.encode(LEAD))

    def tokens(self, pretokens: list[str]) -> list[int]:
        return [len(x) - self.base for x in self.model.encode([LEAD + p for p in pretokens], num_threads=1)]

    def starts(self, codes):
        """Where pre-tokens of the characters begin, from the second on."""
        import numpy as np

        at = self.place[codes]
        return np.flatnonzero(~self.joined[at[:-1] * self.n + at[1:]]) + 1


@cache
def pieces(path: str | None) -> Pieces:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    return Pieces(path)


def _codes(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def segments(texts: list[bytes], own: Pieces, most: int = SEGMENT):
    """Lists of (text, part of it), each of about `most` characters; every part begins and ends at boundaries."""
    out, size = [], 0
    for i, raw in enumerate(texts):
        if not raw:
            continue
        text, at = (SPACE + raw.decode("utf-8", "replace").replace(" ", SPACE)), 0
        while at < len(text):
            part, width = text[at : at + most], most
            while at + len(part) < len(text):
                cuts = own.starts(_codes(part))
                if len(cuts):
                    part = part[: cuts[-1]]
                    break
                width *= 2
                part = text[at : at + width]
            at += len(part)
            out.append((i, part))
            size += len(part)
            if size >= most:
                yield out
                out, size = [], 0
    if out:
        yield out


def split(parts, own: Pieces):
    """(characters, begin, end, name, text) of the pre-tokens of segments."""
    import numpy as np

    from .words import word_hashes

    joined = "".join(p for _, p in parts)
    codes = _codes(joined)
    inside = np.zeros(len(codes), bool)
    inside[own.starts(codes)] = True
    edges = np.cumsum([0, *(len(p) for _, p in parts)])
    inside[edges[:-1]] = True
    first = np.flatnonzero(inside)
    end = np.append(first[1:], len(codes))
    text = np.array([i for i, _ in parts])[np.searchsorted(edges, first, "right") - 1]
    return joined, first, end, word_hashes(codes, first, end), text


def _texts(column) -> list[bytes]:
    from .words import binary

    return binary(column).to_pylist()


def _distinct(path):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = pieces(path)
        for batch in batches:
            for parts in segments(_texts(batch.column("text")), own):
                chars, first, end, name, _ = split(parts, own)
                name, at, n = np.unique(name, return_index=True, return_counts=True)
                words = [chars[i:j] for i, j in zip(first[at].tolist(), end[at].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(name.view(np.int64)), pa.array(n)], ["pretoken", "name", "n"])

    return run


def _counted(path):
    def run(batches):
        import pyarrow as pa

        own = pieces(path)
        for batch in batches:
            tokens = own.tokens(batch.column("pretoken").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int32())], [*batch.schema.names, "tokens"])

    return run


def vocabulary(docs: DataFrame, model: str | None = None) -> DataFrame:
    """pretoken, name, n, tokens: each distinct pre-token of the texts, its 64-bit name, its occurrences and the tokens of one."""
    seen = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_distinct(model), "pretoken string, name long, n long")
    return seen.groupBy("pretoken").agg(F.first("name").alias("name"), F.sum("n").alias("n")).mapInArrow(_counted(model), "pretoken string, name long, n long, tokens int")


def _by_document(path, shared):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = pieces(path)
        frequent, tokens = shared.value
        for batch in batches:
            texts = _texts(batch.column("text"))
            known, rest = np.zeros(len(texts), np.int64), []
            for parts in segments(texts, own):
                chars, first, end, name, text = split(parts, own)
                at = np.minimum(np.searchsorted(frequent, name), len(frequent) - 1)
                hit = frequent[at] == name
                known += np.bincount(text[hit], tokens[at[hit]], len(texts)).astype(np.int64)
                first, end, name, text = (x[~hit] for x in (first, end, name, text))
                order = np.lexsort((name, text))
                name, text = name[order], text[order]
                new = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (text[1:] != text[:-1]))) if len(name) else np.zeros(0, np.int64)
                words = [chars[i:j] for i, j in zip(first[order[new]].tolist(), end[order[new]].tolist())]
                rest.append((text[new], words, np.diff(np.append(new, len(name)))))
            text = np.concatenate([x[0] for x in rest]) if rest else np.zeros(0, np.int64)
            order = np.argsort(text, kind="stable")
            words = pa.array([w for x in rest for w in x[1]], pa.string()).take(pa.array(order))
            counts = pa.array((np.concatenate([x[2] for x in rest]) if rest else np.zeros(0, np.int64))[order].astype(np.int32), pa.int32())
            offsets = np.append(0, np.cumsum(np.bincount(text, minlength=len(texts)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([words, counts], ["pretoken", "n"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(known), lists], ["row", "doc_id", "n_bytes", "known", "rest"]
            )

    return run


def token_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row. `model` is a path that all executors have; without one it is the installed MODEL."""
    import numpy as np

    spark = docs.sparkSession
    words = materialize(vocabulary(docs, model), "pretokens")
    total = words.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * frequent >= total
    top = words.where(often).select("name", "tokens").toArrow()
    names, tokens = top["name"].to_numpy().view(np.uint64), top["tokens"].to_numpy()
    order = np.argsort(names)
    shared = spark.sparkContext.broadcast((names[order], tokens[order]) if len(names) else (np.zeros(1, np.uint64), np.zeros(1, np.int32)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    schema = f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, known long, rest array<struct<pretoken:string,n:int>>"
    rows = materialize(rows.mapInArrow(_by_document(model, shared), schema), "frequencies")
    rare = rows.select("row", F.inline("rest")).join(words.where(~often).select("pretoken", "tokens"), "pretoken")
    sums = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("tokens")).alias("known"))
    both = rows.select("row", "doc_id", "n_bytes", "known").unionByName(sums, allowMissingColumns=True)
    counts = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("known").alias("n_tokens"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
