"""Toxicity: a support vector machine over a gapped subsequence string kernel with Nystroem landmarks, trained on labelled sentences.

Kernel: two strings are compared by the three-letter subsequences that they share, each weighted by DECAY to the power of the letters it
spans (SPAN at most after the first), so inserted or separating characters cost a little and do not hide a word. A word is framed by white space; runs of
single letters (`i d i o t`) count as one word, and a word with marks or gaps inside is also compared without them. A string's norm is that of its length, which keeps the kernel positive semi-definite.
A sentence is compared with a landmark at its best word, a document at its worst sentence. A sentence ends with a word that ends in `.`, `!` or `?`, or with a line; `score_sentences` gives each one's score.

Training: labels are of documents, so it is mi-SVM: every sentence of a clean document is negative; in each toxic document the witness
words are chosen, first by how much more often they occur in toxic than in clean documents and then by the machine itself, and it is trained again.
Landmarks are words of the sample; after training their expansion is folded into one weight for each letter triple, so scoring a text
is a pass of table look-ups over its whole length. Platt's sigmoid gives the probability.

The sample: at most SAMPLE documents of each label, those with the least hash of doc_id, from labelled rows in the training folds; one text of each doc_id (the least). Of its words,
whole at any length, the machine is fitted on at most WITNESSES toxic ones, the COMMON most frequent and OTHERS more clean ones, and each round adds the HARD clean words that it scores worst.

Defined cases: null and empty texts score as texts without words; words of any length are scored; conflicting labels of a document
count as toxic; repeated rows score alike; with no toxic or no clean training rows each score is the share of toxic ones (0 without labels); other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

SAMPLE = 2000
LANDMARKS = 400
COST = 4000.0
NEGATIVE_COST = 8000.0
DECAY = 0.75
SPAN = 4
GAPS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]
ROUNDS = 4
WITNESSES = 4000
COMMON = 1500
OTHERS = 4000
HARD = 3000
THRESHOLD = 0.3
NO_WORDS = -4.0
#: Bytes of text that are looked at together.
SLICE = 1 << 18

_classes = None


def letter_classes():
    """One of 32 classes for each byte: 0 white space, 1 to 26 letters, then other bytes."""
    global _classes
    import numpy as np

    if _classes is None:
        c = np.full(256, 31, np.int32)
        c[list(b"\t\n\x0b\x0c\r ")] = 0
        for i in range(26):
            c[97 + i] = c[65 + i] = i + 1
        for digit, letter in zip(b"013457", b"oieast"):
            c[digit] = letter - 96
        c[128:192] = 27 + np.arange(64) % 3  # the last bytes of letters such as those with accents
        c[192:] = 30
        _classes = c
    return _classes


def word_spans(text, starts):
    """(first, end, doc) of words; neighbouring single letters are one word."""
    import numpy as np

    from . import words

    first, end, doc = words.find_words(text, starts)
    if len(first) < 2:
        return first, end, doc
    single = end - first == 1
    joins = single[1:] & single[:-1] & (doc[1:] == doc[:-1]) & (first[1:] - end[:-1] == 1)
    begin = np.concatenate([[True], ~joins])
    last = np.concatenate([~joins, [True]])
    return first[begin], end[last], doc[begin]


def triples(text, first, end):
    """For each gap, (index of the word, letter triple) of each place, in order of words. A word's frame counts as its first and last letter."""
    import numpy as np

    c = np.concatenate([[0], letter_classes()[text], np.zeros(SPAN + 2, np.int32)])  # c[i + 1] is letter i, and a word's first letter comes after its frame
    size = end - first + 2
    word = np.repeat(np.arange(len(first)), size)
    at = np.arange(len(word)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    place, left = first[word] + at, size[word] - 1 - at
    # the frame is white space whatever stands there (the edge of a text, or a letter of the next one)
    letter = np.where((at == 0) | (left == 0), 0, c[place])
    letter = np.concatenate([letter, np.zeros(SPAN, letter.dtype)]).astype(np.int32)
    n = len(word)
    for a, b in GAPS:
        ok = np.flatnonzero(left >= b)
        yield (a, b), word[ok], (letter[ok] << 10) | (letter[ok + a] << 5) | letter[ok + b]
    assert n == len(left)


def norms(size):
    """Of words by length with frame: the root of the sum of squared weights."""
    import numpy as np

    total = np.zeros(len(size))
    for _, b in GAPS:
        total += np.maximum(0, size - b) * DECAY ** (2 * (b + 1))
    return np.sqrt(np.maximum(total, DECAY**6))


def word_scores(text, first, end, weights):
    import numpy as np

    score = np.zeros(len(first))
    for (_, b), word, code in triples(text, first, end):
        score += np.bincount(word, weights[code] * DECAY ** (b + 1), len(first))
    return score / norms(end - first + 2)


def squeezed(text, first, end):
    """(text, first, end, word) of the words that hold marks or gaps between their letters, without those: `i-d-i-o-t` becomes `idiot`."""
    import numpy as np

    mark = np.isin(letter_classes()[text], (0, 31))
    total = np.concatenate([[0], np.cumsum(mark)])
    word = np.flatnonzero((total[end] > total[first]) & (total[end] - total[first] < end - first))
    size = end[word] - first[word]
    of = np.repeat(np.arange(len(word)), size)
    place = np.repeat(first[word], size) + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    keep = ~mark[place]
    of, place = of[keep], place[keep]
    left = np.bincount(of, minlength=len(word))
    last = np.cumsum(left)
    return text[place], last - left, last, word


def sentence_starts(text, first, end, doc):
    """Which words begin a sentence of their text."""
    import numpy as np

    lines = np.concatenate([[0], np.cumsum(text == 10)])
    ends = np.isin(text[end[:-1] - 1], list(b".!?")) | (lines[first[1:]] > lines[end[:-1]]) | (doc[1:] != doc[:-1])
    return np.flatnonzero(np.concatenate([[True], ends]))


def sentence_scores(column, weights, bias: float):
    """(text, begin, end, score) of each sentence of a binary column, in pieces: the machine's output for its worst word, as written or squeezed. Places are in bytes of the text."""
    import numpy as np

    from . import words

    for offset, part in words.slices(column, SLICE):
        text, starts = words.raw(part)
        first, end, doc = word_spans(text, starts)
        if len(first):
            score = word_scores(text, first, end, weights) + bias
            bare, a, b, word = squeezed(text, first, end)
            if len(word):
                score[word] = np.maximum(score[word], word_scores(bare, a, b, weights) + bias)
            at = sentence_starts(text, first, end, doc)
            last = np.append(at[1:], len(first)) - 1
            yield offset + doc[at], first[at] - starts[doc[at]], end[last] - starts[doc[at]], np.maximum.reduceat(score, at)


def text_scores(column, weights, bias: float):
    """The machine's output for each text of a binary column: that of its worst sentence; NO_WORDS for none."""
    import numpy as np

    out = np.full(len(column), NO_WORDS)
    for text, _, _, score in sentence_scores(column, weights, bias):
        np.maximum.at(out, text, score)
    return out


def features(strings: list[bytes]):
    """A sparse row of triple weights for each string, as (rows, codes, values), normalised by length."""
    import numpy as np

    text = np.frombuffer(b" ".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    rows, codes, values = [], [], []
    for (_, b), word, code in triples(text, first, first + size):
        rows.append(word)
        codes.append(code)
        values.append(np.full(len(word), DECAY ** (b + 1)))
    rows, codes, values = np.concatenate(rows), np.concatenate(codes), np.concatenate(values)
    return rows, codes, values / norms(size + 2)[rows]


def gram(sparse, n: int, turned):
    """Products of sparse rows with the columns of a dense matrix, in pieces."""
    import numpy as np

    rows, codes, values = sparse
    order = np.argsort(rows, kind="stable")
    rows, codes, values = rows[order], codes[order], values[order]
    values = values.astype(np.float32)
    out = np.zeros((n, turned.shape[1]), np.float32)
    cut = np.searchsorted(rows, np.arange(0, n + 100, 100))
    for a, b in zip(cut[:-1], cut[1:]):
        if a < b:
            part = turned[codes[a:b]] * values[a:b, None]
            at = np.flatnonzero(np.concatenate([[True], rows[a + 1 : b] != rows[a : b - 1]]))
            out[rows[a:b][at]] = np.add.reduceat(part, at, axis=0)
    return out


def svm(x, y, cost, rounds: int = 400):
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient steps."""
    import numpy as np

    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    v, t = w.copy(), 1.0
    square = sum((x1[i : i + 1000] * cost[i : i + 1000, None]).T @ x1[i : i + 1000] for i in range(0, len(x1), 1000))
    step = 1.0 / (1.0 + 2 * np.linalg.eigvalsh(square)[-1])
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        grad = v - 2 * x1.T @ (cost * y * slack)
        grad[-1] -= v[-1]
        nxt = v - step * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = nxt, nxt + (t - 1) / t2 * (nxt - w), t2
    return w[:-1], w[-1]


def sigmoid_fit(f, y, rounds: int = 100):
    """Platt's slope and offset: P(1 | f) = 1 / (1 + exp(-(slope f + offset)))."""
    import numpy as np

    pos, neg = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        r, q = p - goal, p * (1 - p) + 1e-9
        h = np.array([[(q * f * f).sum() + 1e-3, (q * f).sum()], [(q * f).sum(), q.sum() + 1e-3]])
        da, db = np.linalg.solve(h, np.array([(r * f).sum(), r.sum()]))
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return max(a, 0.1), b


def vocabulary(texts: list[bytes]):
    """(strings, word, doc, context): the distinct words, and for each place its word, document and a hash of its neighbours."""
    import numpy as np
    import pyarrow as pa

    from . import words as w_

    hashes, docs, contexts, strings, known = [], [], [], [], {}
    for offset, part in w_.slices(pa.array(texts, pa.binary()), SLICE):
        text, starts = w_.raw(part)
        first, end, doc = word_spans(text, starts)
        if not len(first):
            continue
        text = w_.lowered(text)
        h = w_.word_hashes(text, first, end)
        around = w_.mixed(np.concatenate([h[:1], h[:-1]])) * np.uint64(3) + w_.mixed(np.concatenate([h[1:], h[-1:]])) * np.uint64(5)
        new, place, word = np.unique(h, return_index=True, return_inverse=True)
        number = np.empty(len(new), np.int32)
        data = text.tobytes()
        for i, (x, k) in enumerate(zip(new.tolist(), place.tolist())):
            if x not in known:
                known[x] = len(strings)
                strings.append(data[first[k] : end[k]])
            number[i] = known[x]
        hashes.append(number[word])
        docs.append((doc + offset).astype(np.int32))
        contexts.append(w_.mixed(h + around))
    none = np.zeros(0, np.int32)
    return strings, *(np.concatenate([none, *x]) for x in (hashes, docs)), np.concatenate([np.zeros(0, np.uint64), *contexts])


def fit(texts: list[bytes], labels: list[int], share: float | None = None) -> dict:
    """The model of labelled texts: a weight for each letter triple, bias, slope and offset. `share` is that of toxic documents where the sample comes
    from, if the sample was drawn by label."""
    import numpy as np
    import pyarrow as pa

    y = np.array(labels)
    share = share if share is not None else float(y.mean()) if len(y) else 0.0
    nothing = {"weights": np.zeros(1 << 15, np.float32), "bias": 0.0, "slope": 0.0, "offset": 0.0, "constant": share}
    if not len(y) or y.min() == y.max():
        return nothing
    strings, word, doc, context = vocabulary(texts)
    n = len(strings)
    # in how many distinct contexts a word occurs in toxic and in clean documents: copies of a document count once
    seen = []
    for label in (1, 0):
        mine = np.flatnonzero(y[doc] == label)
        _, at = np.unique(context[mine], return_index=True)
        seen.append(np.bincount(word[mine[at]], minlength=n))
    del context
    toxic, clean = seen
    lift = np.log((toxic + 0.1) / (toxic.sum() + 1)) - np.log((clean + 0.1) / (clean.sum() + 1))
    certain = (toxic >= 3) & (lift > 2.0)
    witness = certain.copy()
    rng = np.random.default_rng(11)
    negative = np.zeros(n, bool)
    only = np.flatnonzero(clean > 0)
    negative[only[np.argsort(-clean[only], kind="stable")[:COMMON]]] = True
    negative[rng.permutation(only)[:OTHERS]] = True
    hard = np.zeros(n, bool)
    blob = np.frombuffer(b" ".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    model = {}
    for _ in range(ROUNDS):
        pos = np.flatnonzero(witness)
        pos = pos[np.argsort(-toxic[pos], kind="stable")[:WITNESSES]]
        neg = np.flatnonzero((negative | hard) & ~witness & (clean > 0))
        if not len(pos) or not len(neg):
            return nothing
        chosen = np.concatenate([pos[: LANDMARKS // 2], rng.permutation(np.flatnonzero(hard & ~witness))[: LANDMARKS // 4]])
        chosen = np.concatenate([chosen, rng.permutation(neg)[: LANDMARKS - len(chosen)]])
        rows, codes, values = features([strings[i] for i in chosen])
        turned = np.zeros((1 << 15, len(chosen)), np.float32)
        np.add.at(turned, (codes, rows), values)
        spread, base = np.linalg.eigh((turned.T @ turned).astype(float))
        root = base / np.sqrt(np.maximum(spread, 1e-3)) @ base.T
        both = np.concatenate([pos, neg])
        x = gram(features([strings[i] for i in both]), len(both), turned) @ root
        target = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        cost = np.concatenate([COST * toxic[pos] / toxic[pos].sum(), NEGATIVE_COST * np.sqrt(clean[neg]) / np.sqrt(clean[neg]).sum()]) + np.where(target > 0, 0.02, 0.5)
        w, bias = svm(x, target, cost)
        weights = (turned @ (root @ w)).astype(np.float32)
        del turned, x
        model = {"weights": weights, "bias": float(bias)}
        score = np.concatenate([word_scores(blob[begin[i] : begin[min(i + 20_000, n) - 1] + size[min(i + 20_000, n) - 1]], begin[i : i + 20_000] - begin[i], (begin + size)[i : i + 20_000] - begin[i], weights) for i in range(0, n, 20_000)]) + bias
        # clean words that the machine takes for toxic, and the worst word of toxic documents without a certain witness
        far = np.flatnonzero((clean > 0) & ~certain & (score > -0.6))
        hard[far[np.argsort(-score[far], kind="stable")[:HARD]]] = True
        witness = certain.copy()
        lost = np.ones(len(y), bool)
        lost[doc[certain[word]]] = False
        mine = np.flatnonzero((y[doc] == 1) & lost[doc] & (clean[word] == 0) & (score[word] > 0))
        order = mine[np.lexsort((-score[word[mine]], doc[mine]))]
        witness[word[order[np.flatnonzero(np.concatenate([[True], doc[order][1:] != doc[order][:-1]]))]] if len(order) else []] = True
    f = text_scores(pa.array(texts, pa.binary()), model["weights"], model["bias"])
    slope, offset = sigmoid_fit(f, np.where(y > 0, 1.0, -1.0))
    offset += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))) if 0 < share < 1 else 0.0
    return model | {"slope": slope, "offset": offset, "constant": None}


def probabilities(column, model: dict):
    import numpy as np

    if model["constant"] is not None:
        return np.full(len(column), model["constant"])
    f = text_scores(column, model["weights"], model["bias"])
    return 1 / (1 + np.exp(-np.clip(model["slope"] * f + model["offset"], -30, 30)))


def fold(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def sample_texts(docs: DataFrame, labels: DataFrame, name: str, parts: int, held: int, most: int, values=(0, 1)) -> tuple[DataFrame | None, float]:
    """doc_id, text, label of at most `most` documents of each label value, with the least hashes, from the training folds; and the mean label of all
    documents in them."""
    marked = labels.where(F.col(name).isin(*values) & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id"), parts) != held)
    marked = marked.groupBy("doc_id").agg(F.max(name).cast("int").alias("label"))
    marked = marked.join(docs.select("doc_id"), "doc_id", "left_semi")
    rank = F.xxhash64("doc_id")
    chosen = None
    for v in values:
        part = marked.where(F.col("label") == v).orderBy(rank, "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = [(r[0], r[1]) for r in chosen.collect()]  # at most `most` ids of each value
    if not rows:
        return None, 0.0
    mean = float(marked.agg(F.avg("label")).first()[0])
    small = docs.sparkSession.createDataFrame(rows, docs.select("doc_id").schema.add("label", T.IntegerType()))
    found = docs.select("doc_id", "text").join(F.broadcast(small), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit("")).cast("binary")).alias("text"), F.max("label").alias("label"))
    return one, mean


def _fitted(share: float):
    def run(batches):
        import pickle

        import pyarrow as pa

        texts, labels = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            labels += batch.column("label").to_pylist()
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(texts, labels, share))]}, schema=pa.schema([("model", pa.binary())]))

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict:
    """The model of a bounded sample. It is fitted in one task, where the sample meets; the driver gets the model only."""
    import pickle

    sample, share = sample_texts(docs, labels, "toxic", 4, 2, most)
    got = sample.repartition(1).sortWithinPartitions("doc_id", "label", "text").mapInArrow(_fitted(share), "model binary").collect() if sample is not None else []
    return pickle.loads(bytes(got[0][0])) if got else fit([], [], share)


def _score(shared):
    def run(batches):
        import pyarrow as pa

        from . import words

        for batch in batches:
            p = probabilities(words.binary(batch.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, model: dict, parts: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_score(shared), "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_sentences(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, begin, end (in bytes of the text), score of each sentence of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from . import words

        for batch in batches:
            m = shared.value
            if m["constant"] is None:
                for text, begin, end, score in sentence_scores(words.binary(batch.column("text")), m["weights"], m["bias"]):
                    p = 1 / (1 + np.exp(-np.clip(m["slope"] * score + m["offset"], -30, 30)))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text)), pa.array(begin), pa.array(end), pa.array(p)], names=["doc_id", "begin", "end", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, begin long, end long, score double")


def _keep(shared, threshold):
    def run(batches):
        import pyarrow as pa

        from . import words

        for batch in batches:
            yield batch.filter(pa.array(probabilities(words.binary(batch.column("text")), shared.value) < threshold))

    return run


def drop_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score is the threshold or more."""
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model), threshold), docs.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
