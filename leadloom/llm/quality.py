"""Quality by positive-unlabelled learning: the non-negative unbiased risk, from trusted positives, unlabelled text and an estimated prior.

Positives are documents labelled good, in the training folds; unlabelled ones are any documents whatever their label (labels of bad documents are never
used). A first logistic model of positive against unlabelled gives scores, and the class prior is the least ratio of the
unlabelled to the positive tail above a score, with a confidence margin (best-bin estimate). A small network then minimises
prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the sigmoid loss, stepping back where the second part would turn negative. Inputs are shape features of whole texts:
shares of kinds of bytes, word lengths, repetition of words, shingles and lines, never labels, lang, source or doc_id.

The sample: at most POSITIVES and UNLABELLED documents, those with the least hashes of doc_id; only their feature rows reach the driver.

Defined cases: null and empty texts have features of their own (all shares 0) and a score; texts of any length are read whole; conflicting
labels count as good; repeated rows score alike; with no positive or no unlabelled rows each score is 0.5; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .toxicity import fold

POSITIVES = 8000
UNLABELLED = 16000
THRESHOLD = 0.5
FEATURES = 24


def text_features(column):
    """A row of FEATURES numbers for each text of a binary column."""
    import numpy as np

    from . import words

    out = np.zeros((len(column), FEATURES))
    for offset, part in words.slices(column):
        out[offset : offset + len(part)] = _features(part, words)
    return out


def _features(part, words):
    import numpy as np

    text, starts = words.raw(part)
    n = len(part)
    size = np.diff(starts)
    some = np.maximum(size, 1)
    kinds = np.zeros(256, np.int64)
    for k, group in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"%$#&*@", b"|<>{}[]=/\\_~^", b"-:;'\"()"), 1):
        kinds[list(group)] = k
    kinds[128:] = 13
    doc_of = np.repeat(np.arange(n), size)
    by = np.bincount(doc_of * 14 + kinds[text], minlength=14 * n).reshape(n, 14) if len(text) else np.zeros((n, 14))
    share = by[:, 1:] / some[:, None]
    first, end, doc = words.find_words(text, starts)
    many = np.bincount(doc, minlength=n)
    m = np.maximum(many, 1)
    cols = [share, np.log1p(size)[:, None], np.log1p(many)[:, None]]
    if len(first):
        lower = words.lowered(text)
        h = words.word_hashes(lower, first, end)
        length = end - first
        mean = np.bincount(doc, length, n) / m
        spread = np.sqrt(np.maximum(0, np.bincount(doc, length.astype(float) ** 2, n) / m - mean**2))
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        order = np.lexsort((h, doc))
        hs, ds = h[order], doc[order]
        new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])])
        distinct = np.bincount(ds[new], minlength=n)
        runs = np.diff(np.concatenate([np.flatnonzero(new), [len(hs)]]))
        top = np.zeros(n)
        np.maximum.at(top, ds[new], runs)
        sh, sd = words.shingle_hashes(h, doc, 3)
        order = np.lexsort((sh, sd))
        hs, ds = sh[order], sd[order]
        new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])])
        shingles = np.bincount(ds[new], minlength=n) / np.maximum(1, np.bincount(sd, minlength=n))
        upper = (text[first] >= 65) & (text[first] <= 90)
        tail = text[end - 1]
        odd = ~(((tail | 32) >= 97) & ((tail | 32) <= 122) | (tail >= 128) | (tail == 46) | (tail == 44))
        cols += [np.stack([mean, spread, np.bincount(doc, same, n) / m, distinct / m, top / m, shingles, np.bincount(doc, upper, n) / m, np.bincount(doc, odd, n) / m, np.bincount(doc, length > 20, n) / m], 1)]
    else:
        cols += [np.zeros((n, 9))]
    return np.hstack(cols)[:, :FEATURES]


def _logistic(x, y, weight, rounds=300, rate=0.1):
    import numpy as np

    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w


def estimate_prior(positive, unlabelled) -> float:
    """The least ratio of tails of the unlabelled and the positive scores, each widened by its confidence margin."""
    import numpy as np

    cuts = np.unique(np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, 400)))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(40) / (2 * len(positive))) + np.sqrt(np.log(40) / (2 * len(unlabelled)))
    ok = p > 0.05
    best = np.argmin((u[ok] + margin) / p[ok])
    return float(np.clip(u[ok][best] / p[ok][best], 0.05, 0.98))


def _net(x, net):
    import numpy as np

    hidden = np.tanh(x @ net[0] + net[1])
    return hidden, hidden @ net[2] + net[3]


def fit(positive, unlabelled, rounds: int = 250) -> dict:
    """The model of feature rows of positives and unlabelled texts."""
    import numpy as np

    if not len(positive) or not len(unlabelled):
        return {"net": None}
    mean, spread = unlabelled.mean(0), np.maximum(unlabelled.std(0), 1e-6)
    scale = lambda x: np.clip((x - mean) / spread, -6, 6)
    p, u = scale(positive), scale(unlabelled)
    both = np.vstack([p, u])
    both = np.hstack([both, both**2, np.ones((len(both), 1))])
    y = np.concatenate([np.ones(len(p)), np.zeros(len(u))])
    w = _logistic(both, y, np.concatenate([np.full(len(p), 0.5 / len(p)), np.full(len(u), 0.5 / len(u))]))
    s = both @ w
    prior = estimate_prior(s[: len(p)], s[len(p) :])
    rng = np.random.default_rng(5)
    h = 32
    net = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], h)), np.zeros(h), rng.normal(0, 1 / np.sqrt(h), (h, 1)), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in net], [np.zeros_like(a) for a in net]

    def grads(x, slope):
        hidden, _ = x_hidden[id(x)]
        g2 = hidden.T @ slope
        back = slope @ net[2].T * (1 - hidden**2)
        return [x.T @ back, back.sum(0), g2, slope.sum(0)]

    for i in range(1, rounds + 1):
        x_hidden = {id(p): _net(p, net), id(u): _net(u, net)}
        sp, su = (1 / (1 + np.exp(-np.clip(x_hidden[id(x)][1], -30, 30))) for x in (p, u))
        risk_minus = su.mean() - prior * sp.mean()  # sigmoid loss of calling these negative: P(+)
        d_p, d_u = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
        if risk_minus >= 0:
            g = [a + b for a, b in zip(grads(p, -2 * prior * d_p), grads(u, d_u))]
        else:  # step back: the negative part has been fitted below zero
            g = [-(a + b) for a, b in zip(grads(p, -prior * d_p), grads(u, d_u))]
        for k in range(4):
            g[k] = g[k] + 1e-4 * net[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
            net[k] = net[k] - 0.01 * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
    return {"net": net, "mean": mean, "spread": spread, "prior": prior}


def probabilities(column, model: dict):
    import numpy as np

    if model["net"] is None:
        return np.full(len(column), 0.5)
    x = np.clip((text_features(column) - model["mean"]) / model["spread"], -6, 6)
    return 1 / (1 + np.exp(-np.clip(_net(x, model["net"])[1][:, 0], -30, 30)))


def _feature_rows(batches):
    import pyarrow as pa

    from . import words

    for batch in batches:
        x = text_features(words.binary(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "positive", "x"])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict:
    import numpy as np

    spark = docs.sparkSession
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) != 1)).select("doc_id").distinct()
    least = lambda d, seed, n: [r[0] for r in d.where("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n).collect()]
    rows = [(i, 1) for i in least(good.join(docs.select("doc_id"), "doc_id", "left_semi"), 1, positives)] + [(i, 0) for i in least(docs.select("doc_id").distinct(), 2, unlabelled)]
    if not rows:
        return fit([], [])
    small = spark.createDataFrame(rows, docs.select("doc_id").schema.add("positive", T.IntegerType()))
    # one text of each doc_id, so that a repeated one stays within the bounds
    picked = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(small), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    found = picked.mapInArrow(_feature_rows, docs.select("doc_id").schema.add("positive", T.IntegerType()).add("x", T.ArrayType(T.DoubleType()))).collect()
    found.sort(key=lambda r: (r[1], r[0]))
    x, y = np.array([r[2] for r in found]), np.array([r[1] for r in found])
    return fit(x[y == 1], x[y == 0]) if len(found) else fit([], [])


def _score(shared):
    def run(batches):
        import pyarrow as pa

        from . import words

        for batch in batches:
            p = probabilities(words.binary(batch.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_score(shared), "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
