"""Ranked search, the filter audit and token counts against plain Python, and on nulls, ties, repeated rows, long texts, empty tables and extra columns."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from leadloom.llm import filter_audit, lexical_search, registry, token_counts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, row long, part string, mask int, n int, term string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, names that clash with those used inside."""
    rng = random.Random(3)
    long = " ".join(rng.choice("alpha beta gamma ÉTÉ été delta x1 日本 ▁ # a-b".split()) for _ in range(30_000))
    rows = [
        (1, "Alpha beta gamma", "en"), (2, "alpha BETA gamma", "en"), (3, None, None), (4, "", "en"), (4, "", "en"), (5, " \t\n ", "de"), (6, "alpha", "en"), (7, "alpha", "de"), (7, "alpha", "de"),
        (None, "alpha", "en"), (None, "alpha", None), (None, None, "en"), (8, long, "en"), (9, long, ""), (10, "ünï\U0001f600 #text " * 80, "de"), (11, "ab" * 5000, "xx"), (12, "AB CD " * 300, "en"),
        (13, "delta " * 10 + "alpha", "en"), (0, "alpha", "fr"), (14, "a\x00b \x0b c <s> </s> <unk> <0x0A>", "fr"),
    ]
    return spark.createDataFrame([(*r, "s", 1, "p", 2, 3, "t") for r in rows], DOCS)


def small_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


# op11


def plain_search(docs, items, k=10):
    words = [(i, TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))) for i, t in docs if t is not None]
    held = [(i, w) for i, w in words if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    index = defaultdict(list)
    for at, (_, w) in enumerate(held):
        for t, tf in Counter(w).items():
            index[t].append((at, tf))
    out = []
    for item, text in sorted({x for x in items if x[0] is not None and x[1] is not None}):
        scores = Counter()
        for t in TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)):
            for at, tf in index[t]:
                m = 25 + 75 * len(held[at][1]) * n // total
                scores[at] += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
        ranked = sorted((-s, held[at][0] is None, held[at][0] or 0) for at, s in scores.items() if s > 0)[:k]
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(ranked, 1)]
    return out


@pytest.mark.parametrize("shape", [{}, {"fan": 2, "range_docs": 7}, {"fan": 3, "range_docs": 50, "range_postings": 20, "item_bytes": 2000}])
def test_search_equals_plain_ranking(spark, shape):
    docs = small_docs(spark).repartition(3)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = lexical_search.search(docs, items, **shape)
    assert sorted(pairs(got, "item_id", "rank", "doc_id", "score")) == sorted(plain_search(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text")))


@pytest.mark.parametrize("shape", [{}, {"fan": 2, "range_docs": 3}, {"range_postings": 1}])
def test_search_on_odd_rows(spark, shape):
    docs = odd_docs(spark)
    items = [(1, "alpha"), (2, "Beta alpha alpha nowhere"), (3, None), (None, "alpha"), (4, ""), (5, "-- ##"), (6, "été ÉTÉ 日本"), (6, "été ÉTÉ 日本"), (7, "ab"), (8, "a b c s unk 0x0a")]
    got = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as rank", "2 as score"), **shape)
    assert sorted(map(str, pairs(got, "item_id", "rank", "doc_id", "score"))) == sorted(map(str, plain_search(pairs(docs, "doc_id", "text"), items)))


def test_search_opens_equal_bounds(spark):
    """Many documents of one score: the smallest ids win, wherever they stand."""
    rows = [(i, "same words here" if i % 3 else "other") for i in random.Random(5).sample(range(1000), 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = lexical_search.search(docs, spark.createDataFrame([(1, "words same"), (2, "other other")], "item_id long, text string"), fan=4, range_docs=64)
    assert sorted(pairs(got, "item_id", "rank", "doc_id")) == [(1, r, d) for r, d in enumerate([i for i in range(99) if i % 3][:10], 1)] + [(2, r, d) for r, d in enumerate(range(0, 30, 3), 1)]


def test_search_prunes(spark):
    """A tree's search opens fewer nodes than it has where one range holds the best documents."""
    import numpy as np

    rng = np.random.default_rng(1)
    docs, terms = 4096, 6
    doc, term = np.repeat(np.arange(docs), 3), rng.integers(0, terms, docs * 3)
    pair = np.unique(doc * terms + term)
    worth = rng.integers(1, 1000, len(pair)) + np.where(pair // terms < 64, 5000, 0)
    tree = lexical_search.Tree(pair % terms, pair // terms, worth, docs, 16)
    opened, plain = [], tree.open
    tree.open = lambda *a: opened.append(a[:2]) or plain(*a)
    weights = np.array([3, 2, 1])
    got = lexical_search.best(tree, np.arange(3), weights, [(0, i) for i in range(docs)], 10, [])
    scores = np.bincount(pair // terms, np.where(pair % terms < 3, worth * np.append(weights, [0] * 3)[pair % terms], 0), docs).astype(int)
    assert got == sorted(((int(s), (0, i)) for i, s in enumerate(scores)), key=lambda x: (-x[0], x[1]))[:10]
    assert len(opened) < 16


def test_search_without_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs, items).collect() == []
    assert lexical_search.search(small_docs(spark), items.limit(0)).collect() == []
    assert lexical_search.search(spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string"), items).collect() == []


# op12


def plain_audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    parts = defaultdict(list)
    for d, text, lang in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {f for f, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), d is not None and least[text] < d)) if x}
        parts[lang or ""].append((d, fails))
    out = []
    for part, rows in parts.items():
        shapley = Counter()
        mine = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                lost, kept = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                all_fail = [r for r in rows if f in r[1]]
                shapley[f] += len(lost)
                mine.append((part, "".join(order), step, len(kept), len(lost), len(all_fail) - len(lost), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in lost), sum(r[0] in toxic for r in lost), f))
                left = kept
        out += [(*m[:-1], shapley[m[-1]]) for m in mine]
    return sorted(out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_on_odd_rows(spark):
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, 1), (7, None, 1), (None, 1, 1), (13, 1, None), (99, 1, 1)]
    docs = odd_docs(spark)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as part", "1 as n"))
    assert sorted(pairs(got, *AUDIT)) == plain_audit(pairs(docs, "doc_id", "text", "lang"), labels)
    assert dict(got.dtypes)["kept"] == dict(got.dtypes)["shapley"] == "bigint" and dict(got.dtypes)["step"] == "int"


def test_audit_of_the_table(spark):
    labels = pairs(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "quality", "toxic")
    got = registry.QUERIES["op12_filter_audit"](spark, SF)
    assert sorted(pairs(got, *AUDIT)) == plain_audit(pairs(small_docs(spark), "doc_id", "text", "lang"), labels)


def test_audit_without_rows(spark):
    docs, labels = odd_docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    assert {r.good_lost + r.toxic_lost for r in filter_audit.audit(docs, labels).collect()} == {0}


# op13


def direct(texts):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    return [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]


def counted(docs, **more):
    rows = pairs(docs, "doc_id", "text")
    want = sorted((str(d), len((t or "").encode()), n, n > 4096) for (d, t), n in zip(rows, direct(t for _, t in rows)))
    got = token_counts.token_counts(docs, **more)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((str(a), b, c, d) for a, b, c, d in pairs(got, *got.columns)) == want


@pytest.mark.parametrize("frequent", [500_000, 1000, 0])
def test_token_counts_equal_the_library(spark, frequent):
    counted(small_docs(spark).repartition(3), frequent=frequent)


def test_token_counts_on_odd_rows(spark):
    counted(odd_docs(spark))
    counted(odd_docs(spark).limit(0))
    counted(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string"))


def test_token_counts_of_random_characters(spark, monkeypatch):
    rng = random.Random(7)
    parts = ["a", "▁", " ", "\n", "é", "日", "1", "<s>", "</s>", "<unk>", "\0", "\U0001d11e", "the", ",", "  ", "\t", "<0x0A>", "é", "ing", "\x01", "​", "ﬁ", "!!!"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(3000)]
    counted(spark.createDataFrame(rows, "doc_id long, text string"))


def test_segments_of_long_texts(monkeypatch):
    """Parts of a text end at boundaries, whatever their size."""
    own = token_counts.pieces(None)
    rng = random.Random(9)
    texts = ["".join(rng.choice(["the", " ", "ing", ",", "ñ", "Ω", "  "]) for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["a" * 500, " " * 300]
    for most in (1, 5, 64, 10_000):
        sums = Counter()
        for parts in token_counts.segments([t.encode() for t in texts], own, most):
            chars, first, end, _, text = token_counts.split(parts, own)
            for i, n in zip(text.tolist(), own.tokens([chars[a:b] for a, b in zip(first, end)])):
                sums[i] += n
        assert [sums[i] for i in range(len(texts))] == direct(texts)


def test_token_counts_of_the_table(spark):
    got = {r.doc_id: r.n_tokens for r in registry.QUERIES["op13_token_counts"](spark, SF).collect()}
    rows = pairs(small_docs(spark), "doc_id", "text")
    assert got == dict(zip((d for d, _ in rows), direct(t for _, t in rows)))
