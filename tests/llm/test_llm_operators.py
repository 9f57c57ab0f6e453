"""The training-data operators against brute force, and on nulls, ties, repeated rows, long texts, empty tables and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from leadloom.llm import archives, decontamination, media, mixing, quality, registry, sharding, simhash, suffix_dedup, toxicity, url_filters

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, n int, stack string"


def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, names that clash with those used inside."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a", 3, "x", 1, "s"),
        (2, "the quick brown fox jumps over the lazy dog again and again today", "en", "a", 3, "x", 1, "s"),
        (3, None, None, None, None, None, None, None), (4, "", "en", "", 0, "", 0, ""), (4, "", "en", "", 0, "", 0, ""),
        (5, " \t\n ", "en", "b", 4, "x", 1, "s"), (6, "one", "en", "b", 3, "x", 1, "s"), (7, "two words", "en", "b", 9, "x", 1, "s"),
        (None, "a text without an id but with words", "en", "b", 1, "x", 1, "s"), (8, long, "en", "c", 9, "x", 1, "s"), (9, long, "en", "c", 9, "x", 1, "s"),
        (10, "ünïcödé \U0001f600 text " * 40, "de", "c", 9, "x", 1, "s"), (11, "ab" * 5000, "xx", "c", 9, "x", 1, "s"),
    ]
    return spark.createDataFrame(rows, DOCS)


def docs_of(spark, n=None):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    return d.where(f"doc_id < {n}") if n else d


def pairs_of(df):
    return [(r["doc_id"], (r["text"] or "").encode()) for r in df.select("doc_id", "text").collect()]


# op1


def test_url_parts_and_rules(spark):
    rows = [
        (1, "http://WWW.Example.ORG/es/a?x#y"), (2, "https://example.org/en/12"), (3, "http://org/"), (4, "http://org"), (5, "x://a.com/fr/b"), (6, "x://b.a.com/de/"),
        (7, "no scheme"), (8, None), (None, "http://example.org?q"), (9, "http://notexample.org/es/"), (9, "http://notexample.org/es/"), (10, "http://example-x.org/es/"),
        (11, "://"), (12, "http://a.b.example.org/es/"), (13, "http://com/de/x"), (14, "http://..org/"), (15, "a://b://c/d\n/e"), (16, "http://ÄÖ.com/fr/"), (17, "http://xcom/fr/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as stack", "1 as kind", "'h' as host", "2 as salt")
    got = sorted(map(str, url_filters.judge_urls(pages, url_filters.rules_frame(spark)).collect()))
    want = []
    for i, url in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            k = next((j for j, c in enumerate(rest) if c in "/?#"), len(rest))
            host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k]), rest[k:]
            path = rest[: next((j for j, c in enumerate(rest) if c in "?#"), len(rest))]
        fit = [(len(h + p), len(h), h + p, a) for a, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        want.append((i, host, path, best and best[2], best[3] if best else "allow"))
    names = ("page_id", "host", "path", "rule", "verdict")
    assert got == sorted(f"Row({', '.join(f'{n}={v!r}' for n, v in zip(names, w))})" for w in want)
    assert url_filters.judge_urls(pages.limit(0), url_filters.rules_frame(spark)).count() == 0
    none = url_filters.judge_urls(pages, url_filters.rules_frame(spark).limit(0)).collect()
    assert len(none) == len(rows) and {r["rule"] for r in none} == {None}


def test_nested_rules(spark):
    rules = spark.createDataFrame([("block", "a.b.c", "/"), ("allow", "b.c", "/x"), ("block", "c", "/x/y/zzzzzzzz"), ("allow", "c", "/"), ("block", "c", "/")], "action string, host string, path string")
    pages = spark.createDataFrame([(1, "q://z.a.b.c/x"), (2, "q://b.c/x/y/zzzzzzzz1"), (3, "q://d.c/q"), (4, "q://b.c/q"), (5, "q://bb.c/x")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages, rules).collect()}
    assert got == {1: ("a.b.c/", "block"), 2: ("c/x/y/zzzzzzzz", "block"), 3: ("c/", "block"), 4: ("c/", "block"), 5: ("c/", "block")}


# op2


def test_archives(spark):
    big = "x" * 1500
    rows = [(1, "http://a/ b\n", big), (2, None, big), (7, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", "no key"), (6, "u", "é" * 600 + "\r\n\r\nWARC/1.0\r\n"), (7, "u", big), (-3, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "1 as key", "'p' as payload").repartition(3)
    from leadloom.llm.common import fresh_path

    files = archives.convert_archives(archives.pages_to_arc(pages), fresh_path(spark, "t"), most=1000)
    got = sorted((r["key"] is None, r["key"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in archives.read_archives(files).collect())
    want = []
    for i, _, html in rows:
        p = (html or "").encode()
        revisit = html == big and i != 7
        want.append((i is None, i or 0, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None))
    assert got == sorted(want, key=lambda x: (x[:5], x[5] or 0))
    empty = archives.convert_archives(archives.pages_to_arc(pages.limit(0)), fresh_path(spark, "t"))
    assert archives.read_archives(empty).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    rows = [(i, f"http://h/{i} x", bytes([i]) * (i * 7) + b"\r\n\r\nfiledesc: x\n") for i in range(20)] + [(None, None, b"")]
    back = list(archives.parse_arc(archives.arc_file(rows, version)))
    assert [(archives.header_key(r.header), r.payload) for r in back] == [(k, p) for k, _, p in rows]
    assert back[3].url == "http://h/3%20x" and back[-1].url == "urn:x-no-url"
    whole = archives.arc_file(rows[:3], version)
    for bad in (whole[:-10], b"http://x 0 0 0 5\nabcde\n", whole.replace(b"\n%d 0 lead" % version, b"\n9 0 lead", 1)):
        with pytest.raises(ValueError):
            list(archives.parse_arc(bad))


@pytest.mark.parametrize("key", [0, 1, -1, 2**63 - 1, -(2**63), None])
def test_record_ids(key):
    assert archives.record_key(archives.record_id(key)) == key


# op3


def brute_repeats(texts):
    where = defaultdict(set)
    for k, t in enumerate(texts):
        for s in range(len(t) - 199):
            where[t[s : s + 200]].add((k, s))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - 199):
            if len(where[t[s : s + 200]]) > 1:
                gone[s : s + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 40, 200])
@pytest.mark.parametrize("letters", [1, 2, 5])
def test_suffix_ranks(n, letters):
    import numpy as np

    s = np.random.default_rng(n).integers(1, letters + 1, n)
    order = sorted(range(n), key=lambda i: tuple(s[i:]))
    ranks = suffix_dedup.suffix_ranks(s, 9)
    assert [ranks[i] for i in order] == list(range(n))


@pytest.mark.parametrize("hot", [1, 512])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choices(words, k=k))
    passage, line = prose(60), prose(30)
    texts = [prose(rng.randint(1, 150)) for _ in range(40)] + [prose(20) + passage + prose(20) for _ in range(8)] + [prose(40) + line + prose(3) for _ in range(6)]
    base = prose(300)
    texts += [base, base, base[:700] + "Z" + base[701:], base[:900], "ab" * 400, "ab" * 300 + "c", "x" * 200, "x" * 201, "x" * 199, passage[:200], passage[:199], "é" * 150, "", None, prose(30) * 4]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[45]), (46, texts[46]), (46, texts[46]), (7, prose(90)), (None, prose(9) + passage), (None, prose(9) + passage), (None, prose(5) + line + prose(7))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as h", "2L as anchor", "3 as n", "'z' as sha").repartition(5)
    plain = lambda i: -1 if i is None else i
    got = sorted((plain(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == sorted((plain(i), *x) for (i, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows])))
    alone = spark.createDataFrame([(1, passage), (None, "so " + passage)], "doc_id long, text string")
    assert all(r["n_removed"] >= len(passage) - 1 for r in suffix_dedup.remove_repeats(alone).collect())
    assert sum(x[2] for x in got) > 5000
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_repeats_of_the_table(spark):
    rows = sorted(pairs_of(docs_of(spark)))
    got = sorted(tuple(r) for r in suffix_dedup.op3(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == [(i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows]))]


# op4


def brute_simhash(rows):
    import xxhash

    prints = []
    for _, t in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t.decode()).translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ")
        words = [w for w in words if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = d if low.get(r) is None else min(low[r], d if d is not None else low[r])
    return [(d, f"{prints[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("leaf", [1, 1024])
def test_simhash_against_brute_force(spark, monkeypatch, leaf):
    base = [(i, t) for i, t in pairs_of(docs_of(spark, 80))]
    more = [(1000 + 10 * i + k, t + b" tail%d" % k) for i, t in base[:40] for k in range(3)]
    odd = [(5000 if i is None else 4000 + i, t) for i, t in pairs_of(odd_docs(spark)) if len(t) < 9000]
    rows = base + more + odd + base[:2]
    df = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as low")
    link = simhash.link_fingerprints
    monkeypatch.setattr(simhash, "link_fingerprints", lambda d, budget: link(d, budget, leaf=leaf))
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(df).collect())
    assert got == sorted(brute_simhash(rows))


def test_simhash_odd(spark):
    got = simhash.simhash_components(odd_docs(spark)).collect()
    assert len(got) == 13 and {r["fingerprint"] for r in got if r["doc_id"] in (3, 4, 5)} == {"0" * 16}
    assert simhash.simhash_components(odd_docs(spark).limit(0)).count() == 0


def test_trie_pairs():
    rng = random.Random(1)
    for budget in (0, 1, 2, 3):
        centres = [rng.getrandbits(64) for _ in range(5)]
        values = sorted(rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for _ in range(150))
        want = {(i, j) for i in range(150) for j in range(i + 1, 150) if (values[i] ^ values[j]).bit_count() <= budget}
        got = list(simhash.trie_pairs(values, budget))
        assert set(got) == want and len(got) == len(want)


def test_near_duplicates(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    rows, expected = [], {}
    for g in range(60):
        base = rng.choices(words, k=rng.randint(120, 600))
        rows.append((g * 100, " ".join(base)))
        for k in range(1, 4):
            copy = list(base)
            for _ in range(max(1, len(base) // 120)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            a, b = simhash.shingle_set(" ".join(base).encode()), simhash.shingle_set(" ".join(copy).encode())
            rows.append((g * 100 + k, " ".join(copy)))
            expected[g * 100 + k] = simhash.jaccard(a, b) >= 0.8
    rows += [(90_000 + i, rows[i * 4][1]) for i in range(5)] + [(0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as digest", "1 as words")
    kept = sorted(r["doc_id"] for r in simhash.deduplicate(df).collect())
    near = [i for i, x in expected.items() if x]
    assert len(near) > 100 and sum(i in kept for i in near) <= 0.03 * len(near)
    assert all(g * 100 in kept for g in range(60)) and not any(i >= 90_000 for i in kept) and len(kept) == len(set(kept))
    odd = simhash.deduplicate(odd_docs(spark))
    assert odd.columns == odd_docs(spark).columns
    assert sorted(r["doc_id"] or 0 for r in odd.collect()) == [0, 1, 3, 5, 6, 7, 8, 10, 11]
    assert simhash.deduplicate(odd_docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("size", [60, 200])
def test_near_duplicates_with_a_block_of_new_words(spark, size):
    rng = random.Random(size)
    rows, near = [], []
    for g in range(120):
        base = [f"b{g}x{i}" for i in range(size)]
        new = [f"n{g}x{i}" for i in range(round(size * rng.uniform(0.1, 0.24)))]
        copy = base + new if g % 2 else base[: size // 2] + new + base[size // 2 :]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        if simhash.jaccard(*(simhash.shingle_set(" ".join(x).encode()) for x in (base, copy))) >= 0.8:
            near.append(2 * g + 1)
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) >= 60 and kept == set(range(240)) - set(near)


def test_near_duplicates_of_repeated_text(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, text), (2, " ".join([text] * 4)), (3, "something else " + text[:200])]
    assert sorted(r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 3]


def test_near_duplicates_without_ids(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(None, " ".join(base)), (None, " ".join(base + ["more"])), (7, " ".join(["first", *base])), (None, "apart from all the others here"), (None, "apart from all the others here")]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["7", "None"]
    assert {r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {7, None}


def test_near_duplicates_of_many_copies(spark):
    """A large group of equal texts doesn't change which others are near."""
    rng = random.Random(17)
    base = [f"w{i}" for i in range(250)]
    copies = []
    for k in range(300):
        copy = list(base)
        for _ in range(rng.randrange(3, 10)):
            copy[rng.randrange(250)] = f"n{rng.randrange(10**6)}"
        copies.append(" ".join(copy))
    rows = list(enumerate([" ".join(base)] * 500 + copies))
    sets = {t: simhash.shingle_set(t.encode()) for _, t in rows}
    texts = list(sets)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if simhash.jaccard(sets[texts[i]], sets[texts[j]]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted(min(k for k, t in rows if t == texts[i]) for i in range(len(texts)) if find(i) == i)
    assert 1 < len(want) < 200
    assert sorted(r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_trie_join_and_overlaps():
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.integers(0, 256, (6, 32), dtype=np.uint8)
    flips = lambda n: np.packbits(rng.random((n, 256)) < 0.08, axis=1)
    left, right = (centres[rng.integers(0, 6, n)] ^ flips(n) for n in (70, 90))
    left[3] = left[4] = right[5] = right[6]
    want = {(i, j) for i in range(70) for j in range(90) if np.bitwise_count(left[i] ^ right[j]).sum() <= 44}
    got = list(zip(*(x.tolist() for x in simhash.trie_join(left.view(np.uint16), right.view(np.uint16), 44))))
    assert set(got) == want and len(got) == len(want) and 500 < len(want) < 6000
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 3000)).astype(np.uint64)) for _ in range(20)]
    assert simhash.overlaps(sets[:8], sets[8:]).tolist() == [[len(np.intersect1d(x, y)) for y in sets[8:]] for x in sets[:8]]


@pytest.mark.parametrize("unit", [3, 512])
def test_near_duplicates_in_crowded_keys(spark, monkeypatch, unit):
    """Many groups that share most of their text: the keys of all of them meet, and only pairs within some groups are near."""
    monkeypatch.setattr(simhash, "UNIT", unit)
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(220)]
    rows = []
    for g in range(60):
        own = [f"g{g}x{i}" for i in range(60)]
        rows += [(10 * g + k, " ".join(shared + own[: 60 - rng.randrange(8)] + [f"k{g}x{k}x{i}" for i in range(rng.randrange(12))])) for k in range(3)]
    rng.shuffle(rows)
    ids = sorted(i for i, _ in rows)
    sets = {i: simhash.shingle_set(t.encode()) for i, t in rows}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and simhash.jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = [i for i in ids if find(i) == i]
    assert 60 <= len(want) < 120
    assert sorted(r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


# op5


def test_media(spark):
    rows = pairs_of(docs_of(spark)) + pairs_of(odd_docs(spark))
    df = docs_of(spark).select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text")).selectExpr("*", "'x' as shard", "1 as offset", "'y' as digest")
    from leadloom.llm.common import fresh_path

    index = media.store(df, fresh_path(spark, "m"), most=50_000)
    got = media.with_payloads(media.with_metadata(index)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = []
    for i, t in rows:
        p = t + b" " * (max(1, -(-len(t) // 192)) * 192 - len(t))
        want.append((i, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["width"] == 192 and r["height"] * 192 == r["payload_bytes"] for r in got)
    by = defaultdict(set)
    for r in got:
        by[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in by.values())
    # a shard is a tar archive whose members are named by digest
    import tarfile

    shard = got[0]["shard"].removeprefix("file://")
    with tarfile.open(shard) as t:
        for m in t.getmembers()[:5]:
            data = t.extractfile(m).read()
            assert hashlib.sha256(media.decode(data)).hexdigest() + ".png" == m.name
    assert media.store(df.limit(0), fresh_path(spark, "m")).count() == 0


# op6


def test_sharding(spark):
    df = docs_of(spark).select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text")).selectExpr("*", "'x' as shard", "1 as size")
    got = sharding.assign_shards(df, buckets=16).collect()
    assert len(got) == df.count()
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    texts = Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in pairs_of(df))
    assert texts == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    import math
    import struct

    import xxhash

    def draw(doc, name, weight):  # the same hash as the engine's: of the id, then of the name with the id's hash as seed
        h = xxhash.xxh64_intdigest(name.encode(), xxhash.xxh64_intdigest(struct.pack("<q", doc), 42))
        return math.log(((h >> 11) + 1) / 2**53) / weight

    for r in got:
        if r["doc_id"] is not None:
            tree = sharding.TREE
            region = max(tree, key=lambda n: draw(r["doc_id"], n, 4.0))
            rack = max(tree[region], key=lambda n: draw(r["doc_id"], n, 2.0))
            assert r["shard"] == max((s for s, _ in tree[region][rack]), key=lambda s: draw(r["doc_id"], f"shard{s}", 1.0))
    big = spark.range(20_000).selectExpr("id as doc_id", "'t' as text")
    sizes = Counter(r["shard"] for r in sharding.assign_shards(big).collect())
    assert len(sizes) == 8 and max(sizes.values()) < 1.1 * min(sizes.values())
    assert sharding.assign_shards(df.limit(0)).count() == 0


# op7, op8


def test_toxicity_finds_gapped_insults(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("aeiourstnlmdc", k=rng.randint(2, 8))) for _ in range(800)]
    rows, labels = [], []
    for i in range(900):
        text = rng.choices(words, k=rng.randint(20, 80))
        bad = i % 4 == 0
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["zubbrax", "vorkel", "quimpst"]))
        rows.append((i, " ".join(text) + "."))
        labels.append((i, 1, int(bad)))
    rows += [(2000, words[1] + " zub-brax " + words[2]), (2001, words[3] + " v o r k e l " + words[4]), (2002, words[5] + " qu.im.pst"), (2003, " ".join(words[:60])), (2004, None), (2005, ""), (2006, "zubbrax " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as label", "0.5 as score")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert [got[i]["predicted"] for i in range(2000, 2007)] == [1, 1, 1, 0, 0, 0, 1]
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())
    assert toxicity.score_documents(df.limit(0), model).count() == 0
    none = toxicity.train(df, lab.limit(0))
    assert {r["score"] for r in toxicity.score_documents(df, none).collect()} == {0.0}
    assert len(toxicity.score_documents(odd_docs(spark), model).collect()) == 13


def plain_kernel(word: bytes) -> dict:
    """The triples of a framed word, as written in the docstring: weights by span, normalised by length."""
    letters = toxicity.letter_classes()
    framed = [0, *(int(letters[x]) for x in word), 0]
    out, total = defaultdict(float), 0.0
    for i in range(len(framed)):
        for b in range(2, toxicity.SPAN + 1):
            for a in range(1, b):
                if i + b < len(framed):
                    out[framed[i] << 10 | framed[i + a] << 5 | framed[i + b]] += toxicity.DECAY ** (b + 1)
                    total += toxicity.DECAY ** (2 * (b + 1))
    norm = max(total, toxicity.DECAY**6) ** 0.5
    return {k: v / norm for k, v in out.items()}


def plain_words(text: bytes) -> list[bytes]:
    out, last = [], None
    for m in re.finditer(rb"[^\t\n\x0b\x0c\r ]+", text):
        single = m.end() - m.start() == 1
        if single and last and last[2] and m.start() - last[1] == 1:
            out[-1] = text[last[0] : m.end()]
            last = (last[0], m.end(), True)
        else:
            out.append(m[0])
            last = (m.start(), m.end(), single)
    return out


def test_toxicity_scores_against_plain_python():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(7)
    weights = np.random.default_rng(3).normal(0, 1, 1 << 15).astype(np.float32)
    words = ["".join(rng.choices("abcdeiot!-.1é", k=rng.randint(1, 12))) for _ in range(60)] + ["i d i o t", "x" * 300]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))).encode() for _ in range(80)] + [b"", b" \n ", None]
    bare = lambda w: bytes(x for x in w if toxicity.letter_classes()[x] not in (0, 31))
    one = lambda w: sum(float(weights[k]) * v for k, v in plain_kernel(w).items()) - 0.5
    want = [max([max(one(w), one(bare(w)) if 0 < len(bare(w)) < len(w) else -99) for w in plain_words(t or b"")], default=toxicity.NO_WORDS) for t in texts]
    got = toxicity.text_scores(pa.array(texts, pa.binary()), weights, -0.5)
    assert np.abs(got - want).max() < 1e-4
    rows, codes, values = toxicity.features([w.encode() for w in words[:20]])
    for k, w in enumerate(words[:20]):
        mine = defaultdict(float)
        for c, v in zip(codes[rows == k].tolist(), values[rows == k].tolist()):
            mine[c] += v
        want = plain_kernel(w.encode())
        assert mine.keys() == want.keys() and all(abs(mine[c] - want[c]) < 1e-9 for c in want)


def test_sentences(spark):
    import numpy as np

    text = "All is well. you are an idiot! Bye\nnew line\n\nlast"
    model = {"weights": np.random.default_rng(1).normal(0, 1, 1 << 15).astype(np.float32), "bias": 0.1, "slope": 1.5, "offset": -0.3, "constant": None}
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "one")], "doc_id long, text string")
    rows = toxicity.score_sentences(df, model).collect()
    assert [text.encode()[r["begin"] : r["end"]].decode() for r in rows if r["doc_id"] == 1] == ["All is well.", "you are an idiot!", "Bye", "new line", "last"]
    whole = {r["doc_id"]: r["score"] for r in toxicity.score_documents(df, model).collect()}
    assert abs(whole[1] - max(r["score"] for r in rows if r["doc_id"] == 1)) < 1e-12 and len(rows) == 6


def test_quality_scores_and_risk_against_plain_python():
    import math

    import numpy as np
    import pyarrow as pa

    texts = [b"Hello world. Hello again, world 123!", b"", "Zoë über\n\nx x x".encode(), b"%%% ### \t a"]
    x = quality.text_features(pa.array(texts, pa.binary()))
    for row, t in zip(x, texts):
        words = t.split()
        share = lambda f: sum(map(f, t)) / max(1, len(t))  # noqa: E731, B023
        assert abs(row[0] - share(lambda b: 97 <= b <= 122)) < 1e-12 and abs(row[1] - share(lambda b: 65 <= b <= 90)) < 1e-12 and abs(row[12] - share(lambda b: b >= 128)) < 1e-12
        assert abs(row[13] - math.log1p(len(t))) < 1e-12 and abs(row[14] - math.log1p(len(words))) < 1e-12
        if words:
            assert abs(row[15] - sum(map(len, words)) / len(words)) < 1e-9 and abs(row[18] - len({w.lower() for w in words}) / len(words)) < 1e-12
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1, 1, (300, quality.FEATURES)), rng.normal(-1, 1, (500, quality.FEATURES))
    model = quality.fit(good, np.vstack([good[:200] + rng.normal(0, 0.1, (200, quality.FEATURES)), bad]))
    assert abs(model["prior"] - 200 / 700) < 0.1
    # the forward pass, number by number
    w1, b1, w2, b2 = (a.tolist() for a in model["net"])
    for row, p in zip(x, quality.probabilities(pa.array(texts, pa.binary()), model)):
        z = [max(-6, min(6, (v - m) / s)) for v, m, s in zip(row, model["mean"].tolist(), model["spread"].tolist())]
        hidden = [math.tanh(sum(a * w1[i][j] for i, a in enumerate(z)) + b1[j]) for j in range(len(b1))]
        assert abs(p - 1 / (1 + math.exp(-(sum(a * w2[j][0] for j, a in enumerate(hidden)) + b2[0])))) < 1e-9
    sigmoid = lambda rows: 1 / (1 + np.exp(-quality._net(np.clip((rows - model["mean"]) / model["spread"], -6, 6), model["net"])[1][:, 0]))
    # calling a positive negative costs P(+); the fitted non-negative risk is near that of the true classes
    assert sigmoid(good).mean() > 0.9 and sigmoid(bad).mean() < 0.1


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()}
    got = quality.op8(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.93 * len(held)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    odd = quality.score_documents(odd_docs(spark), model).collect()
    assert len(odd) == 13 and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.score_documents(docs.limit(0), model).count() == 0
    none = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet").limit(0))
    assert {r["score"] for r in quality.score_documents(odd_docs(spark), none).collect()} == {0.5}


# op9


def test_contamination_against_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(900)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 6, 12, 20, 40, 90, 200])))) for i in range(80)] + [(80, None), (81, ""), (82, "  "), (0, "repeated id " + words[3])]
    rows = []
    for i in range(200):
        t = rng.choices(words, k=rng.choice([0, 3, 50, 400, 3000]))
        for _ in range(rng.randrange(3)):
            item = (rng.choice(items)[1] or "").split()
            if rng.random() < 0.3 and len(item) > 10:  # the item in two pieces
                cut = len(item) // 2
                t[0:0] = item[:cut]
                item = item[cut:]
            at = rng.randrange(len(t) + 1)
            t[at:at] = [w.upper() for w in item]
        rows.append((i, " ".join(t)))
    rows += [(500, items[0][1]), (501, items[1][1]), (501, items[1][1]), (502, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as shared")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'e' as doc_id")
    got = sorted(tuple(r) for r in decontamination.contamination(df, bench).collect())
    want = []
    for i, t in rows:
        own = decontamination.byte_shingles((t or "").encode())
        for k, s in items:
            mine = decontamination.byte_shingles((s or "").encode())
            if mine and len(mine & own) >= 0.8 * len(mine):
                want.append((i, k, len(mine), len(mine & own), len(mine & own) / len(mine)))
    assert got == sorted(want) and len(want) > 80
    bad = {x[0] for x in want}
    assert sorted(r["doc_id"] for r in decontamination.drop_contaminated(df, bench).collect()) == sorted(i for i, _ in rows if i not in bad)
    assert decontamination.contamination(df.limit(0), bench).count() == 0 and decontamination.contamination(df, bench.limit(0)).count() == 0
    assert len(decontamination.drop_contaminated(odd_docs(spark), bench).collect()) >= 10


def test_items_of_one_shingle_are_always_found():
    import pyarrow as pa

    texts = [" ".join([f"d{d}a{i}" for i in range(30)] + ["a", "five", "word", "item", "here"] + [f"d{d}b{i}" for i in range(30)]).encode() for d in range(3000)]
    items = decontamination.Items([(7, b"a five word item here")])
    assert sorted(decontamination.contained(pa.array(texts, pa.binary()), items)) == [(d, 0, 1, 1) for d in range(3000)]


def test_item_blocks(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    blocks = list(decontamination.item_blocks(bench, 2000))
    assert len(blocks) > 2 and sorted(i for b in blocks for i, _ in b) == sorted(r[0] for r in bench.select("item_id").collect())


# op10


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, rng.choices(["a", "b", "c", None, ""], [60, 25, 10, 3, 2])[0]) for i in range(6000)] + [(0, "a"), (0, "a"), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "'x' as block", "1 as n", "'w' as weight")
    weights = spark.createDataFrame([("a", 0.3), ("b", 0.45), ("c", 0.2), (None, 0.03), ("", 0.02)], "source string, weight double")
    got = mixing.mix(df, weights, resolution=100, block_rows=4).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows)
    target = {"a": 0.3, "b": 0.45, "c": 0.2, None: 0.03, "": 0.02}
    order = [r["source"] for r in sorted(got, key=lambda r: r["position"])]
    left, have = Counter(s for _, s in rows), Counter()
    for k, s in enumerate(order, 1):
        have[s] += 1
        if k % 4 == 0:
            for x, w in target.items():
                assert abs(have[x] - w * k) < 4 + 1e-9, (k, x)
        if have[s] == left[s]:
            break
    assert k > 2000
    for r in got:
        w = round(100 * target[r["source"]])
        assert r["release"] == r["block"] * 100 // w and r["deadline"] == -(-(r["block"] + 1) * 100 // w)
    assert mixing.mix(df.limit(0)).count() == 0
    odd = odd_docs(spark)
    ordered = mixing.in_mixed_order(odd)
    assert ordered.columns == odd.columns and Counter(map(str, ordered.collect())) == Counter(map(str, odd.collect()))


def test_mixing_keeps_to_the_true_targets(spark):
    sizes = {f"s{i:02d}": n for i, n in enumerate([4000] + [4] * 1100)}
    df = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    got = mixing.mix(df, block_rows=4).orderBy("position").collect()
    total = sum(n**0.5 for n in sizes.values())
    weight = 4000**0.5 / total
    first = [r for r in got if r["source"] == "s00"]
    assert sorted(r["block"] for r in first) == sorted(list(range(1000)) * 4)
    for r in first:  # the windows are those of the exact weight
        assert abs(r["release"] - r["block"] / weight) <= 0.5 / weight + 1 and abs(r["deadline"] - (r["block"] + 1) / weight) <= 0.5 / weight + 1
    have = 0
    for k, r in enumerate(got[: 4 * 1100], 1):
        have += r["source"] == "s00"
        assert abs(have - weight * k) < 4 + 1e-9


def edf(sources, total):
    """The plain loop: at each slot, of the released blocks the one with the earliest deadline, then the smallest source."""
    had, slots, t = [0] * len(sources), [], 0
    while any(h < b for h, (_, b) in zip(had, sources)):
        open_ = [(-(-(h + 1) * total // a), k) for k, (h, (a, b)) in enumerate(zip(had, sources)) if h < b and h * total // a <= t]
        if open_:
            k = min(open_)[1]
            slots.append((k, had[k], t))
            had[k] += 1
        t += 1
    return slots


def sources_frame(spark, sources):
    return spark.createDataFrame([(False, f"s{k:04d}", float(a), b * 4 - k % 3) for k, (a, b) in enumerate(sources)], "s_null boolean, s_name string, weight double, rows long")


def test_schedule_of_one_frame_is_plain_edf(spark):
    rng = random.Random(12)
    for _ in range(4):
        a = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        sources = [(x, max(1, 60 * x // sum(a) - rng.randrange(2))) for x in a]
        want = edf(sources, sum(a))
        if want[-1][2] >= mixing.FRAME:
            continue
        got = mixing.schedule(sources_frame(spark, sources), sum(a), 4).collect()
        assert sorted((int(r["s_name"][1:]), r["block"], r["slot"]) for r in got) == sorted(want)


@pytest.mark.parametrize("sources", [
    [(5, 400), (3, 100), (1, 90), (1, 2)], [(1000, 700)] + [(1, 1 + k % 3) for k in range(300)], [(1, 1)] * 200, [(10**9, 50), (1, 40)], [(7, 1)],
])
def test_schedule_keeps_all_windows(spark, sources):
    total = sum(a for a, _ in sources)
    got = mixing.schedule(sources_frame(spark, sources), total, 4).collect()
    assert sorted((int(r["s_name"][1:]), r["block"]) for r in got) == [(k, i) for k, (_, b) in enumerate(sources) for i in range(b)]
    assert len({r["slot"] for r in got}) == len(got)
    before = 0
    for r in sorted(got, key=lambda r: r["slot"]):
        a, b = sources[k := int(r["s_name"][1:])]
        assert r["release"] == r["block"] * total // a <= r["slot"] < r["deadline"] == -(-(r["block"] + 1) * total // a)
        assert r["first"] == before
        before += min(4, b * 4 - k % 3 - 4 * r["block"])


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_small_batches_leave_the_session_as_it_was(spark):
    from leadloom.llm.common import small_batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        with pytest.raises(RuntimeError), small_batches(spark):
            assert spark.conf.get(name) == "1000"
            raise RuntimeError
        assert spark.conf.get(name, None) is None
        spark.conf.set(name, 77)
        with small_batches(spark):
            assert spark.conf.get(name) == "77"
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.unset(name)
        if before is not None:
            spark.conf.set(name, before)


def lines_between_noise(n=20_000, planted=200):
    """A 64-byte line between random bytes, n times, and passages of 324 bytes that come twice: many contexts of one anchor."""
    rng = random.Random(11)
    line = bytes(rng.randrange(97, 123) for _ in range(64))
    parts = [bytes(rng.choices(range(33, 127), k=140)) + line for _ in range(n)]
    for i in rng.sample(range(0, n - 10, 5), planted):
        at = rng.randrange(len(parts))
        parts[at] = parts[at] + (parts[i] + parts[i + 1])[:324]
    return parts


def removed_by_names(texts):
    """Bytes removed of each text, from two hashes of every window."""
    import numpy as np

    data = [np.frombuffer(t, np.uint8) for t in texts]
    names = [np.stack([suffix_dedup.rolling(d, suffix_dedup.LENGTH, seed) for seed in (0, 5)], 1) for d in data]
    _, back, count = np.unique(np.concatenate(names), axis=0, return_inverse=True, return_counts=True)
    again, out, at = count[back.ravel()] > 1, [], 0
    for d, x in zip(data, names):
        edge = np.zeros(len(d) + 1, np.int64)
        hit = np.flatnonzero(again[at : at + len(x)])
        edge[hit] += 1
        np.add.at(edge, hit + suffix_dedup.LENGTH, -1)
        out.append(int((np.cumsum(edge)[:-1] > 0).sum()))
        at += len(x)
    return out


@pytest.mark.parametrize("documents", [1, 600])
def test_suffix_dedup_of_many_contexts(spark, documents):
    """One anchor with more contexts than one sort can take, in one text or over many."""
    parts = lines_between_noise()
    step = -(-len(parts) // documents)
    texts = [b"".join(parts[i : i + step]) for i in range(0, len(parts), step)]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = removed_by_names(texts)
    assert sum(want) > 100_000
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).select("doc_id", "n_removed").collect()} == dict(enumerate(want))


def test_suffix_ranks_refuse_what_overflows():
    import numpy as np

    with pytest.raises(OverflowError):
        suffix_dedup.suffix_ranks(np.arange(1, 3_000_000, dtype=np.int64))
