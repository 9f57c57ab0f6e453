"""The pipeline against a brute-force version of each stage."""

import pyarrow.parquet as pq

import corpus_pipeline
from leadloom.llm import decontamination, sharding, simhash, toxicity
from leadloom.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in table(spark, SF, "documents").collect()]
    model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    toxic = {r["doc_id"] for r in toxicity.score_documents(table(spark, SF, "documents"), model).collect() if r["predicted"]}
    kept = sorted((i, t) for i, t in docs if i not in toxic)
    sets = {i: simhash.shingle_set(t.encode()) for i, t in kept}
    root = {i: i for i, _ in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, t) in enumerate(kept):
        for j, u in kept[:k]:
            if t == u or t.split() and u.split() and simhash.jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    kept = [(i, t) for i, t in kept if find(i) == i]
    items = [decontamination.byte_shingles((r["text"] or "").encode()) for r in table(spark, SF, "benchmark").collect()]
    return toxic, [i for i, t in kept if not any(m and len(m & decontamination.byte_shingles(t.encode())) >= 0.8 * len(m) for m in items)]


def test_pipeline(spark):
    toxic, want = brute(spark)
    assert toxic and len(want) < 200 - len(toxic)
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == want
    shards = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(table(spark, SF, "documents")).collect()}
    assert all(r["shard"] == shards[r["doc_id"]] for r in rows)


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "benchmark", "mixing", "sharding"]


def test_mixed_order_is_written(spark, tmp_path):
    docs = table(spark, SF, "documents")
    corpus_pipeline.mixed(spark, docs, SF).write.parquet(str(tmp_path / "m"))
    order = [i for f in sorted((tmp_path / "m").glob("part-*")) for i in pq.read_table(f).column("doc_id").to_pylist()]
    from leadloom.llm import mixing
    from pyspark.sql import functions as F

    want = [r["doc_id"] for r in mixing.mix(docs.withColumn("__h", F.xxhash64("text")), order=("doc_id", "__h")).orderBy("position").collect()]
    assert order == want


def test_slots_follow_the_mix(spark, tmp_path):
    docs = table(spark, SF, "documents")
    corpus_pipeline.mixed(spark, docs.repartition(5), SF).write.parquet(str(tmp_path / "m"))
    order = [i for f in sorted((tmp_path / "m").glob("part-*")) for i in pq.read_table(f).column("doc_id").to_pylist()]
    rows = corpus_pipeline.sharded(spark, spark.read.parquet(str(tmp_path / "m")), SF).collect()
    assert len(rows) == docs.count()
    for s in range(8):
        mine = sorted((r for r in rows if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        at = [order.index(r["doc_id"]) for r in mine]
        assert at == sorted(at)


def staged(spark, docs, sf, tmp_path):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    return docs


def test_odd_documents(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, clashing names; an item of benchmark and texts near to another go."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
    near = " ".join(f"n{i}" for i in range(200))
    item = table(spark, SF, "benchmark").where("length(text) > 60").first()["text"]
    rows = [
        (1, "the quick brown fox", "en", "a", "x"), (2, "the quick brown fox", "en", "a", "x"), (3, None, None, None, None), (4, "", "en", "", ""), (4, "", "en", "", ""), (5, " \t\n ", "en", "b", "x"),
        (None, "a text without an id", "en", "b", "x"), (None, "a text without an id", "en", "b", "x"), (8, long, "en", "c", "x"), (9, long, "en", "c", "x"), (8, "same id, other text", None, "c", "x"),
        (20, near, "en", "c", "x"), (None, near + " more", "en", "c", "x"), (30, "before " + item + " after", "en", "c", "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, key string"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 as slot", "'q' as shard", "2 as digest", "3 as position", "4 as label", "5 as size")
    labels = table(spark, SF, "labels").limit(0)
    labels.write.parquet(str(tmp_path / "sf/labels.parquet"))
    table(spark, SF, "benchmark").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    out = staged(spark, docs, str(tmp_path / "sf"), tmp_path).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in out) == [-1, 1, 3, 5, 8, 8, 20]
    assert {(r["shard"], r["slot"]) for r in out} == {(s, i) for s in range(8) for i in range(sum(r["shard"] == s for r in out))}
    (tmp_path / "none").mkdir()
    assert staged(spark, docs.limit(0), str(tmp_path / "sf"), tmp_path / "none").count() == 0
