"""Crawl states as a stream: any cut into micro-batches and any restart gives what plain Python gives."""

import random
from datetime import datetime, timedelta

from leadloom.operators.state import TRANSITIONS
from leadloom.sources.store import Store
from leadloom.streaming import crawl_states

AGE = timedelta(hours=3)
T0 = datetime(2024, 1, 1)


def made_events(n=90):
    rng = random.Random(2)
    out = []
    for i in range(n):
        at = T0 + timedelta(minutes=17 * i)
        kind = rng.choice(["started", "started", "completed", "failed"])
        out.append((i, rng.randrange(6) if i % 3 else 0, kind, at, i * 10, "E", "m", at + timedelta(minutes=rng.choice([5, 50])) if kind == "failed" and rng.random() < 0.5 else None))
    return out


def plain(events):
    """(states, due rows with a later event, illegal steps)"""
    states, due, gone, illegal = {}, {}, set(), set()
    for seq, c, kind, at, crawl, error, message, retry in events:
        s = states.setdefault(c, {"status": "pending", "attempts": 0, "last": None, "error": None, "retry": None})
        if c in due and due[c][0] <= at:
            gone.add((c, *due.pop(c)))
        want = {"started": "running", "completed": "completed"}.get(kind) or ("retrying" if retry else "failed")
        if want not in TRANSITIONS[s["status"]]:
            illegal.add((c, at))
            continue
        due.pop(c, None)
        s["status"] = want
        if want == "running":
            s |= {"attempts": s["attempts"] + 1, "error": None, "retry": None}
        elif want == "completed":
            s |= {"last": crawl, "error": None, "retry": None}
            due[c] = (at + AGE, "recrawl")
        else:
            s |= {"error": error, "retry": retry}
            if retry:
                due[c] = (retry, "retry")
    return {(c, *s.values()) for c, s in states.items()}, gone, illegal, {(c, *d) for c, d in due.items()}


def kept(spark, folder):
    store = crawl_states.state_store(spark, f"{folder}/states", buckets=4)
    states = {(r["company_id"], r["status"], r["attempts"], r["last_crawl_id"], r["error_type"], r["next_retry_at"]) for r in store.read().collect()}
    return states, [(r["company_id"], r["at"], r["step"]) for r in spark.read.parquet(f"{folder}/due").collect()]


def test_cuts_and_restarts(spark, tmp_path):
    events = made_events()
    states, gone, illegal, left = plain(events)
    write = lambda part, name, folder: spark.createDataFrame(part, crawl_states.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    assert illegal

    def run(folder, files_at_once=None):
        store = crawl_states.state_store(spark, f"{folder}/states", buckets=4)
        crawl_states.run_once(spark, crawl_states.landed(spark, f"{folder}/in", files_at_once), store, f"{folder}/checkpoint", AGE, f"{folder}/due")

    # all at once
    one = tmp_path / "one"
    write(events, "in", one)
    run(one)
    # with a restart in between, rows that come twice, and a run without news
    two = tmp_path / "two"
    for a, b in ((0, 31), (25, 90)):
        write(events[a:b], "in", two)
        run(two)
    run(two)
    for folder in (one, two):
        got, due = kept(spark, folder)
        assert got == states and len(due) == len(set(due))
        passed = {d for d in left if d[1] <= events[-1][3]}
        assert gone <= set(due) <= gone | left and passed <= set(due)


def test_illegal_steps_are_rows(spark, tmp_path):
    spark.createDataFrame([(0, 1, "completed", T0, 5, None, None, None), (1, 1, "started", T0, None, None, None, None), (2, None, "started", T0, None, None, None, None)], crawl_states.EVENTS).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", crawl_states.PROVIDER)
    q = crawl_states.crawl_states(crawl_states.landed(spark, f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["kind"], r["company_id"], r["step"] or r["status"]) for r in rows) == [("illegal", 1, "pending completed"), ("state", 1, "running")]


def test_states_are_a_store(spark, tmp_path):
    assert isinstance(crawl_states.state_store(spark, str(tmp_path)), Store) and crawl_states.state_store(spark, str(tmp_path)).read().count() == 0
