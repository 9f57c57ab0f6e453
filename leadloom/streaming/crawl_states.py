"""Crawl states as a keyed stream: each company's state is kept in Spark's state store, and timers tell when a retry or a new crawl is due.

Events of a company: `started`, `completed` (with crawl_id), `failed` (with an error, and next_retry_at where it shall be tried again), numbered by `seq` in the order in which they
come. An event makes the step that its kind asks for; a step that is illegal changes nothing and gives a row of its own. An event whose seq isn't above the last one was seen
before and is passed over, so a source that repeats events does no harm. What comes out depends on the sequence of events alone, not on how it is cut into micro-batches.

Rows that come out have a kind: `state` (a company's state after a micro-batch), `illegal` (at, step), `due` (a retry at next_retry_at, or a crawl that is max_age old, if nothing
happened before). A due row comes with the company's next event, or when the watermark passes its time, whichever is first.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.state import TRANSITIONS
from ..sources.store import Store, replaced

EVENTS = "seq long, company_id long, kind string, at timestamp, crawl_id long, error_type string, error_message string, next_retry_at timestamp"
_FIELDS = (
    "status string, attempts int, last_crawl_id long, started_at timestamp, completed_at timestamp, failed_at timestamp, next_retry_at timestamp, error_type string, error_message string, "
    "seq long"
)
STATE = f"company_id long, {_FIELDS}"
OUTPUT = f"kind string, at timestamp, step string, {STATE}"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]
#: Inside the state store times are microseconds, which no time zone changes.
_INSIDE, _TOLD = _FIELDS.replace("timestamp", "long"), OUTPUT.replace("timestamp", "long")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def after(state: dict, event) -> dict | None:
    """The state that an event leads to, or None if its step is illegal."""
    wanted = {"started": "running", "completed": "completed", "failed": "retrying" if event["next_retry_at"] else "failed"}.get(event["kind"])
    if wanted not in TRANSITIONS[state["status"]]:
        return None
    clear = {"failed_at": None, "error_type": None, "error_message": None, "next_retry_at": None}
    if wanted == "running":
        return state | clear | {"status": wanted, "attempts": state["attempts"] + 1, "started_at": event["at"]}
    if wanted == "completed":
        return state | clear | {"status": wanted, "last_crawl_id": event["crawl_id"], "completed_at": event["at"]}
    return state | {"status": wanted, "failed_at": event["at"], "error_type": event["error_type"], "error_message": event["error_message"], "next_retry_at": event["next_retry_at"]}


class CrawlStates(StatefulProcessor):
    def __init__(self, max_age: timedelta):
        self.max_age = max_age // timedelta(microseconds=1)

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("state", _INSIDE)
        self.due = handle.getValueState("due", "at long, step string")

    def close(self):
        pass

    def _told(self, key, kind, at, step, state=None):
        return Row(**({"kind": kind, "at": at, "step": step, "company_id": key} | (state or dict.fromkeys(_NAMES))))

    def _due(self, state: dict):
        if state["status"] == "retrying":
            return state["next_retry_at"], "retry"
        if state["status"] == "completed":
            return state["completed_at"] + self.max_age, "recrawl"
        return None

    def _keep_due(self, due) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if due:
            self.due.update(due)
            self.handle.registerTimer(-(-due[0] // 1000))
        else:
            self.due.clear()

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  (Spark's names)
        state = dict(zip(_NAMES, self.state.get())) if self.state.exists() else dict.fromkeys(_NAMES) | {"status": "pending", "attempts": 0, "seq": -1}
        due = tuple(self.due.get()) if self.due.exists() else None
        before = state
        for event in sorted((r.asDict() for r in rows), key=lambda r: r["seq"]):
            if event["seq"] <= state["seq"]:
                continue
            if due and due[0] <= event["at"]:
                yield self._told(key[0], "due", *due)
                due = None
            new = after(state, event)
            if new is None:
                yield self._told(key[0], "illegal", event["at"], f"{state['status']} {event['kind']}")
                state = state | {"seq": event["seq"]}
            else:
                state = new | {"seq": event["seq"]}
                due = self._due(state)
        if state is not before:
            self.state.update(tuple(state[n] for n in _NAMES))
            self._keep_due(due)
            yield self._told(key[0], "state", None, None, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.due.exists():
            due = tuple(self.due.get())
            self.due.clear()
            yield self._told(key[0], "due", *due)


def crawl_states(events: DataFrame, max_age: timedelta = timedelta(days=30), late: str = "0 seconds") -> DataFrame:
    """Rows of OUTPUT from a stream of EVENTS. The session's state store must be RocksDB (PROVIDER)."""
    known = events.where("company_id is not null and seq is not null and at is not null").withWatermark("at", late)
    keyed = known.withColumnsRenamed({"at": "event_time"}).withColumns({"at": F.unix_micros("event_time"), "next_retry_at": F.unix_micros("next_retry_at")}).groupBy("company_id")
    rows = keyed.transformWithState(statefulProcessor=CrawlStates(max_age), outputStructType=_TOLD, outputMode="append", timeMode="eventtime")
    times = [f.split()[0] for f in OUTPUT.split(", ") if f.endswith("timestamp")]
    return rows.withColumns({c: F.timestamp_micros(c) for c in times})


def state_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, STATE, ["company_id"], buckets)


def keep_states(rows: DataFrame, store: Store, checkpoint: str, due: str | None = None):
    """A writer that puts each micro-batch's states into the store, of which it rewrites the buckets touched, and adds due rows to the folder `due`. A micro-batch that is repeated
    after a restart changes the store once. Start it with .start()."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def keep(batch: DataFrame, number: int) -> None:
        batch.persist()
        names = [f.name for f in store.schema]
        store.update(f"batch-{number}", batch.where("kind = 'state'").select(*names), replaced(["company_id"]))
        if due:
            batch.where("kind = 'due'").select("company_id", "at", "step").write.mode("overwrite").parquet(f"{due}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", checkpoint)


def run_once(spark: SparkSession, events: DataFrame, store: Store, checkpoint: str, max_age: timedelta = timedelta(days=30), due: str | None = None) -> None:
    """All events that have landed since the last run."""
    q = keep_states(crawl_states(events, max_age), store, checkpoint, due).trigger(availableNow=True).start()
    q.awaitTermination()


def landed(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A stream of Parquet files of EVENTS."""
    reader = spark.readStream.schema(EVENTS)
    reader = reader if files_at_once is None else reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(path)
