"""External services behind protocols. Only file-backed and fixed ones are here; nothing is sent and no network is used."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Iterable
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DailyLimitError
from ..operators.schedule import Calendar, Limits, deal
from .store import materialized


class Provider(Protocol):
    """Answers to requests: an implementation is pickled to the tasks and opens what it needs in answer()."""

    schema: str

    def answer(self, requests: Iterable[dict]) -> Iterable[dict]: ...


class Limiter:
    """The rate of one client: a least interval, at most `per_minute` in any 60 s, a cap for each UTC day, and cooldowns that the service asks for."""

    def __init__(self, per_minute: int, per_day: int, clock=time.monotonic, sleep=time.sleep, day=lambda: time.strftime("%Y-%m-%d", time.gmtime())):
        if per_minute < 1 or per_day < 1:
            raise ValueError("limits must be 1 or more")
        self.per_minute, self.per_day, self.clock, self.sleep, self.day = per_minute, per_day, clock, sleep, day
        self.recent, self.today, self.used, self.blocked_until = deque(), None, 0, 0.0

    def acquire(self) -> None:
        """Wait until a request may be made, and count it."""
        while True:
            if self.today != self.day():
                self.today, self.used = self.day(), 0
            if self.used >= self.per_day:
                raise DailyLimitError(f"{self.per_day} requests were made today")
            now = self.clock()
            while self.recent and now - self.recent[0] >= 60:
                self.recent.popleft()
            waits = [self.blocked_until - now]
            if self.recent:
                waits.append(self.recent[-1] + 60 / self.per_minute - now)
            if len(self.recent) >= self.per_minute:
                waits.append(self.recent[0] + 60 - now)
            if max(waits) <= 0:
                break
            self.sleep(max(waits))
        self.recent.append(now)
        self.used += 1

    def cool_down(self, seconds: float) -> None:
        self.blocked_until = max(self.blocked_until, self.clock() + seconds)


def _asked(provider: Provider, attempts: int, keys: list[str], wait):
    """For mapInPandas: the provider's answers, or a row with the error; `keys` of the request stand in each row. wait(request) comes before each attempt."""
    names = [f.strip().split(" ")[0] for f in provider.schema.split(",")]

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for request in batch.to_dict("records"):
                own = {k: request[k] for k in keys}
                for attempt in range(1, attempts + 1):
                    wait(request)
                    try:
                        out += [{n: r.get(n) for n in names} | {"error_type": None, "error_message": None} | own for r in provider.answer([request])]
                        break
                    except Exception as e:  # noqa: BLE001  one request's failure is a row
                        if attempt == attempts:
                            out.append({n: request.get(n) for n in names} | {"error_type": type(e).__name__, "error_message": str(e)} | own)
            yield pd.DataFrame(out, columns=[*names, "error_type", "error_message", *keys])

    return run


def call(provider: Provider, requests: DataFrame, tasks: int | None = None, limits: dict[str, Limits] | None = None, attempts: int = 3, start: datetime | None = None) -> DataFrame:
    """provider's answers over at most `tasks` tasks. A request that fails in every attempt gives a row with error_type and error_message, and harms no other.

    With `limits` requests (client, ordinal, ...) are dealt to time slots first, from `start` (now) on; each task waits for the slots of its requests, so all tasks together keep each
    client's rate, daily cap and cooldowns. A further attempt is a request like any other: the failed ones of a round get slots behind those of the round, and a client's calendar goes
    on. There must be as many free cores as tasks, or slots would come late."""
    if limits is None:
        rows = requests if tasks is None else requests.repartition(tasks)
        return rows.mapInPandas(_asked(provider, attempts, [], lambda request: None), f"{provider.schema}, error_type string, error_message string")
    sc = requests.sparkSession.sparkContext
    tasks = tasks or sc.defaultParallelism
    if tasks > sc.defaultParallelism:
        raise ValueError(f"{tasks} tasks on {sc.defaultParallelism} cores would miss their slots")
    calendars = {c: Calendar(x, start or datetime.now(UTC)) for c, x in limits.items()}
    schema = f"{provider.schema}, error_type string, error_message string, __client string, __ordinal long"
    todo, out = requests, None

    def wait(request):
        time.sleep(max(0.0, request["__at"] / 1e6 - time.time()))

    for attempt in range(1, attempts + 1):
        slots = deal(todo, calendars).withColumns({"__client": F.col("client"), "__ordinal": F.col("ordinal").cast("long"), "__at": F.unix_micros("slot_at")})
        dealt = slots.repartition(tasks, "slot").sortWithinPartitions("slot_at")
        answers = materialized(dealt.mapInPandas(_asked(provider, 1, ["__client", "__ordinal"], wait), schema), "answers")
        failed = answers.where("error_type is not null").select(F.col("__client").alias("client"), F.col("__ordinal").alias("ordinal"))
        last = attempt == attempts or failed.isEmpty()
        done = answers if last else answers.where("error_type is null")
        out = done if out is None else out.unionByName(done)
        if last:
            break
        todo = materialized(todo.join(failed, ["client", "ordinal"], "left_semi"), "failed")
    return out.drop("__client", "__ordinal")


class FileAnswers:
    """Answers that have landed as files, one for each key: folder/<key> or folder/<key>/part-*. A key without a file is an error, as a service's failure is."""

    def __init__(self, folder: str, key: str = "key"):
        self.folder, self.key = folder.rstrip("/"), key
        self.schema = f"{key} string, report string"

    def answer(self, requests: Iterable[dict]) -> Iterable[dict]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.folder) if ":" in self.folder.split("/")[0] else (fs.LocalFileSystem(), self.folder)
        for request in requests:
            key = str(request[self.key])
            if "/" in key or key in ("", ".", ".."):
                raise ValueError(f"{key!r} is no name of a file")
            info = system.get_file_info(f"{base}/{key}")
            found = [info] if info.type == fs.FileType.File else []
            if info.type == fs.FileType.Directory:
                found = [f for f in system.get_file_info(fs.FileSelector(info.path)) if f.base_name.startswith("part-")]
            if not found:
                raise FileNotFoundError(f"no answer for {key}")
            text = b"".join(system.open_input_stream(f.path).read() for f in sorted(found, key=lambda f: f.path)).decode("utf-8", "replace")
            yield {self.key: key, "report": text.strip()}


def fixture(requests: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Answers from a table in place of a service."""
    return requests.join(answers, key, "left")


def fallback_classification(people: DataFrame) -> DataFrame:
    """Without a language model every role is unknown, with low confidence, and nobody is a decision maker."""
    return people.withColumns({"role_group": F.lit("unknown"), "confidence": F.lit("low"), "is_decision_maker": F.lit(False), "reason": F.lit(None).cast("string")})
