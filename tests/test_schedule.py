"""Slots of requests against a simulation of one request after the other, and calls that keep them."""

import random
import time
from datetime import UTC, datetime, timedelta

import pytest

from leadloom.operators import schedule
from leadloom.operators.schedule import DAY, Calendar, Limits
from leadloom.sources import providers

NOON = datetime(2024, 1, 1, 12)


def simulated(limits: Limits, start: datetime, n: int, used_today: int = 0) -> list[int]:
    """Microseconds of n requests, each as early as all rules allow after the one before."""
    micros = lambda at: int((at - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    out, t = [], micros(start)
    first_day = t // DAY
    for _ in range(n):
        while True:
            waits = [b for a, b in ((micros(a), micros(b)) for a, b in limits.cooldowns) if a <= t < b]
            if out:
                waits.append(out[-1] + -(-60_000_000 // limits.per_minute))
            if len(out) >= limits.per_minute:
                waits.append(out[-limits.per_minute] + 60_000_000)
            if limits.per_day and sum(x // DAY == t // DAY for x in out) + (used_today if t // DAY == first_day else 0) >= limits.per_day:
                waits.append((t // DAY + 1) * DAY)
            if not waits or max(waits) <= t:
                break
            t = max(waits)
        out.append(t)
    return out


CASES = [
    (Limits(60), NOON, 0), (Limits(7, 50), NOON, 0), (Limits(1, 900), NOON, 10), (Limits(30, 40, [(NOON, NOON + timedelta(minutes=1)), (NOON + timedelta(seconds=70), NOON + timedelta(hours=20))]), NOON, 0),
    (Limits(2, 1000), datetime(2024, 1, 1, 23, 50), 990), (Limits(60, 5, [(datetime(2024, 1, 2), datetime(2024, 1, 3, 0, 0, 2))]), datetime(2024, 1, 1, 23, 59, 58), 1),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_calendar_equals_simulation(case):
    limits, start, used = CASES[case]
    c = Calendar(limits, start, used)
    got = [at + i * c.interval for n in (1, 60, 64) for _, slots, at in c.take(n) for i in range(slots)]
    assert got == simulated(limits, start, 125, used)


def test_requests_equal_simulation(spark):
    rng = random.Random(4)
    clients = {f"c{i}": x for i, (x, start, _) in enumerate(CASES) if start == NOON}
    rows = [(o, rng.choice(list(clients)) if rng.random() < 0.6 else "c1") for o in rng.sample(range(-500, 100_000), 400)]
    requests = spark.createDataFrame(rows, "ordinal long, client string").repartition(5)
    for chunks in (1, 64):
        got = schedule.deal(requests, {c: Calendar(x, NOON) for c, x in clients.items()}, chunks=chunks).collect()
        assert len(got) == len(rows)
        for c, x in clients.items():
            own = sorted((r["ordinal"], r["slot"], r["slot_at"]) for r in got if r["client"] == c)
            assert [s for _, s, _ in own] == list(range(len(own)))
            assert [int(at.replace(tzinfo=UTC).timestamp()) * 1_000_000 + at.microsecond for _, _, at in own] == simulated(x, NOON, len(own))
            if x.per_day:
                assert max((sum(at.date() == day for _, _, at in own) for day in {at.date() for _, _, at in own}), default=0) <= x.per_day
    with pytest.raises(ValueError):
        schedule.deal(requests, {"c1": Calendar(Limits(1), NOON)})
    assert schedule.deal(requests.limit(0), {"c1": Calendar(Limits(1), NOON)}).collect() == []
    with pytest.raises(ValueError):
        Limits(0)


def test_calls_keep_their_slots(spark, tmp_path):
    """No request is made before its slot; what fails is asked again in later slots."""
    marks = str(tmp_path)

    class Once:
        schema = "id long, slot long, early boolean, round long"

        def answer(self, requests):
            from pathlib import Path

            for r in requests:
                mark = Path(marks, str(r["ordinal"]))
                asked = mark.read_text() if mark.exists() else ""
                mark.write_text(asked + "x")
                if r["ordinal"] % 3 == 0 and len(asked) < r["ordinal"] % 2 + 1 or r["ordinal"] == 7:
                    raise ValueError("not now")
                yield {"id": r["ordinal"], "slot": r["slot"], "early": time.time() < r["slot_at"].timestamp() - 0.001, "round": len(asked)}

    requests = spark.createDataFrame([(i, "a" if i % 2 else "b", "x") for i in range(12)], "ordinal long, client string, text string")
    limits = {"a": Limits(1200), "b": Limits(600)}
    rows = providers.call(Once(), requests, tasks=2, limits=limits).collect()
    good = {r["id"]: r for r in rows if r["error_type"] is None}
    assert len(rows) == 12 and sorted(good) == [i for i in range(12) if i != 7] and not any(r["early"] for r in good.values())
    assert [r["error_type"] for r in rows if r["error_type"]] == ["ValueError"]
    assert {i: r["round"] for i, r in good.items()} == {i: (0 if i % 3 else i % 2 + 1) for i in range(12) if i != 7}
    with pytest.raises(ValueError):
        providers.call(Once(), requests, tasks=1000, limits=limits)
