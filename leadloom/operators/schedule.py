"""Requests dealt to time slots: which request of a client may be made when, so that many tasks together keep the client's limits without talking to each other.

A client's calendar says where its slots are: runs of equally spaced slots, a new run wherever a day's cap is reached or a cooldown ends. It has a row for each day or cooldown that
the requests need, not for each request, and is made on the driver. Requests are numbered in order (two levels: within chunks of the order, after the counts of the chunks before),
and the n-th gets the n-th slot by a join with the run that its number falls in.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000
CHUNKS = 256


@dataclass
class Limits:
    """Of one client: at most per_minute in any 60 s, evenly spaced, and per_day on a UTC day; none from the start of a cooldown to its end."""

    per_minute: int
    per_day: int | None = None
    cooldowns: list[tuple[datetime, datetime]] = field(default_factory=list)

    def __post_init__(self):
        if self.per_minute < 1 or (self.per_day is not None and self.per_day < 1):
            raise ValueError("limits must be 1 or more")


def _micros(at: datetime) -> int:
    """Microseconds since 1970; times without a zone are UTC."""
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return int(at.timestamp()) * 1_000_000 + at.microsecond


class Calendar:
    """The slots of one client from a time on. What was taken stays taken: the next take() goes on behind it."""

    def __init__(self, limits: Limits, start: datetime, used_today: int = 0):
        self.limits, self.at = limits, _micros(start)
        self.interval = -(-60_000_000 // limits.per_minute)  # n slots of this spacing are never within 60 s of the one n before
        self.used = Counter({self.at // DAY: used_today})
        self.closed = sorted((_micros(a), _micros(b)) for a, b in limits.cooldowns)

    def take(self, n: int) -> list[tuple[int, int, int]]:
        """(first number, slots, time of the first) of runs with n slots in all."""
        out, first = [], 0
        while first < n:
            free = next((b for a, b in self.closed if a <= self.at < b), None)
            if free is not None:
                self.at = free
                continue
            day = self.at // DAY
            left = n - first if self.limits.per_day is None else self.limits.per_day - self.used[day]
            if left <= 0:
                self.at = (day + 1) * DAY
                continue
            end = min([(day + 1) * DAY, *(a for a, _ in self.closed if a > self.at)])
            count = min(n - first, left, -(-(end - self.at) // self.interval))
            out.append((first, count, self.at))
            first, self.at = first + count, self.at + count * self.interval
            self.used[day] += count
        return out


def numbered(rows: DataFrame, group: str, order: str, out: str, chunks: int = CHUNKS) -> DataFrame:
    """Rows numbered from 0 in order within their group. `order` is a whole number, unique within the group; it is cut into chunks of equal width, so that no group is one task."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return rows.withColumn(out, F.lit(None).cast("long"))
    d = rows.withColumn("__chunk", F.width_bucket(F.col(order).cast("double"), F.lit(float(low)), F.lit(float(high) + 1), F.lit(chunks)))
    before = Window.partitionBy(group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy(group, "__chunk").agg(F.count("*").alias("__n")).select(group, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(group, "__chunk").orderBy(order))
    return d.withColumn("__rank", rank).join(offsets, [group, "__chunk"]).withColumn(out, F.col("__before") + F.col("__rank") - 1).drop("__chunk", "__rank", "__before")


def deal(requests: DataFrame, calendars: dict[str, Calendar], client: str = "client", order: str = "ordinal", chunks: int = CHUNKS) -> DataFrame:
    """requests with `slot` (their number within the client, from 0) and `slot_at`, the earliest time that the client's limits allow. Each calendar gives as many slots as its client
    has requests. A request whose client has no calendar is an error."""
    spark = requests.sparkSession
    known = requests.where(F.col(client).isin(*calendars))
    counts = {r[0]: r[1] for r in requests.groupBy(F.when(F.col(client).isin(*calendars), F.col(client)).alias("c")).count().collect()}
    if None in counts:
        raise ValueError(f"{counts[None]} requests of clients without limits")
    runs = [(c, *run, calendars[c].interval, calendars[c].limits.per_day or 1 << 20) for c, n in counts.items() for run in calendars[c].take(n)]
    runs = spark.createDataFrame(runs, "c string, first long, slots long, at long, spacing long, width long")
    # a run stands in each block of numbers that it reaches; a block is as wide as a day's cap, so few runs share one
    runs = runs.select("*", F.explode(F.sequence(F.expr("first div width"), F.expr("(first + slots - 1) div width"))).alias("block"))
    widths = F.create_map(*[x for c, k in calendars.items() for x in (F.lit(c), F.lit(k.limits.per_day or 1 << 20).cast("long"))])
    rows = numbered(known, client, order, "slot", chunks).withColumn("__block", F.floor(F.col("slot") / widths[F.col(client)]))
    at = F.col("at") + (F.col("slot") - F.col("first")) * F.col("spacing")
    joined = rows.join(runs, (F.col(client) == F.col("c")) & (F.col("__block") == F.col("block")) & (F.col("slot") >= F.col("first")) & (F.col("slot") < F.col("first") + F.col("slots")))
    return joined.select(*requests.columns, "slot", F.timestamp_micros(at).alias("slot_at"))
