"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are numbered in hash order and cut into blocks. Block i of a source with weight a/Q gets the release time floor(i Q / a)
and the deadline ceil((i + 1) Q / a), and one slot between them, so no source is ever a whole block ahead of or behind its target.
Q comes from the numbers of sources and blocks (or is given), so that over the whole run the rounded weights a/Q and the targets differ by less than half a block.

The time line is a tree: a span of slots is cut in 16, down to frames of FRAME slots. At each cut the blocks of each source that come before it are its exact share, rounded
down or up (up for the largest remainders, within what the span's ends allow), and sum to the slots before it. By Hall's theorem any such rounding leaves every
part a schedule that keeps all windows, so the parts are independent, and spans without a block are dropped. In a frame the earliest deadline goes first: by
deadline, each block takes the first free slot from its release on, which is what running the earliest deadline among released blocks at each slot gives. The rows before a frame
follow from its cut. So nothing is scheduled in one task but the frames' blocks; only an array over the sources stands in a row.

A source that runs out leaves its slots empty; positions are counted without the empty slots. Every row is kept exactly once.

Target weights are given, or else proportional to rows ** exponent (0.5 flattens the sources), from exact counts over all rows.

Defined cases: a null source is a source of its own, apart from ''; sources without a target weight get the smallest weight, 1/Q, and so come last for the most part; ties in
deadline go to the smaller source name; repeated rows are kept; more sources than slots in a frame are scheduled like any others; empty tables give empty results; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_index, table

BLOCK_ROWS = 64
#: Slots of a frame, and how often the time line of FRAME * 16 ** LEVELS slots (2 ** 62) is cut in 16.
FRAME = 64
LEVELS = 14
EXPONENT = 0.5


def target_weights(counts: DataFrame, exponent: float = EXPONENT) -> DataFrame:
    return counts.select("s_null", "s_name", F.pow(F.col("rows").cast("double"), F.lit(exponent)).alias("weight"))


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _times(x: str, y: str) -> str:
    """SQL of a product of whole numbers that may need more than 64 bits."""
    return f"(cast({x} as decimal(19,0)) * cast({y} as decimal(19,0)))"


def _cut(before: str, after: str | None, at: str) -> str:
    """SQL of how many blocks of each source come before slot `at`: exact shares a t / Q, rounded so that they sum to t, the largest remainders up; not less than `before` nor, if
    given, more than `after` (arrays of such numbers)."""
    share, whole = _times("a[k]", "t"), "cast(q as decimal(19,0))"
    high = f"({share} + (cast(q as decimal(19,0)) - 1)) div {whole}"
    sides = f"transform(a, (x, k) -> named_struct('lo', greatest({before}[k], {share} div {whole}), 'hi', {high if after is None else f'least({after}[k], {high})'}, 'rank', named_struct('r', -({share} % {whole}), 'k', k)))"
    ups = "array_sort(transform(filter(sides, x -> x.hi > x.lo), x -> x.rank))"
    out = "transform(sides, x -> if(need > 0 and x.hi > x.lo and x.rank <= get(ups, cast(need - 1 as int)), x.lo + 1, x.lo))"
    return _let("t", at, _let("sides", sides, _let("need", "t - aggregate(sides, 0L, (s, x) -> s + x.lo)", _let("ups", ups, out))))


def schedule(weights: DataFrame, resolution: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The slot of each block: s_null, s_name, quota a, total Q, block, release, deadline, slot, and first (the rows in earlier slots).
    weights: s_null, s_name, weight, rows, one row for each source. Weights become whole quotas (1 at least) that sum to Q."""
    parts = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = weights.withColumn("blocks", F.expr(f"(rows - 1) div {block_rows} + 1"))
    one = sized.agg(F.array_sort(F.collect_list(F.struct("s_null", "s_name", "weight", "blocks", "rows"))).alias("src"), F.sum("weight").alias("total"), F.max("blocks").alias("most")).where("size(src) > 0")
    # over a run of `slots` slots a quota is off by half a unit, and Q by half a unit for each source or more where quotas are raised to 1
    slots = "array_max(transform(src, x -> if(x.weight > 0, x.blocks * (total / x.weight), 0D)))"
    fine = f"least(8 * ({slots} + size(src) * most) + 1000, 4e18D / (most + 1))" if resolution is None else f"{resolution}D"
    one = one.withColumn("fine", F.expr(f"cast({fine} as bigint)"))
    one = one.withColumn("a", F.expr("transform(src, x -> greatest(1L, cast(round(x.weight / total * fine) as bigint)))")).withColumn("q", F.expr("aggregate(a, 0L, (s, x) -> s + x)"))
    fixed = ["src", "a", "q", "blocks"]
    size = FRAME * 16**LEVELS
    node = one.select("src", "a", "q", F.expr("transform(src, x -> x.blocks)").alias("blocks"), F.lit(0).cast("long").alias("t0"), F.expr("transform(a, x -> 0L)").alias("r0"))
    node = node.withColumn("r1", F.expr(_cut("r0", None, f"{size}L")))
    for level in range(LEVELS):
        size //= 16
        if level in (LEVELS - 5, LEVELS - 2):
            node = node.repartition(parts, "t0")
        bounds = f"aggregate(sequence(1, 15), array(r0), (acc, j) -> concat(acc, array({_cut('acc[j - 1]', 'r1', f't0 + j * {size}L')})))"
        busy = "array_contains(transform(c.r0, (x, k) -> x < blocks[k] and x < c.r1[k]), true)"
        parts_of = f"filter(transform(bounds, (r, j) -> named_struct('t0', t0 + j * {size}L, 'r0', r, 'r1', if(j = 15, r1, get(bounds, j + 1)))), c -> {busy})"
        node = node.withColumn("bounds", F.expr(bounds)).select(*fixed, F.explode(F.expr(parts_of)).alias("c")).select(*fixed, "c.*")
    release, deadline = f"{_times('nth', 'q')} div cast(a[k] as decimal(19,0))", f"({_times('nth + 1', 'q')} + cast(a[k] - 1 as decimal(19,0))) div cast(a[k] as decimal(19,0))"
    own = f"transform(sequence(r0[k], least(r1[k], blocks[k]) - 1), nth -> named_struct('d', least({deadline}, t0 + {FRAME}L), 'k', k, 'nth', nth, 'r', {release}))"
    jobs = f"array_sort(flatten(transform(a, (x, k) -> if(r0[k] < least(r1[k], blocks[k]), {own}, cast(array() as array<struct<d:bigint,k:int,nth:bigint,r:bigint>>)))))"
    place = _let("slot", "filter(acc.free, x -> x >= j.r)[0]", "named_struct('free', filter(acc.free, x -> x <> slot), 'out', concat(acc.out, array(named_struct('slot', slot, 'k', j.k, 'nth', j.nth))))")
    placed = f"array_sort(aggregate({jobs}, named_struct('free', sequence(t0, t0 + {FRAME - 1}L), 'out', cast(array() as array<struct<slot:bigint,k:int,nth:bigint>>)), (acc, j) -> {place}, acc -> acc.out))"
    base = f"aggregate(transform(src, (x, k) -> least(least(r0[k], blocks[k]) * {block_rows}L, x.rows)), 0L, (s, x) -> s + x)"
    counted = f"""aggregate(placed, named_struct('at', {base}, 'out', cast(array() as array<struct<slot:bigint,k:int,nth:bigint,first:bigint>>)), (acc, j) -> named_struct(
        'at', acc.at + least({block_rows}L, src[j.k].rows - j.nth * {block_rows}L), 'out', concat(acc.out, array(named_struct('slot', j.slot, 'k', j.k, 'nth', j.nth, 'first', acc.at)))), acc -> acc.out)"""
    frames = node.withColumn("placed", F.expr(placed)).select("src", "a", "q", F.explode(F.expr(counted)).alias("s"))
    flat = frames.select(F.expr("src[s.k].s_null").alias("s_null"), F.expr("src[s.k].s_name").alias("s_name"), F.expr("a[s.k]").alias("quota"), F.col("q").alias("total"), F.col("s.nth").alias("block"), F.col("s.slot").alias("slot"), F.col("s.first").alias("first"))
    by = "cast(quota as decimal(19,0))"
    return flat.withColumn("release", F.expr(f"{_times('block', 'total')} div {by}")).withColumn("deadline", F.expr(f"({_times('block + 1', 'total')} + cast(quota - 1 as decimal(19,0))) div {by}"))


def mix(docs: DataFrame, weights: DataFrame | None = None, resolution: int | None = None, block_rows: int = BLOCK_ROWS, exponent: float = EXPONENT, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' `order` columns and source with block, release, deadline (in slots of the target schedule) and position (gapless, from 0)."""
    named = docs.select(*order, "source", F.col("source").isNull().alias("s_null"), F.coalesce("source", F.lit("")).alias("s_name"))
    counts = named.groupBy("s_null", "s_name").agg(F.count("*").alias("rows"))
    if weights is None:
        goal = target_weights(counts, exponent)
    else:
        given = weights.select(F.col("source").isNull().alias("s_null"), F.coalesce("source", F.lit("")).alias("s_name"), "weight")
        goal = counts.join(given, ["s_null", "s_name"], "left").select("s_null", "s_name", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    plan = schedule(goal.join(counts, ["s_null", "s_name"]).select("s_null", "s_name", "weight", "rows"), resolution, block_rows)
    rows = gapless_index(named, ["s_null", "s_name"], list(order), "n")
    rows = rows.withColumn("block", F.expr(f"n div {block_rows}"))
    out = rows.join(plan.select("s_null", "s_name", "block", "release", "deadline", "first"), ["s_null", "s_name", "block"])
    return out.select(*order, "source", "block", "release", "deadline", (F.col("first") + F.expr(f"n % {block_rows}")).alias("position"))


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """docs, all of them and with their own columns, in the order of the mix: range-partitioned and sorted by position.

    Rows that repeat both doc_id and text stand together at the first one's position.
    """
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    position = mix(keyed, order=("doc_id", "__h"), **options).groupBy(F.col("doc_id").alias("__d"), F.col("__h").alias("__g")).agg(F.min("position").alias("__position"))
    joined = keyed.join(position, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__g")))
    return joined.repartitionByRange("__position").sortWithinPartitions("__position").select(*docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
