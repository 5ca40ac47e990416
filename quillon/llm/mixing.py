"""Mixing sources to target weights with a time-varying curriculum.

Each source's words are put in a fixed pseudo-random order. A source's target is its
weighted share of all words, held to a multiple of its size. Its documents are passed
over in order, again and again, until the target is met; the last document may be taken
in part. The weight schedule of a source is integrated over training time; inverting
this cumulative demand at a document's first word gives its position, by which the
result is range-sorted.

Running sums over a source, which may hold a third of all rows, are taken in two steps:
sums of hash-ordered blocks, then sums inside blocks. Those over the sources themselves are
taken over ranges of sources, and then inside ranges.

Defined results: null text has size 0; texts of any length are counted whole; a null source is a source of its own, the last;
sources without words have target 0; documents of which nothing is taken have no
position and come last; rows that repeat a doc_id are taken like any others; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_ROWS, has_repeats, matched, saved, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
#: Relative weight over training time, as (time, weight) knots joined by lines, for each place in WEIGHTS.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
BLOCK = 4096


def demand_inverse(knots: Sequence[tuple[float, float]], share: Column) -> Column:
    """Training time at which a share of all demand under the schedule is met."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, done, rules = sum(areas), 0.0, []
    if total <= 0 or min(w for _, w in knots) < 0:
        raise ValueError("a schedule needs weights of 0 or more that are not all 0")
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        if area > 0:
            x = F.greatest(share * F.lit(total) - F.lit(done), F.lit(0.0))
            slope = (w1 - w0) / (t1 - t0)
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * slope) * x, F.lit(0.0)))
            time = F.lit(t0) + F.when(x > 0, F.lit(2.0) * x / (F.lit(w0) + root)).otherwise(F.lit(0.0))
            done += area
            rules.append((done / total, F.least(time, F.lit(float(t1)))))
    out = rules[-1][1]
    for upto, time in reversed(rules[:-1]):
        out = F.when(share <= F.lit(upto), time).otherwise(out)
    return out


def _running(rows: DataFrame, n: int, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """The n rows with the sum of all earlier rows for each of `sums`; one range of BROADCAST_ROWS rows a task."""
    ranged = saved(rows.repartitionByRange(max(1, -(-n // BROADCAST_ROWS)), *order).withColumn("_part", F.spark_partition_id()))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_all_{k}") for k, c in sums.items()])
    by_part, inside = earlier(Window.partitionBy(F.lit(0)).orderBy("_part")), earlier(Window.partitionBy("_part").orderBy(*order))
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = whole.select(F.col("_part").alias("_own"), *[zero(F.sum(f"_all_{k}").over(by_part)).alias(f"_before_{k}") for k in sums])
    own = ranged.select("*", *[zero(F.sum(c).over(inside)).alias(f"_inside_{k}") for k, c in sums.items()])
    both = own.join(F.broadcast(base), F.col("_part") == F.col("_own"))
    return saved(both.select(*[F.col(c) for c in rows.columns], *[(F.col(f"_before_{k}") + F.col(f"_inside_{k}")).alias(k) for k in sums]))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, n, source_size, place, target of sizes(source, size).

    With sources in order of size by weight, the level at which just the first few are
    held is the largest of (what the earlier ones leave) / (weight of the rest).
    """
    sums = saved(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")))
    count = sums.count()
    by_name = F.col("source").asc_nulls_last()
    placed = _running(sums, count, [by_name], {"rank": F.lit(1)}).withColumn("place", (F.col("rank") % len(weights)).cast("int")).drop("rank")
    weight = F.lit(None).cast("double")
    for i, w in enumerate(weights):
        weight = F.when(F.col("place") == i, F.lit(float(w))).otherwise(weight)
    weighed = placed.withColumn("weight", weight).withColumn("ratio", F.col("source_size") / F.col("weight"))
    ran = _running(weighed, count, [F.col("ratio"), by_name], {"held": F.lit(most) * F.col("source_size"), "lighter": F.col("weight")})
    whole = ran.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left = (F.lit(whole["size"]) - F.col("held")).cast("double") / (F.lit(whole["weight"]) - F.col("lighter"))
    level = ran.agg(F.max(left).alias("level")).first()["level"]
    target = F.least((F.lit(most) * F.col("source_size")).cast("double"), F.lit(level) * F.col("weight"))
    return saved(ran.select("source", "n", "source_size", "place", target.alias("target")))


def _taken(docs: DataFrame, weights: Sequence[int], most: int, block: int, own: Column) -> DataFrame:
    """What is taken of each row; own, as column `own`, tells it from others."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    rows = saved(docs.select("doc_id", "source", size.alias("size"), mark.alias("mark"), own.alias("own")))
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name")  # null is a source of its own
    sources = targets(rows, weights, most).select(name, "n", F.col("n").alias("rows"), "source_size", "place", "target")

    spread = F.conv(F.substring("mark", 1, 8), 16, 10).cast("long")
    blocks = F.ceil(F.col("rows") / F.lit(block))
    known = matched(rows.select("*", name), sources, "name", rows.count()).drop("name")
    known = known.withColumn("block", F.shiftright(F.coalesce(spread, F.lit(0)) * blocks, 32))
    sums = known.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    before = F.sum("block_size").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = saved(sums.select(F.col("source").alias("_source"), F.col("block").alias("_block"), F.coalesce(before, F.lit(0)).alias("block_start")))

    inside = Window.partitionBy("source", "block").orderBy("mark", "doc_id", "size", "own").rowsBetween(Window.unboundedPreceding, -1)
    run = known.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    run = run.join(small(starts), F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    quota = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    run = run.withColumn("start", F.col("block_start") + F.col("inside")).withColumn("quota", quota).withColumn("passes", passes)
    part = F.least(F.greatest(F.col("quota") - F.col("passes") * F.col("source_size") - F.col("start"), F.lit(0)), F.col("size"))
    run = run.withColumn("part", part).withColumn("taken", F.col("passes") * F.col("size") + F.col("part"))
    return run.withColumn("copies", F.col("passes") + (2 * F.col("part") > F.col("size")).cast("long"))


def _position(words: Column, schedules, n: int) -> Column:
    share = F.when(F.col("quota") > 0, words / F.col("quota")).otherwise(F.lit(0.0))
    time = F.lit(None).cast("double")
    for i in range(n):
        time = F.when(F.col("place") == i, demand_inverse(schedules[i % len(schedules)], share)).otherwise(time)
    return time


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, schedules=SCHEDULES, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, position of docs(doc_id, source, text), by position.

    position is that of the first copy; copies is in whole documents: a part counts if it is more than half.
    """
    run = _taken(docs, weights, most, block, F.lit(0))
    run = run.withColumn("position", F.when(F.col("taken") > 0, _position(F.col("start"), schedules, len(weights))))
    return run.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, schedules=SCHEDULES, block: int = BLOCK) -> DataFrame:
    """The documents the mix takes, whole and as often as it takes them, range-sorted by each copy's position.

    Documents without words are neither taken nor asked for, so they go. Rows that share an id, or
    have none, are taken each by itself; only then all rows are written once more, with numbers.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), "doc_id", "source", "text")
    own = F.col("doc_id")
    if has_repeats(docs):  # rows are numbered; the numbers hold as the rows are kept with them
        rows, own = saved(rows.withColumn("number", F.monotonically_increasing_id())), F.col("number")
    run = _taken(rows, weights, most, block, own).where("copies > 0 AND size > 0")
    each = run.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    at = each.select("own", "copy", _position(F.col("start") + F.col("copy") * F.col("source_size"), schedules, len(weights)).alias("position"))
    both = rows.select("row", own.alias("_own")).join(at, F.col("_own").eqNullSafe(F.col("own")))
    return both.orderBy("position", "own", "copy").select("row.*")
