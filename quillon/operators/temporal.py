"""Joins by time: to the latest earlier row, and of overlapping intervals. Both are extensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key, and of one bin, above which it is split by time.
SPLIT_ROWS = 200_000
#: At most so many small rows are broadcast, and of keys with up to PIECES cuts each; beyond that they are joined by key.
BROADCAST_ROWS, CUT_ROWS = 100_000, 2_000
#: Pieces that the time of a key with many rows is cut into, at most.
PIECES = 1000


def _small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def kept(df: DataFrame) -> DataFrame:
    """A narrow table computed once, in the folder of spark.checkpoint.dir; where there is none it is computed again when read."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if folder := df.sparkSession.conf.get("spark.checkpoint.dir", None):
            sc.setCheckpointDir(folder)
        else:
            return df
    return df.checkpoint(eager=True)


def time_cuts(rows: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """key, cuts: for each key(key, at) of more than split_rows rows, the times that cut it into pieces of about as many."""
    n = F.count(F.lit(1))
    many = rows.groupBy("key").agg(n.alias("n")).where(F.col("n") > split_rows)
    pieces = F.least(F.ceil(F.col("n") / split_rows), F.lit(PIECES)).cast("int")
    many = kept(many.select("key", pieces.alias("pieces")))
    fractions = [k / PIECES for k in range(1, PIECES)]
    fine = rows.join(_small(many), "key").groupBy("key").agg(F.percentile_approx("at", fractions, 10 * PIECES).alias("fine"), F.first("pieces").alias("pieces"))
    at = lambda k: F.get(F.col("fine"), F.ceil(k * PIECES / F.col("pieces")).cast("int") - 1)
    return kept(fine.select("key", F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("pieces") - 1), at)).alias("cuts")))


def _with_piece(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds piece: how many of its key's cuts lie at or before the row's time; 0 for a key that is not cut."""
    earlier = F.size(F.filter("cuts", lambda c: c <= F.col("at")))
    return rows.join(_small(cuts, CUT_ROWS), "key", "left").withColumn("piece", F.when(F.col("cuts").isNull(), 0).otherwise(earlier)).drop("cuts")


def asof_join(left: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str], take: Mapping[str, str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Each row of left with the columns `take` (new name: column of right) of the latest row of right that has its key and is not later.

    left_on, right_on: the names of key and time. Of rows of right at one time, the one with the
    largest taken values counts. Rows of left without such a row, or with a null key or time, get
    nulls; rows of right with a null key or time are never found.

    Both sides are sorted together by key and time, in one shuffle, and values are carried forward.
    A key of more than split_rows rows is cut into pieces of time at counted quantiles, so that it
    takes many tasks; the last value before each piece is carried in from a table of the pieces. Only
    many rows of one key at one and the same time stay together.
    """
    names = [F.col(f"`{c}`") for c in left.columns]
    taken = F.struct(*[F.col(f"`{c}`").alias(name) for name, c in take.items()])
    mine = left.select(F.col(f"`{left_on[0]}`").alias("key"), F.col(f"`{left_on[1]}`").alias("at"), F.lit(1).alias("side"), F.struct(*names).alias("row"))
    theirs = right.select(F.col(f"`{right_on[0]}`").alias("key"), F.col(f"`{right_on[1]}`").alias("at"), taken.alias("found")).where("key IS NOT NULL AND at IS NOT NULL")
    known = F.col("key").isNotNull() & F.col("at").isNotNull()
    cuts = time_cuts(mine.where(known).select("key", "at").unionByName(theirs.select("key", "at")), split_rows)

    rows = mine.where(known).unionByName(theirs.withColumn("side", F.lit(0)), allowMissingColumns=True)
    forward = Window.partitionBy("key", "piece").orderBy("at", "side", "found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = _with_piece(rows, cuts).withColumn("found", F.last("found", ignorenulls=True).over(forward)).where("side = 1")

    # what each piece of a cut key hands on: a row a piece, looked up by the pieces after it
    ends = _with_piece(theirs.join(_small(cuts.select("key")), "key", "left_semi"), cuts).groupBy("key", "piece").agg(F.max(F.struct("at", "found"))["found"].alias("last"))
    pieces = cuts.select("key", F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("piece")).join(ends, ["key", "piece"], "left")
    before = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = kept(pieces.select("key", "piece", F.last("last", ignorenulls=True).over(before).alias("carry")).where("carry IS NOT NULL"))
    whole = carried.join(_small(carry), ["key", "piece"], "left").select("row", F.coalesce("found", "carry").alias("found"))
    nothing = mine.where(~known).select("row", F.lit(None).cast(whole.schema["found"].dataType).alias("found"))
    return whole.unionByName(nothing).select("row.*", *[F.col(f"found.`{name}`").alias(name) for name in take])


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], keys: Sequence[str] = (), bin_rows: int = 1000, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Pairs (left struct, right struct) of rows whose intervals overlap: each starts before the other ends.

    Spans are (start, end) in whole numbers, the end excluded; a span that is empty or has a null
    overlaps nothing. keys: columns that have to be equal too.

    Rows are dealt to the bins of time that they touch, and a pair is made only in the bin where the
    later of the two starts, so once. Bins are as wide as the mean span, so that a row touches two on
    average, and wide enough for about bin_rows rows; those with more than split_rows rows are
    divided again by their own counts. So the join is one of equal bins, and its work follows the rows
    and the pairs, not their product.
    """
    def spans(df: DataFrame, span: tuple[Column, Column], name: str) -> DataFrame:
        own = [F.col(f"`{c}`") for c in df.columns]
        return df.select(F.struct(*own).alias(name), *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], span[0].cast("long").alias("a"), span[1].cast("long").alias("z")).where("a < z")

    mine, theirs = spans(left, left_span, "left"), spans(right, right_span, "right")
    on = [f"k{i}" for i in range(len(keys))]
    both = mine.select("a", "z").unionByName(theirs.select("a", "z"))
    told = both.agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("first"), F.max("z").alias("last"), F.avg(F.col("z").cast("double") - F.col("a")).alias("mean")).first()
    if not told["n"]:
        return mine.join(theirs, on or F.lit(False)).select("left", "right")
    first = told["first"]
    width = max(1, round(told["mean"]), -(-(told["last"] - first) * bin_rows // told["n"]))
    at = lambda c: F.expr(f"({c} - {first}) DIV {width}")

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("bin", F.explode(F.sequence(at("a"), at("z - 1"))))

    counted = dealt(both).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_rows)
    crowded = kept(counted.select("bin", F.greatest(F.lit(1), F.ceil(F.lit(width) / F.ceil(F.col("n") / bin_rows))).cast("long").alias("step")))

    def divided(df: DataFrame) -> DataFrame:
        """Within a crowded bin, the parts of it that a row touches."""
        low = F.col("bin") * width + first
        part = lambda t: F.floor((t - low) / F.col("step")).cast("long")
        inside = F.sequence(part(F.greatest(F.col("a"), low)), part(F.least(F.col("z") - 1, low + width - 1)))
        out = dealt(df).join(_small(crowded), "bin", "left")
        return out.withColumn("part", F.explode(F.when(F.col("step").isNull(), F.array(F.lit(0).cast("long"))).otherwise(inside)))

    l, r = divided(mine), divided(theirs).drop("step").withColumnsRenamed({"a": "ra", "z": "rz"})
    later = F.greatest("a", "ra")
    low = F.col("bin") * width + first + F.col("part") * F.coalesce(F.col("step"), F.lit(0))
    here = (later >= low) & (later < F.least(low + F.coalesce(F.col("step"), F.lit(width)), (F.col("bin") + 1) * width + first))
    met = l.join(r, [*on, "bin", "part"]).where((F.col("a") < F.col("rz")) & (F.col("ra") < F.col("z")) & here)
    return met.select("left", "right")
