"""Grouping sets over partial aggregates, global ranks without one task, and stratified samples. Extensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.temporal import BROADCAST_ROWS, kept

#: Pieces of the range of values that ranks are counted in; rows of one value above which it is broadcast.
PIECES, HOT_ROWS = 500, 10_000


def grouping_sets(df: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], partial: Mapping[str, Column], merge: Mapping[str, Column]) -> DataFrame:
    """keys (null where a set leaves them out), grouping_id and the aggregates of each set.

    partial: aggregates over rows; merge: how their results, by the same names, are put together.
    Rows are aggregated once, by all keys; only those results are repeated for the sets. grouping_id
    has a bit for each key, the first the highest, set where the key is left out; so a null key is
    told from a total.
    """
    base = df.groupBy(*keys).agg(*[c.alias(n) for n, c in partial.items()])

    def one(own: Sequence[str]) -> Column:
        left_out = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in own)
        return F.struct(*[(F.col(k) if k in own else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys], F.lit(left_out).cast("long").alias("grouping_id"))

    spread = base.select(F.explode(F.array(*[one(s) for s in sets])).alias("g"), *partial).select("g.*", *partial)
    return spread.groupBy(*keys, "grouping_id").agg(*[c.alias(n) for n, c in merge.items()])


def cube(keys: Sequence[str]) -> list[list[str]]:
    return [[k for i, k in enumerate(keys) if not m >> i & 1] for m in range(1 << len(keys))]


def rollup(keys: Sequence[str]) -> list[list[str]]:
    return [list(keys[:n]) for n in range(len(keys), -1, -1)]


def ranked_values(df: DataFrame, value: str, pieces: int = PIECES) -> tuple[DataFrame, int]:
    """value, n (its rows), below (rows of smaller values), smaller (smaller values); and how many rows there are.

    Rows are counted by value first. The values are cut into pieces at their quantiles; sums run
    within each piece, and what is before a piece is added from a table of at most `pieces` rows.
    Nulls are left out.
    """
    counts = kept(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")))
    cuts = counts.agg(F.percentile_approx("value", [k / pieces for k in range(1, pieces)], 20 * pieces)).first()[0] or []
    cuts = sorted(set(cuts))
    placed = counts.withColumn("piece", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("value"))) if cuts else F.lit(0))
    sums = placed.groupBy("piece").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values")).collect()  # a row a piece
    offsets, rows, values = [], 0, 0
    for r in sorted(sums, key=lambda r: r["piece"]):
        offsets.append((r["piece"], rows, values))
        rows, values = rows + r["rows"], values + r["values"]
    before = F.broadcast(df.sparkSession.createDataFrame(offsets, "piece int, rows long, values long"))
    w = Window.partitionBy("piece").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("b", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("s", F.count("n").over(w))
    return own.join(before, "piece").select("value", "n", (F.col("b") + F.col("rows")).alias("below"), (F.col("s") + F.col("values")).alias("smaller")), rows


def with_rank(df: DataFrame, value: str, pieces: int = PIECES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds value_rank, dense_rank, cume_dist over all rows, as the window functions of these names give them; null for a null value.

    No window spans all rows. Rows meet the ranks of their value by a join; values of more than
    hot_rows rows, of which there are few, are broadcast, so their rows stay where they are.
    """
    table, total = ranked_values(df, value, pieces)
    table = kept(table)
    ranks = [(F.col("below") + 1).alias("value_rank"), (F.col("smaller") + 1).alias("dense_rank"), ((F.col("below") + F.col("n")) / F.lit(float(max(1, total)))).alias("cume_dist")]
    names = [F.col(f"d.`{c}`") for c in df.columns]

    def met(rows: DataFrame, own: DataFrame, how: str) -> DataFrame:
        return rows.alias("d").join(own.alias("t"), F.col(f"d.`{value}`") == F.col("t.value"), how).select(*names, *ranks)

    hot = table.where(F.col("n") > max(hot_rows, total // BROADCAST_ROWS))
    few = F.broadcast(hot.select("value"))
    rest = df.alias("d").join(few, F.col(f"d.`{value}`") == F.col("value"), "left_anti")
    return met(df, F.broadcast(hot), "inner").unionByName(met(rest, table, "left"))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], pieces: int = PIECES) -> DataFrame:
    """share, value: for each share the smallest value that at least this part of the rows does not pass, exactly."""
    table, total = ranked_values(df, value, pieces)
    wanted = F.broadcast(df.sparkSession.createDataFrame([(float(s), max(1, -int(-s * total // 1))) for s in shares], "share double, at long"))
    return table.join(wanted, (F.col("at") > F.col("below")) & (F.col("at") <= F.col("below") + F.col("n"))).select("share", "value")


def stratified(df: DataFrame, stratum: str, key: str, size: int, seed: int = 0, weight: Column | None = None) -> DataFrame:
    """From each stratum `size` rows, or all if it has fewer, chosen by a hash of seed and key: the same in every run.

    With a weight, a row of twice the weight is about twice as likely; rows of weight 0 or null are
    never taken. Each task keeps at most `size` rows of a stratum before the shuffle, so a stratum of
    any size is no load on one task.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    place = digest if weight is None else -F.log(u) / weight
    rows = df if weight is None else df.where(weight > 0)
    first = Window.partitionBy(stratum).orderBy(F.col("_place"), F.col(key))
    return rows.withColumn("_place", place).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= size).drop("_place", "_k")
