"""Stored sketches of distinct counts, merged to any range of days. An extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithm of a sketch's slots, and the relative standard error that goes with it.
SLOTS = 12


def standard_error(slots: int = SLOTS) -> float:
    return 1.04 / 2 ** (slots / 2)


def daily(df: DataFrame, day: Column, item: Column, slots: int = SLOTS) -> DataFrame:
    """day, n, uniques of each day: rows, and a sketch of the items, of a few KB whatever the day holds. To be stored.

    Sketches are built on both sides of the shuffle, so a day of any size is spread over the tasks.
    Null items count as rows only.
    """
    return df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(item, slots).alias("uniques"))


def merged(sketches: DataFrame, *keys: Column) -> DataFrame:
    """keys, n, uniques of any groups of days: the union of their sketches, in whatever order they come."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("uniques").alias("uniques"))


def trailing(sketches: DataFrame, days: int) -> DataFrame:
    """day, n, uniques of the `days` days up to each; a day's sketch is handed to the days that it counts for."""
    ahead = F.explode(F.sequence(F.col("day"), F.date_add("day", days - 1)))
    spread = sketches.select(ahead.alias("on"), "n", "uniques")
    return merged(spread.join(sketches.select(F.col("day").alias("on")), "on", "left_semi"), F.col("on").alias("day"))


def estimate(sketches: DataFrame, out: str = "estimate") -> DataFrame:
    return sketches.withColumn(out, F.hll_sketch_estimate("uniques"))
