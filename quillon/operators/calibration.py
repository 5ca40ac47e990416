"""Scale and zero point for each channel of a quantization, from the data. An extension of the quantize round trip.

Two passes over the vectors: the range of each channel, then a histogram of BINS equal bins in that
range. Ranges and histograms merge before the shuffle, so what moves is a few numbers a channel and
task. The search looks at the histograms only: for each of some clipped ranges the squared error
of the round trip, values taken to lie at the middle of their bin; the best of them may be no
better for the values themselves, so both it and the whole range are measured on the data in a
third pass, and the better one stays. So the error is never above that of the whole range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a histogram; parts of the range that are tried.
BINS, SHARES = 1024, tuple(1 - k / 40 for k in range(20))


def parameters(low: Column, high: Column, lo: int, hi: int) -> tuple[Column, Column]:
    """Scale and zero point that map low to high, widened to hold zero, onto lo to hi."""
    low, high = F.least(low, F.lit(0.0)), F.greatest(high, F.lit(0.0))
    scale = F.when(high > low, (high - low) / float(hi - lo)).otherwise(1.0)
    return scale, F.rint(F.lit(float(lo)) - low / scale)


def round_trip(x: Column, scale: Column, zero: Column, lo: int, hi: int) -> Column:
    q = F.least(F.greatest(F.rint(x / scale) + zero, F.lit(float(lo))), F.lit(float(hi)))
    return (q - zero) * scale


def _channels(vectors: DataFrame, value: str) -> DataFrame:
    """channel, x of every finite value."""
    x = F.col("x").cast("double")
    return vectors.select(F.posexplode(value).alias("channel", "x")).select("channel", x.alias("x")).where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')")


def calibrate(vectors: DataFrame, lo: int, hi: int, value: str = "embedding", bins: int = BINS) -> DataFrame:
    """channel, share, scale, zero, error, plain_error: the best clipping of each channel, its squared error and that without clipping."""
    rows = _channels(vectors, value)
    spans = rows.groupBy("channel").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    width = (F.col("high") - F.col("low")) / float(bins)
    bin_of = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("x") - F.col("low")) / width), F.lit(bins - 1))).otherwise(0)
    counts = rows.join(F.broadcast(spans), "channel").groupBy("channel", "low", "high", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    tried = counts.withColumn("share", F.explode(F.array(*[F.lit(s) for s in SHARES])))
    scale, zero = parameters(F.col("low") * F.col("share"), F.col("high") * F.col("share"), lo, hi)
    tried = tried.withColumn("scale", scale).withColumn("zero", zero).withColumn("middle", F.col("low") + (F.col("bin") + 0.5) * width)
    missed = F.col("middle") - round_trip(F.col("middle"), F.col("scale"), F.col("zero"), lo, hi)
    sums = tried.groupBy("channel", "share", "scale", "zero").agg(F.sum(F.col("n") * missed * missed).alias("error"))
    best = sums.groupBy("channel").agg(F.min_by(F.struct("share", "scale", "zero"), F.struct("error", -F.col("share"))).alias("best"), F.min_by(F.struct("share", "scale", "zero"), -F.col("share")).alias("plain"))
    square = lambda own: F.pow(F.col("x") - round_trip(F.col("x"), F.col(f"{own}.scale"), F.col(f"{own}.zero"), lo, hi), 2)
    held = rows.join(F.broadcast(best), "channel").groupBy("channel", "best", "plain").agg(F.sum(square("best")).alias("a"), F.sum(square("plain")).alias("b"))
    chosen = F.when(F.col("a") <= F.col("b"), F.col("best")).otherwise(F.col("plain"))
    return held.select("channel", chosen.alias("c"), F.least("a", "b").alias("error"), F.col("b").alias("plain_error")).select("channel", "c.*", "error", "plain_error")


def calibrated_qdq(vectors: DataFrame, found: DataFrame, lo: int, hi: int, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """key, channel, dq: each value through the round trip of its channel; NaN and infinities are clipped like any value."""
    x = F.when(F.isnan("x"), F.lit(float("-inf"))).otherwise(F.col("x").cast("double"))
    rows = vectors.select(key, F.posexplode(value).alias("channel", "x"))
    return rows.join(F.broadcast(found.select("channel", "scale", "zero")), "channel").select(key, "channel", round_trip(x, F.col("scale"), F.col("zero"), lo, hi).alias("dq"))
