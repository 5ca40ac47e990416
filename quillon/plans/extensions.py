"""Registered extensions: operations that the reference has no counterpart of, named x_*, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import sources as S
from quillon.functions import tables
from quillon.operators import blocks as blocks_of
from quillon.operators import calibration, grouping, sketches, temporal
from quillon.plans import queries as core
from quillon.session import shared_folder
from quillon.sources import blobs
from quillon.streaming import state


def x_asof_join(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the latest order of its user before it."""
    events = S.table(spark, d, "events").select("event_id", "user_id", "ts")
    orders = S.table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return temporal.asof_join(events, orders, ("user_id", "ts"), ("o_custkey", "o_orderdate"), {"order_id": "o_orderkey"}).select("event_id", "order_id")


def x_asof_purchase(spark: SparkSession, d: str) -> DataFrame:
    """Each event with its user's latest purchase up to then."""
    events = S.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = events.where("event_type = 'purchase'")
    return temporal.asof_join(events, bought, ("user_id", "ts"), ("user_id", "ts"), {"purchase_id": "event_id", "paid": "value"}).select("event_id", "purchase_id", "paid")


def x_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Purchases within ten minutes after an error, of any user."""
    events = S.table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    errors, bought = events.where("event_type = 'error'"), events.where("event_type = 'purchase'")
    pairs = temporal.interval_join(errors, bought, (F.col("t"), F.col("t") + 600_000_000), (F.col("t"), F.col("t") + 1))
    return pairs.select(F.col("left.event_id").alias("error_id"), F.col("right.event_id").alias("purchase_id"))


#: Slices that a finite table is streamed in; how long a session, and a total, outlasts its last event.
SLICES, SESSION_S, IDLE_S = 5, 6 * 3600, 36 * 3600


def _streamed(spark: SparkSession, d: str, make: Callable[..., DataFrame], gap_s: int) -> DataFrame:
    """The events as a stream, through `make`, in the folder of spark.checkpoint.dir."""
    root = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    own = state.stateful_session(spark)
    events = S.table(own, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    width = state.slices(own, events, f"{root}/in", "ts", SLICES, gap_s)
    files = state.files_a_batch(own, f"{root}/in", events.schema, SLICES + 1)
    state.run(make(state.stream_of(own, f"{root}/in", events.schema, files), "user_id", "ts", gap_s, width, "cents"), f"{root}/out", f"{root}/checkpoint")
    plain = lambda c: F.to_utc_timestamp(c, "UTC").cast("timestamp_ntz").alias(c)
    out = own.read.schema("user_id long, since timestamp, until timestamp, n long, cents long").parquet(f"{root}/out")
    return out.select("user_id", plain("since"), plain("until"), "n", "cents")


def x_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's sessions, with six hours between them, from a stream with a watermark."""
    return _streamed(spark, d, state.sessions, SESSION_S)


def x_expiring_totals(spark: SparkSession, d: str) -> DataFrame:
    """Each user's running totals, which expire when the user is idle for a day and a half, by timers on keyed state."""
    buckets = state.buckets_for(S.table(spark, d, "events"), "user_id")
    return _streamed(spark, d, partial(state.expiring_totals, buckets=buckets), IDLE_S)


def x_vector_blobs(spark: SparkSession, d: str) -> DataFrame:
    """The vectors written as blobs and read by the registered source; those beyond the first hundred ids."""
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    blobs.write(S.vectors(spark, d), folder, 200)
    return blobs.read(spark, folder).where("vec_id >= 100").select("vec_id", F.posexplode("embedding").alias("i", "v"))


def x_change_points(spark: SparkSession, d: str) -> DataFrame:
    """Where a user's value is more than 150 away from the one before, by a table function."""
    tables.register(spark)
    view = f"events_{uuid.uuid4().hex}"
    S.table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "value").createOrReplaceTempView(view)
    out = spark.sql(f"SELECT * FROM {tables.CHANGE_POINTS}(TABLE({view}), 'user_id', 'at', 'value', 150.0D)")
    spark.catalog.dropTempView(view)
    return out.select("user_id", F.col("at.event_id").alias("event_id"), "value", "change", "position")


def x_error_cube(spark: SparkSession, d: str) -> DataFrame:
    """Quantization errors by label and bucket, each alone, and in all; bucket 3 has no name."""
    rows = core._checked(spark, d).select("label", F.nullif(F.col("vec_id") % 7, F.lit(3)).alias("bucket"), "max_error")
    keys = ["label", "bucket"]
    partial = {"n": F.count(F.lit(1)), "max_error": F.max("max_error")}
    return grouping.grouping_sets(rows, keys, grouping.cube(keys), partial, {"n": F.sum("n"), "max_error": F.max("max_error")})


def x_price_rank(spark: SparkSession, d: str) -> DataFrame:
    """Each order's rank by price among all, with no window over all."""
    return grouping.with_rank(S.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").drop("o_totalprice")


def x_price_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return grouping.quantiles(S.table(spark, d, "lineitem").select("l_extendedprice"), "l_extendedprice", SHARES)


def x_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty events of each type."""
    return grouping.stratified(S.table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 50, seed=3)


def x_weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    """Forty orders of each priority, likelier the dearer they are."""
    orders = S.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return grouping.stratified(orders, "o_orderpriority", "o_orderkey", 40, seed=4, weight=F.col("o_totalprice")).drop("o_totalprice")


def x_gram_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The quantized vectors' transpose times themselves, by blocks; whole numbers, so sums are exact in any order."""
    rows = core._qdq(spark, d).select("vec_id", "q")
    m = blocks_of.from_vectors(rows, F.col("vec_id"), F.col("q"), core.WIDTH)
    return blocks_of.cells(blocks_of.product(blocks_of.transposed(m), m))


def x_daily_uniques(spark: SparkSession, d: str) -> DataFrame:
    """Users of the seven days up to each, from daily sketches: rows, exact users, and whether the estimate is within four standard errors of them."""
    events = S.table(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id")
    told = sketches.estimate(sketches.trailing(sketches.daily(events, F.col("day"), F.col("user_id")), 7))
    week = events.distinct().select(F.explode(F.sequence("day", F.date_add("day", 6))).alias("day"), "user_id")
    exact = week.groupBy("day").agg(F.countDistinct("user_id").alias("users"))
    close = F.abs(F.col("estimate") - F.col("users")) <= 4 * sketches.standard_error() * F.col("users") + 1
    return told.join(exact, "day").select("day", "n", "users", close.alias("within"))


def x_calibrated_qdq(spark: SparkSession, d: str) -> DataFrame:
    """For each channel, whether calibration to 4 bits errs no more than the whole range does, by what both give for every value."""
    vectors, lo, hi = S.vectors(spark, d), -8, 7
    found = temporal.kept(calibration.calibrate(vectors, lo, hi))
    values = vectors.select("vec_id", F.posexplode("embedding").alias("channel", "x"))
    back = calibration.calibrated_qdq(vectors, found, lo, hi)
    errors = values.join(back, ["vec_id", "channel"]).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col("x").cast("double") - F.col("dq"), 2)).alias("e"))
    return errors.join(F.broadcast(found), "channel").select("channel", "n", (F.col("e") <= F.col("plain_error") * (1 + 1e-9)).alias("no_worse"), (F.abs(F.col("e") - F.col("error")) <= 1e-9 * F.col("e")).alias("as_told"))


#: Parts of the rows that the quantiles are taken at.
SHARES = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (x_asof_join, x_asof_purchase, x_interval_join, x_sessions, x_expiring_totals, x_vector_blobs, x_change_points, x_error_cube, x_price_rank, x_price_quantiles, x_sample, x_weighted_sample, x_gram_blocks, x_daily_uniques, x_calibrated_qdq)}



def _islands_sql(gap_s: int) -> str:
    return f"""
        WITH marked AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER own <= INTERVAL {gap_s} SECOND THEN 0 ELSE 1 END AS fresh FROM events WINDOW own AS (PARTITION BY user_id ORDER BY ts, event_id)),
        numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM marked)
        SELECT user_id, min(ts) AS since, max(ts) AS until, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM numbered GROUP BY user_id, island"""


ORACLES: dict[str, str] = {
    "x_asof_join": """
        SELECT e.event_id, o.order_id FROM events e ASOF LEFT JOIN
            (SELECT o_custkey, o_orderdate, max(o_orderkey) AS order_id FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""",
    "x_asof_purchase": """
        SELECT e.event_id, p.best.id AS purchase_id, p.best.v AS paid FROM events e ASOF LEFT JOIN
            (SELECT user_id, ts, max(struct_pack(id := event_id, v := value)) AS best FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts""",
    "x_interval_join": """
        SELECT e.event_id AS error_id, p.event_id AS purchase_id FROM events e JOIN events p ON p.ts >= e.ts AND p.ts < e.ts + INTERVAL 10 MINUTE
        WHERE e.event_type = 'error' AND p.event_type = 'purchase'""",
    "x_sessions": _islands_sql(SESSION_S),
    "x_expiring_totals": _islands_sql(IDLE_S),
    "x_vector_blobs": "SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS i, unnest(embedding) AS v FROM embeddings WHERE vec_id >= 100",
    "x_change_points": """
        SELECT user_id, event_id, value, value - before AS change, position FROM
            (SELECT *, lag(value) OVER own AS before, row_number() OVER own AS position FROM events WINDOW own AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE abs(value - before) > 150""",
    "x_error_cube": f"""
        SELECT label, bucket, GROUPING_ID(label, bucket) AS grouping_id, count(*) AS n, max(max_error) AS max_error FROM (SELECT label, nullif(vec_id % 7, 3) AS bucket, max_error FROM ({core._ERR})) GROUP BY CUBE (label, bucket)""",
    "x_price_rank": "SELECT o_orderkey, rank() OVER own AS value_rank, dense_rank() OVER own AS dense_rank, cume_dist() OVER own AS cume_dist FROM orders WINDOW own AS (ORDER BY o_totalprice)",
    "x_price_quantiles": f"""
        WITH placed AS (SELECT l_extendedprice AS value, row_number() OVER (ORDER BY l_extendedprice) AS k, count(*) OVER () AS n FROM lineitem)
        SELECT share, value FROM placed JOIN (SELECT unnest([{", ".join(f"{s}::DOUBLE" for s in SHARES)}]) AS share) ON k = greatest(1, ceil(share * n))""",
    "x_sample": "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('3:' || event_id), event_id) <= 50",
    "x_weighted_sample": """
        SELECT o_orderkey, o_orderpriority FROM (SELECT *, (CAST('0x' || substr(md5('4:' || o_orderkey), 1, 12) AS BIGINT) + 0.5::DOUBLE) / (1::BIGINT << 48)::DOUBLE AS u FROM orders WHERE o_totalprice > 0)
        QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY -ln(u) / o_totalprice, o_orderkey) <= 40""",
    "x_gram_blocks": f"""
        WITH e AS (SELECT vec_id, i, CAST(q AS DOUBLE) AS q FROM ({core._Q}))
        SELECT CAST(a.i AS BIGINT) AS i, CAST(b.i AS BIGINT) AS j, sum(a.q * b.q) AS value FROM e a JOIN e b USING (vec_id) GROUP BY ALL""",
    "x_daily_uniques": """
        WITH own AS (SELECT CAST(ts AS DATE) AS day, user_id FROM events)
        SELECT a.day, count(*) AS n, count(DISTINCT user_id) AS users, true AS within FROM (SELECT DISTINCT day FROM own) a JOIN own b ON b.day BETWEEN a.day - 6 AND a.day GROUP BY a.day""",
    "x_calibrated_qdq": "SELECT channel, count(*) AS n, true AS no_worse, true AS as_told FROM (SELECT CAST(unnest(range(64)) AS INTEGER) AS channel FROM embeddings) GROUP BY channel",
}
