"""Event-time streams that keep state: sessions by watermark, and totals that expire by timers. Extensions."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MICROS = 1_000_000


def slices(spark: SparkSession, events: DataFrame, folder: str, time: str, count: int, gap_s: int) -> int:
    """Writes events(time timestamp, ...) into `folder` as `count` slices of time, in order, and one empty-handed row after them all.

    Returns the width of a slice in seconds. A watermark that lags by it takes no row of a slice for
    late, in however many files and batches the slice comes; the last row, with nulls but for its
    time, moves the watermark past the end of every state that lasts gap_s.
    """
    micros = F.unix_micros(F.col(time))
    first, last = events.agg(F.min(micros), F.max(micros)).first()
    if first is None:
        return 1
    width = (last - first) // count // MICROS + 1
    for k in range(count):
        own = (micros - first >= k * width * MICROS) & (micros - first < (k + 1) * width * MICROS)
        events.where(own).write.mode("append").parquet(folder)
    end = F.timestamp_micros(F.lit(last + (2 * gap_s + 2 * width) * MICROS))
    spark.range(1).select(*[(end if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]).write.mode("append").parquet(folder)
    return width


def files_a_batch(spark: SparkSession, folder: str, schema: StructType, batches: int) -> int:
    """How many files of `folder` a batch takes for about so many batches: large slices come in many files, and each batch costs every partition of state a commit."""
    return max(1, -(-len(spark.read.schema(schema).parquet(folder).inputFiles()) // batches))


def stream_of(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def sessions(stream: DataFrame, key: str, time: str, gap_s: int, delay_s: int, cents: str) -> DataFrame:
    """key, since, until, n, cents of each session: events of a key, each at most gap_s after another. Late rows are dropped."""
    window = F.session_window(F.col(time), F.lit(f"{gap_s} seconds"))
    out = stream.withWatermark(time, f"{delay_s} seconds").groupBy(window, F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("cents"))
    return out.select(key, F.col("session_window.start").alias("since"), (F.col("session_window.end") - F.expr(f"INTERVAL {gap_s} SECONDS")).alias("until"), "n", "cents")


Segment = tuple[int, int, int, int | None]


def merged(segments: list[Segment], gap: int) -> list[Segment]:
    """Segments (first, last, n, cents) joined where one begins at most gap after another's last. Cents that are None add nothing."""
    out: list[Segment] = []
    for a, z, n, c in sorted(segments, key=itemgetter(0)):
        if out and a - out[-1][1] <= gap:
            p = out.pop()
            a, z, n, c = p[0], max(p[1], z), p[2] + n, p[3] if c is None else c if p[3] is None else p[3] + c
        out.append((a, z, n, c))
    return out


#: Keys that share a bucket of state, about; and the fewest buckets, so that partitions of state get about as many each.
KEYS_A_BUCKET, LEAST_BUCKETS = 250, 128


def buckets_for(rows: DataFrame, key: str) -> int:
    """Buckets for the keys of `rows`; they grow with the keys, so that what a bucket holds does not."""
    return max(LEAST_BUCKETS, rows.agg(F.approx_count_distinct(key)).first()[0] // KEYS_A_BUCKET)


def expiring_totals(stream: DataFrame, key: str, time: str, gap_s: int, delay_s: int, cents: str, buckets: int = 1024) -> DataFrame:
    """key, since, until, n, cents of each total of a key, when it has expired: no event of the key for more than gap_s.

    A key's open totals are narrow and as many as fit between watermark and gap. State is kept for
    buckets of keys, so that a batch reads and writes it once a bucket, not once a key: every call for
    state or timers is a round trip between Python and the engine. A bucket has one timer, at the
    first moment that one of its totals expires. Events in any order within the delay join totals that
    they lie between, and the timer moves; it hands out the totals that are over and forgets them.
    A stream that is started again needs the same number of buckets.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    gap, kind = gap_s * MICROS, stream.schema[key].dataType.simpleString()

    class Totals(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.open = handle.getValueState("open", f"key array<{kind}>, void array<boolean>, a array<bigint>, z array<bigint>, n array<bigint>, c array<bigint>")

        def _held(self) -> dict[tuple, list[Segment]]:
            held: dict[tuple, list[Segment]] = {}
            for k, void, *segment in zip(*(self.open.get() or ()), strict=True):
                held.setdefault((k, void), []).append(tuple(segment))
            return held

        def _hold(self, held: dict[tuple, list[Segment]], timer: int | None) -> None:
            """Stores what is open and moves the timer, which stood at `timer`, to the first that expires."""
            rows = [(*k, *s) for k, segments in held.items() for s in segments]
            if rows:
                self.open.update(tuple(map(list, zip(*rows, strict=True))))
            else:
                self.open.clear()
            first = _first_expiry(held, gap)
            if first != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                if first is not None:
                    self.handle.registerTimer(first)

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            held = self._held()
            timer = _first_expiry(held, gap)
            for batch in rows:
                fresh: dict[tuple, list[Segment]] = {}
                for k, void, t, c, empty in zip(*(batch[name].tolist() for name in ("key", "void", "t", "c", "empty")), strict=True):
                    fresh.setdefault((k, void), []).append((t, t, 1, None if empty else c))
                for k, segments in fresh.items():
                    held[k] = merged(held.get(k, []) + segments, gap)
            self._hold(held, timer)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            import pandas as pd

            moment, held = expiredTimerInfo.getExpiryTimeInMs(), self._held()
            now = max(moment, timerValues.getCurrentWatermarkInMs())
            done = [(None if void else k, *s) for (k, void), segments in held.items() for s in segments if _expiry(s, gap) <= now]
            left = {k: [s for s in segments if _expiry(s, gap) > now] for k, segments in held.items()}
            self._hold({k: segments for k, segments in left.items() if segments}, None)  # the engine deletes a timer that went off
            if done:
                yield pd.DataFrame(done, columns=["key", "a", "z", "n", "c"], dtype=object)

        def close(self) -> None:
            pass

    own = F.col(key)
    # a null would turn the whole numbers beside it into floats on their way to Python, so that nulls are told by columns of their own
    rows = stream.withWatermark(time, f"{delay_s} seconds").select(
        F.pmod(F.xxhash64(own), F.lit(buckets)).cast("int").alias("bucket"),
        F.coalesce(own, F.lit("0").try_cast(kind)).alias("key"),
        own.isNull().alias("void"),
        F.unix_micros(time).alias("t"),
        F.coalesce(F.col(cents).cast("long"), F.lit(0)).alias("c"),
        F.col(cents).isNull().alias("empty"),
        time,
    )
    out = rows.groupBy("bucket").transformWithStateInPandas(Totals(), f"key {kind}, a long, z long, n long, c long", "append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("a").alias("since"), F.timestamp_micros("z").alias("until"), "n", F.col("c").alias("cents"))


def _expiry(segment: Segment, gap: int) -> int:
    """The first millisecond after the last time that the segment takes an event."""
    return (segment[1] + gap) // 1000 + 1


def _first_expiry(held: dict[tuple, list[Segment]], gap: int) -> int | None:
    return min((_expiry(s, gap) for segments in held.values() for s in segments), default=None)


#: What operators with state and timers need; most partitions of state, each of which has its own files in every batch.
STORE, STATE_PARTITIONS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", 32


def stateful_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session beside this one, for streams with state; settings of this one stay as they are."""
    own = spark.newSession()
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": STORE,
        "spark.sql.shuffle.partitions": str(partitions or min(STATE_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))),
    }.items():
        own.conf.set(k, v)
    return own


def run(out: DataFrame, folder: str, checkpoint: str) -> None:
    """Takes what there is in batches, appends what is finished to `folder`, and ends; started again, it goes on from the checkpoint."""
    query = out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
