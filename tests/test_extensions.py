"""The extensions against SQL and plain code, with keys and times that a large part of the rows share."""

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon import operators as O
from quillon import plans
from quillon.functions import tables
from quillon.operators import blocks, calibration, grouping, sketches, temporal
from quillon.plans import extensions
from quillon.sources import blobs as vector_blobs
from quillon.streaming import state
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(extensions.ORACLES))
def test_extension_matches_sql(spark, sf, name):
    assert_same(extensions.QUERIES[name](spark, sf), sf, extensions.ORACLES[name])


def brute_asof(left, right):
    out = []
    for i, k, t in left:
        best = max(((rt, v) for rk, rt, v in right if k is not None and t is not None and rk == k and rt is not None and rt <= t), default=(None, None))
        out.append((i, k, t, best[1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [10, 10**6])
def test_asof_join(spark, tmp_path, split):
    rng = random.Random(4)
    key = lambda: rng.choice([None, 1, 1, 1, 1, 2, 3, *range(4, 30)])
    left = [(i, key(), rng.choice([None, *range(60)])) for i in range(700)]
    right = [(key(), rng.choice([None, *range(0, 60, 4)]), i) for i in range(300)]
    l, r = spark.createDataFrame(left, "i int, k int, found int"), spark.createDataFrame(right, "k int, t int, v int")
    for a, b in ((l, r), (l.limit(0), r), (l, r.limit(0))):
        got = temporal.asof_join(a, b, ("k", "found"), ("k", "t"), {"v": "v"}, split)
        want = brute_asof([tuple(x) for x in a.collect()], [tuple(x) for x in b.collect()])
        assert sorted((tuple(x) for x in got.collect()), key=repr) == want


def test_hot_user_takes_many_tasks(spark):
    """One user owns half of the rows; no task gets more than twice the median."""
    own = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 4001)
    events = spark.range(40_000).select("id", own.alias("user"), ((F.col("id") * 7919) % 100_003).alias("t"))
    for k, v in {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}.items():
        spark.conf.set(k, v)
    try:
        rows = temporal.asof_join(events, events.where("id % 3 = 0"), ("user", "t"), ("user", "t"), {"last": "id"}, split_rows=200)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 8 and sum(sizes) == 40_000 and max(sizes) <= 2 * median(sizes)
    assert rows.where("user = 0 AND last IS NULL").count() < 5


@pytest.mark.parametrize("bin_rows,split", [(5, 10), (1000, 10**6), (2, 3)])
def test_interval_join(spark, bin_rows, split):
    rng = random.Random(6)

    def spans(n):
        starts = [rng.choice([rng.randrange(5000), 2500 + rng.randrange(4), None]) for _ in range(n)]  # a third of them in one place
        return [(i, rng.randrange(3), s, None if s is None else s + rng.choice([-1, 0, 1, 2, 5, 40, 900])) for i, s in enumerate(starts)]

    left, right = spans(200), spans(150)
    l, r = (spark.createDataFrame(x, "i int, k int, s long, e long") for x in (left, right))
    overlap = lambda a, b: None not in (*a, *b) and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3]
    for keys in ((), ("k",)):
        got = temporal.interval_join(l, r, (F.col("s"), F.col("e")), (F.col("s"), F.col("e")), keys, bin_rows, split)
        want = sorted((a[0], b[0]) for a in left for b in right if overlap(a, b) and (not keys or a[1] == b[1]))
        assert sorted(tuple(x) for x in got.select("left.i", "right.i").collect()) == want
        assert "NestedLoop" not in plans.plan_text(got) and "Cartesian" not in plans.plan_text(got)
    assert temporal.interval_join(l.limit(0), r.limit(0), (F.col("s"), F.col("e")), (F.col("s"), F.col("e"))).count() == 0


def brute_islands(rows, gap):
    out = []
    for k in {k for k, _, _ in rows}:
        times = sorted((t, c) for own, t, c in rows if own == k)
        for t, c in times:
            if out and out[-1][0] == k and t - out[-1][2] <= gap:
                out[-1] = (k, out[-1][1], t, out[-1][3] + 1, out[-1][4] + c)
            else:
                out.append((k, t, t, 1, c))
    return sorted(out)


@pytest.mark.parametrize("make", [state.sessions, state.expiring_totals])
def test_streams_in_any_order_with_a_restart(spark, tmp_path, make):
    """Batches of events out of order, a late one, and a second run that goes on from the checkpoint."""
    rng = random.Random(9)
    own, schema = state.stateful_session(spark, 2), "user int, ts timestamp, cents long"
    seconds = lambda rows: spark.createDataFrame(rows, "user int, s long, cents long").select("user", F.timestamp_seconds("s").alias("ts"), "cents").coalesce(1)
    rows = [(rng.randrange(6), rng.randrange(3000), rng.randrange(100)) for _ in range(300)]
    feed = lambda rows: seconds(rows).write.mode("append").parquet(f"{tmp_path}/in")
    start = lambda: state.run(make(state.stream_of(own, f"{tmp_path}/in", StructType.fromDDL(schema)), "user", "ts", 60, 500, "cents"), f"{tmp_path}/out", f"{tmp_path}/check")
    parts = [[r for r in rows if k * 400 <= r[1] < (k + 1) * 400] for k in range(8)]
    for p in parts[:4]:
        rng.shuffle(p)
        feed(p)
    start()  # the first run ends with open state
    for p in parts[4:]:
        feed(p)
    feed([(None, 9000, None)])
    start()
    feed([(0, 100, 7), (None, 9001, None)])  # late: dropped
    start()
    got = own.read.parquet(f"{tmp_path}/out").select("user", F.unix_seconds("since"), F.unix_seconds("until"), "n", "cents").collect()
    assert sorted(tuple(r) for r in got) == brute_islands(rows, 60)


def test_batches_do_not_grow_with_files(spark, tmp_path, monkeypatch):
    """A large table's slices come in many files; there are as many batches as for a small one, and the same totals."""
    monkeypatch.setattr(extensions, "shared_folder", lambda _: str(tmp_path))
    rng = random.Random(11)
    rows = [(i, rng.randrange(40), rng.randrange(30 * 86400), rng.randrange(9) / 4) for i in range(4000)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long, value double").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    events.repartition(8).write.parquet(f"{tmp_path}/events.parquet")
    for query, gap in ((extensions.x_sessions, extensions.SESSION_S), (extensions.x_expiring_totals, extensions.IDLE_S)):
        before = set(tmp_path.glob("events-*"))
        got = query(spark, str(tmp_path)).select("user_id", F.unix_seconds(F.col("since").cast("timestamp")), F.unix_seconds(F.col("until").cast("timestamp")), "n", "cents").collect()
        assert sorted(tuple(r) for r in got) == brute_islands([(u, t, round(v * 100)) for _, u, t, v in rows], gap)
        (root,) = set(tmp_path.glob("events-*")) - before
        assert len(list((root / "in").glob("*.parquet"))) > 3 * extensions.SLICES
        assert len(list((root / "checkpoint/commits").glob("[0-9]*"))) <= extensions.SLICES + 3


def test_totals_share_buckets_of_state(spark, tmp_path):
    """Many keys, null and large ones too, in few buckets of state; events without a value count, and a total of them alone is null."""
    rng = random.Random(12)
    own, schema = state.stateful_session(spark, 2), "user long, ts timestamp, cents long"
    keys = [None, *(2**60 + k for k in range(199))]
    rows = [(k, rng.randrange(1, 1000), rng.choice([None, 2**58 + rng.randrange(9)])) for k in keys for _ in range(8)]

    def feed(rows):
        made = spark.createDataFrame(rows, "user long, s long, cents long").select("user", F.timestamp_seconds("s").alias("ts"), "cents")
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def start():
        out = state.expiring_totals(state.stream_of(own, f"{tmp_path}/in", StructType.fromDDL(schema)), "user", "ts", 60, 500, "cents", buckets=7)
        state.run(out, f"{tmp_path}/out", f"{tmp_path}/check")

    for k in range(2):
        feed([r for r in rows if r[1] // 500 == k])
    start()
    held = own.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/check")
    assert 0 < held.count() <= 7
    feed([(None, 9000, None)])
    start()
    want = []
    for key in keys:
        for _, a, z, n, _ in brute_islands([(0, t, 0) for k, t, _ in rows if k == key], 60):
            cents = [c for k, t, c in rows if k == key and a <= t <= z and c is not None]
            want.append((key, a, z, n, sum(cents) if cents else None))
    got = own.read.parquet(f"{tmp_path}/out").select("user", F.unix_seconds("since"), F.unix_seconds("until"), "n", "cents").collect()
    assert any(w[4] is None for w in want) and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_segments_merge():
    assert state.merged([(5, 5, 1, 2), (1, 3, 2, 4), (9, 9, 1, 1)], 3) == [(1, 5, 3, 6), (9, 9, 1, 1)]
    assert state.merged([(1, 9, 3, 3), (4, 4, 1, 1), (13, 13, 1, 1)], 3) == [(1, 9, 4, 4), (13, 13, 1, 1)]


# --- a registered source


def test_blobs_skip_files(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") * k).cast("float") for k in range(3)]).alias("embedding"))
    n = vector_blobs.write(rows, str(tmp_path / "v"), 50)
    df = vector_blobs.read(spark, f"file://{tmp_path}/v")
    assert n >= 20 and df.rdd.getNumPartitions() == n and sorted(map(tuple, df.collect())) == sorted(map(tuple, rows.collect()))
    for condition, most in (("vec_id = 77", 1), ("vec_id > 950 AND vec_id < 990", 3), ("vec_id IN (3, 999)", 2), ("vec_id <= 10 OR vec_id >= 990", n), ("vec_id >= 2000", 1)):
        some = df.where(condition)
        assert some.rdd.getNumPartitions() <= most and {r.vec_id for r in some.collect()} == {r.vec_id for r in rows.where(condition).collect()}
    with pytest.raises(ValueError):
        vector_blobs.local("s3://bucket/x")


# --- a table function


def test_change_points_of_other_types(spark):
    rows = [("a", 1, 5), ("a", 3, None), ("a", 2, 6), ("a", 4, 9), ("b", 1, 0), (None, 1, 1), (None, 2, 50), ("b", 2, -9)]
    spark.createDataFrame(rows, "k string, t int, v int").createOrReplaceTempView("changing")
    tables.register(spark)
    call = lambda names: spark.sql(f"SELECT * FROM {tables.CHANGE_POINTS}(TABLE(changing), {names}, 2.0D)")
    got = call("'k', 't', 'v'")
    assert got.dtypes[:2] == [("k", "string"), ("t", "int")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 4, 9.0, 3.0, 4), ("b", 2, -9.0, -9.0, 2), (None, 2, 50.0, 49.0, 2)], key=repr)
    with pytest.raises(Exception, match="no such column: q"):
        call("'k', 't', 'q'").collect()


# --- grouping sets, ranks, samples


def test_grouping_sets_tell_null_keys_from_totals(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, None, 7), ("x", 1, 2), ("x", 1, 3)], "a string, b int, v int")
    for sets, sql in ((grouping.cube(["a", "b"]), "CUBE(a, b)"), (grouping.rollup(["a", "b"]), "ROLLUP(a, b)"), ([["b"], []], "a, b GROUPING SETS ((b), ())")):
        got = grouping.grouping_sets(df, ["a", "b"], sets, {"s": F.sum("v"), "n": F.count("*")}, {"s": F.sum("s"), "n": F.sum("n")})
        df.createOrReplaceTempView("grouped")
        want = spark.sql(f"SELECT a, b, grouping_id(a, b) AS grouping_id, sum(v) AS s, count(*) AS n FROM grouped GROUP BY {sql}")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert grouping.grouping_sets(df.limit(0), ["a"], [["a"], []], {"n": F.count("*")}, {"n": F.sum("n")}).count() == 0


@pytest.mark.parametrize("pieces,hot", [(3, 5), (500, 10_000)])
def test_ranks_of_all_rows(spark, monkeypatch, pieces, hot):
    monkeypatch.setattr(grouping, "BROADCAST_ROWS", 10**6)
    rng = random.Random(5)
    rows = [(i, rng.choice([1.5, 1.5, None, rng.randrange(40) / 4])) for i in range(400)]  # a third share a value
    df = spark.createDataFrame(rows, "value_id int, v double")
    got = grouping.with_rank(df, "v", pieces, hot)
    values = [v for _, v in rows if v is not None]
    want = [(i, v, *((sum(x < v for x in values) + 1, len({x for x in values if x < v}) + 1, sum(x <= v for x in values) / len(values)) if v is not None else (None,) * 3)) for i, v in rows]
    assert sorted(map(tuple, got.collect())) == sorted(want, key=lambda r: r[0])
    assert grouping.with_rank(df.limit(0), "v").count() == 0
    shares = (0.0, 0.3, 0.5, 1.0)
    cut = {r.share: r.value for r in grouping.quantiles(df, "v", shares, pieces).collect()}
    assert cut == {s: next(x for x in sorted(values) if sum(y <= x for y in values) >= s * len(values)) for s in shares}


def test_rank_has_no_window_over_all_rows(spark, sf):
    text = plans.plan_text(extensions.x_price_rank(spark, sf))
    assert "SinglePartition" not in text


def test_sample_rates(spark):
    """Exact sizes; over many seeds every row is as likely as its weight says."""
    df = spark.range(60).select("id", (F.col("id") % 2).alias("half"), F.when(F.col("id") < 30, 1.0).when(F.col("id") < 58, 3.0).otherwise(0.0).alias("w"))
    light = plain = 0
    for seed in range(30):
        taken = grouping.stratified(df, "half", "id", 5, seed).collect()
        assert sorted(r.half for r in taken) == [0] * 5 + [1] * 5
        plain += sum(r.id < 30 for r in taken)
        heavy = grouping.stratified(df, "half", "id", 5, seed, F.col("w")).collect()
        assert len(heavy) == 10 and all(r.id < 58 for r in heavy)
        light += sum(r.id < 30 for r in heavy)
    assert 110 < plain < 190 and 45 < light < 120  # of 300: half, and about a quarter
    assert grouping.stratified(df, "half", "id", 100).count() == 60


# --- products by blocks


@pytest.mark.parametrize("size,parts,held", [(4, 2, 1), (7, 16, 64)])
def test_block_products(spark, size, parts, held):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-9, 10, (23, 10)), rng.integers(-9, 10, (10, 17))
    table = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "i long, v array<int>")
    blocked = lambda m: blocks.from_vectors(table(m), F.col("i"), F.col("v"), m.shape[1], size)
    for made, want in ((blocks.product(blocked(a), blocked(b), parts, held), a @ b), (blocks.product(blocks.transposed(blocked(a)), blocked(a), parts, held), a.T @ a)):
        got = {(r.i, r.j): r.value for r in blocks.cells(made, size).collect()}
        assert all(got[i, j] == want[i, j] for i in range(want.shape[0]) for j in range(want.shape[1]))
        assert not any(v for (i, j), v in got.items() if i >= want.shape[0] or j >= want.shape[1])


def test_matmul_sums_in_one_order(spark, monkeypatch):
    """Weights in the plan and in batches give the same bits; too many are refused."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 12)))] + [(50, [None] + [1.0] * 11), (51, [1.0]), (52, None)], "vec_id long, embedding array<double>")
    w = rng.normal(size=(12, 9)).tolist()
    here = sorted(map(tuple, O.matmul(df, w).collect()), key=repr)
    monkeypatch.setattr(O, "INLINE_CELLS", 1)
    assert sorted(map(tuple, O.matmul(df, w).collect()), key=repr) == here
    monkeypatch.setattr(O, "LOCAL_CELLS", 100)
    with pytest.raises(ValueError):
        O.matmul(df, w)


def test_sketches_merge_in_any_order(spark, tmp_path):
    df = spark.range(60_000).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("d"), (F.col("id") % 7001).alias("u"))
    sketches.daily(df, F.col("d"), F.col("u")).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    whole = sketches.estimate(sketches.merged(stored)).first()
    again = sketches.estimate(sketches.merged(stored.orderBy(F.desc("day")).repartition(5))).first()
    assert whole.estimate == again.estimate and whole.n == 60_000 and abs(whole.estimate - 7001) < 4 * sketches.standard_error() * 7001
    direct = df.agg(F.hll_sketch_estimate(F.hll_sketch_agg("u", sketches.SLOTS))).first()[0]
    assert abs(whole.estimate - direct) <= 0.01 * direct
    week = {str(r.day): r.n for r in sketches.trailing(stored, 3).collect()}
    assert len(week) == 9 and week["2024-01-01"] == 6667 and week["2024-01-09"] == 3 * 6666


def test_calibration(spark):
    """Outliers are clipped where that lowers the squared error; plain code gives the same errors."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4)).astype(np.float32)
    x[0, 0], x[:, 2], x[:, 3] = 9.0, 0.25, np.abs(x[:, 3])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [float("nan"), None, float("inf"), 0.5])], "vec_id int, embedding array<float>")
    found = {r.channel: r for r in calibration.calibrate(df, -8, 7).collect()}
    assert set(found) == {0, 1, 2, 3} and found[0].share < 0.9 and found[0].error < 0.9 * found[0].plain_error

    def error(c, share):
        v = x[:, c].astype(float)
        v = np.append(v, 0.5) if c == 3 else v
        low, high = min(v.min() * share, 0), max(v.max() * share, 0)
        scale = (high - low) / 15
        zero = np.rint(-8 - low / scale)
        return (((np.clip(np.rint(v / scale) + zero, -8, 7) - zero) * scale - v) ** 2).sum()

    for c, r in found.items():
        assert r.error <= r.plain_error and abs(r.error - error(c, r.share)) < 1e-6 and abs(r.plain_error - error(c, 1.0)) < 1e-6
        assert r.error <= 1.05 * min(error(c, s) for s in calibration.SHARES) + 1e-9
    back = calibration.calibrated_qdq(df, spark.createDataFrame(list(found.values())), -8, 7).where("vec_id = 900").collect()
    assert len(back) == 4 and all(r.dq is None or abs(r.dq) < 10 for r in back)
