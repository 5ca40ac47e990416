import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import functions as Q
from quillon import operators as O
from quillon import plans
from quillon import sources as S
from quillon.plans import queries as core
from quillon import session as L
from quillon.session import Registry, teardown
from quillon.streaming import checked_stream, vector_stream
from tests.conftest import ROOT
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_matches_sql(spark, sf, name):
    assert_same(core.QUERIES[name](spark, sf), sf, core.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - {"batch_inference", "provider_run"}))
def test_queries_stay_native(spark, sf, name):
    plans.require_native(core.QUERIES[name](spark, sf))


def test_strict_check_finds_python(spark, sf):
    with pytest.raises(plans.FallbackError):
        plans.require_native(core.batch_inference(spark, sf))


NAN, INF = math.nan, math.inf
EDGES = [
    ([1, 2, 3, 4], [1, 2, 3, 4], True, True), ([1.1, 2, 3, 4], [1, 2, 3, 4], True, True), ([1.2, 2, 3, 4], [1, 2, 3, 4], False, False),
    ([0.11], [0], True, True), ([NAN, 2, 3, 4], [1, 2, 3, 4], False, True), ([INF, 2, 3, 4], [1, 2, 3, 4], False, False),
    ([1, 2, 3], [1, 2, 3, 4], False, False), ([1, 2, 3, 4, 9], [1, 2, 3, 4], True, True), ([], [], True, True), (None, [1], False, False),
    ([None, 2], [1, 2], False, False), ([9, 2], [None, 2], False, False), ([None], [None], False, False), ([1, 2, None], [1, 2], True, True), ([1], None, False, False),
]


@pytest.mark.parametrize("policy,at", [("fail", 2), ("ignore", 3)])
def test_edges(spark, policy, at):
    fl = lambda v: None if v is None else [None if x is None else float(x) for x in v]
    df = S.cases(spark, [(i, fl(a), fl(b)) for i, (a, b, *_) in enumerate(EDGES)])
    got = {r.case_id: r["pass"] for r in O.tolerance_check(df, "input", "expected", nan_policy=policy).collect()}
    assert got == {i: e[at] for i, e in enumerate(EDGES)}


def test_quantize_edges(spark):
    xs = [0.5, 1.5, 2.5, -2.5, 1e9, -1e9, NAN, INF, -INF]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    assert [r[0] for r in df.select(Q.quantize(F.col("x"), 1.0, 0, -8, 7)).collect()] == [0, 2, 2, -2, 7, -8, -8, 7, -8]


def test_strict_mode_raises(spark):
    with pytest.raises(Exception, match="Validation failed"):
        O.tolerance_check(S.cases(spark, [(0, [2.0], [1.0])]), "input", "expected", strict=True).collect()
    report = O.guarded_report(lambda: O.tolerance_check(S.cases(spark, [(0, [2.0], [1.0])]), "input", "expected", strict=True), spark).first()
    assert report.status == "FAILED" and "Validation failed" in report.error


def test_matmul_forms_agree(spark, sf):
    v = S.vectors(spark, sf)
    w = core.dense_weights()
    cells = spark.createDataFrame([(i, j, w[i][j]) for i in range(64) for j in range(64)], "i int, j int, w double")
    a = O.matmul(v, w).select("vec_id", F.posexplode("y").alias("j", "y"))
    assert a.exceptAll(O.matmul_relational(v, cells).select("vec_id", "j", "y")).isEmpty()


def test_sources_and_lifecycle(spark, sf, tmp_path):
    p = tmp_path / "model.bin"
    p.write_bytes(b"abc")
    assert S.blob(spark, str(p)).first().length == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.blob(spark, str(tmp_path / "none")).collect()
    assert S.signature(S.self_check(spark)).count() == 3
    assert S.runtime(spark).first().engine_version == spark.version
    assert not O.provider_filter(S.providers(spark), "ep_name", "spark", required=True).isEmpty()
    with pytest.raises(LookupError):
        O.provider_filter(S.providers(spark), "ep_name", "npu", required=True)
    r = Registry(spark)
    r.register("plus_one", lambda x: x + 1, "long")
    assert spark.sql("select plus_one(1)").first()[0] == 2
    seen = []
    failed = teardown(("a", lambda: 1 / 0), ("b", lambda: seen.append(r.unregister())))
    assert [f[0] for f in failed] == ["a"] and seen == [["plus_one"]]
    assert O.timed(S.self_check(spark)) > 0
    logged = []
    assert O.log_rows(spark.range(300).repartition(3), logged.append) == 300 and sorted(r["id"] for r in logged) == list(range(300))
    assert O.log_rows(S.self_check(spark)) == 1 and O.log_rows(spark.range(0)) == 0
    row = spark.range(1).select(Q.nanos_to_millis(F.lit(1500000)).alias("ms"), Q.fixed3(F.lit(1.25)).alias("s"), Q.join_path(F.lit("a"), F.lit("b")).alias("p"), Q.option_map({"backend": "x"}).alias("m"), Q.first_match((F.lit(False), F.lit(1)), (F.lit(True), F.lit(2)), default=F.lit(3)).alias("c")).first()
    assert (row.ms, row.s, row.p, row.m, row.c) == (1.5, "1.250", "a/b", {"backend": "x"}, 2)
    assert O.status_report(O.tolerance_check(S.cases(spark, []), "input", "expected")).first().status == "PASS"


def test_stream(spark, tmp_path):
    S.cases(spark, [(0, [1.0], [1.0]), (1, [2.0], [1.0])]).write.parquet(str(tmp_path / "in"))
    q = checked_stream(vector_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("checked").start()
    q.processAllAvailable()
    q.stop()
    assert {r.case_id: r["pass"] for r in spark.table("checked").collect()} == {0: True, 1: False}


def test_properties(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(0, 0.5, 16).astype(np.float32).tolist(), rng.normal(0, 0.5, 16).astype(np.float32).tolist()) for i in range(300)]
    df = S.cases(spark, rows)
    scale, zero_point, lo, hi = 1 / 64, 5, -40, 50
    for r in O.qdq(df, scale, zero_point, lo, hi, "input").collect():
        for x, q, dq in zip(r.input, r.q, r.dq):
            low, high = (lo - zero_point) * scale, (hi - zero_point) * scale
            assert lo <= q <= hi
            assert abs(dq - x) <= scale / 2 + 1e-12 if low <= x <= high else abs(abs(dq - x) - max(low - x, x - high)) <= scale / 2 + 1e-12
    eye = [[float(i == j) for j in range(16)] for i in range(16)]
    assert all(r.y == r.input for r in O.matmul(df, eye, "input").collect())
    same = O.tolerance_check(df, "input", "input").select("max_error", "pass").distinct().collect()
    assert [tuple(r) for r in same] == [(0.0, True)]
    differ = O.tolerance_check(df, "input", "expected").collect()
    assert all(math.isclose(r.max_error, max(abs(a - b) for a, b in zip(r.input, r.expected)), rel_tol=1e-6) and r.max_error > 0 for r in differ)


def test_vectors_of_other_lengths(spark):
    df = S.cases(spark, [(0, [1.0, 2.0], None), (1, [1.0], None), (2, None, None), (3, [], None)])
    got = {r.case_id: r.y for r in O.matmul(df, [[1.0, 0.5], [0.0, 2.0]], "input").collect()}
    assert got == {0: [1.0, 4.5], 1: None, 2: None, 3: None}
    assert O.pick_output(df, 1).columns == ["input"] and O.typed(df.select("case_id"), "case_id long").count() == 4
    assert O.compiled(df) >= 0 and S.setting(spark, "spark.master").startswith("local") and S.setting(spark, "no.such", "x") == "x"


def test_unknown_elements(spark):
    df = S.cases(spark, [(0, [1.0, None], None), (1, [3.0, -4.0], None), (2, [None, None], None), (3, [], None), (4, None, None)])
    assert {r.case_id: r.m for r in df.select("case_id", Q.max_abs(F.col("input")).alias("m")).collect()} == {0: None, 1: 4.0, 2: None, 3: 0.0, 4: None}
    got = {r.case_id: r.y for r in O.matmul(df, [[1.0, 0.5], [0.0, 2.0]], "input").collect()}
    assert got == {0: [None, None], 1: [3.0, -6.5], 2: [None, None], 3: None, 4: None}
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 1, 2.0)], "i int, j int, w double")
    want = {(0, 0): 1.0, (0, 1): None, (1, 0): 3.0, (1, 1): -6.5, (2, 0): None, (2, 1): None}
    for most in (100, 0):  # broadcast; dealt in copies
        assert {(r.case_id, r.j): r.y for r in O.matmul_relational(df, cells, "case_id", "input", broadcast_cells=most, salts=3).collect()} == want


def test_large_weights(spark):
    rng = np.random.default_rng(1)
    w = rng.integers(-4, 5, (300, 300)) / 8
    x = rng.integers(-8, 9, (20, 300)) / 4
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)] + [(20, [1.0], None), (21, None, None), (22, [None] + [1.0] * 299, None)]
    got = {r.case_id: r.y for r in O.matmul(S.cases(spark, rows), w.tolist(), "input").collect()}
    assert all(got[i] == (x[i] @ w).tolist() for i in range(20)) and got[20] is None and got[21] is None and got[22] == [None] * 300


def test_observed_metrics(spark):
    rows = [(i, [float(i % 3)], [0.0]) for i in range(30)]
    df, seen = O.observed(O.tolerance_check(S.cases(spark, rows), "input", "expected"), "checked")
    assert df.count() == 30 and seen.get == {"n": 30, "n_pass": 10, "max_error": 2.0}


def test_dedent(spark):
    texts = ["  a\n   b\n", "\n    x\n\n      y\n  ", "plain", "", "\n\n", "a\n  b", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.d for r in df.select("i", Q.dedent(F.col("t")).alias("d")).collect()}
    assert got == {0: "a\n b", 1: "x\n\n  y", 2: "plain", 3: "", 4: "", 5: "a\n  b", 6: None}


def test_typed_raises_on_other_types(spark):
    with pytest.raises(Exception, match="INVALID_COLUMN_OR_FIELD_DATA_TYPE"):
        O.typed(S.self_check(spark).select("case_id", F.lit("x").alias("input")), "case_id long, input array<float>")


def test_guards():
    class Handle:
        open = 1

        def close(self):
            self.open -= 1

    assert L.call(None, "close") is None and L.call("a b", "split", " ") == ["a", "b"]
    assert L.when_set(0, lambda: 1 / 0) is None and L.when_set(1, lambda: 7) == 7
    h = Handle()
    with pytest.raises(KeyError), L.released(h) as own:
        assert own is h and h.open
        raise KeyError("inside")
    assert h.open == 0
    with L.released(None) as own:
        assert own is None


def test_engine_scope(spark):
    with L.engine(stop=False) as (own, registry):
        registry.define("quillon_twice", "x INT", "INT", "x * 2")
        assert own.sql("select quillon_twice(4)").first()[0] == 8
    with pytest.raises(Exception, match="UNRESOLVED_ROUTINE"):
        spark.sql("select quillon_twice(4)").collect()
    with pytest.raises(RuntimeError, match="before the engine starts"):
        L.start(executor_env={"A": "1"})


START = """
import os
from quillon import session as L
with L.engine(app="t", master="local[1]", options={"spark.ui.enabled": "false", "quillon.x": "7"}, executor_env={"QUILLON_PATH": "/opt/lib"}) as (spark, registry):
    registry.register("seen", lambda: os.environ.get("QUILLON_PATH"), "string")
    print(spark.sql("select seen()").first()[0], spark.conf.get("quillon.x"), spark.conf.get("spark.sql.session.timeZone"), spark.version)
from pyspark.sql import SparkSession
print(SparkSession.getActiveSession())
"""


def test_start_sets_environment_and_options():
    """In a process of its own, as variables go to the engine before it starts."""
    env = {**os.environ, "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", START], env=env, capture_output=True, text=True, check=True, timeout=120).stdout.split()
    import pyspark

    assert out == ["/opt/lib", "7", "UTC", pyspark.__version__, "None"]


def test_model_is_loaded_from_a_blob(spark, tmp_path):
    rng = np.random.default_rng(5)
    w = rng.integers(-8, 9, (6, 3)) / 4
    cells = spark.createDataFrame([(i, j, float(w[i][j])) for i in range(6) for j in range(3)], "i int, j int, w double")
    O.save_model(cells, str(tmp_path / "m"))
    blob = S.blob(spark, f"{tmp_path}/m/*.parquet")
    x = rng.integers(-8, 9, (40, 6)) / 2
    df = S.cases(spark, [(i, v.tolist(), None) for i, v in enumerate(x)]).repartition(3)
    got = {r.case_id: r.y for r in O.batch_inference(df, O.load_model(blob), "input", width=6, batch_size=7).collect()}
    assert all(got[i] == (x[i] @ w).tolist() for i in range(40))
    with pytest.raises(ValueError, match="up to 10 bytes"):
        O.load_model(blob, most=10)
    with pytest.raises(ValueError, match="one blob"):
        O.load_model(blob.union(blob))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        O.load_model(S.blob(spark, str(tmp_path / "none")))


def test_providers_and_options(spark, sf):
    w, v = core.dense_weights(), S.vectors(spark, sf)
    catalogue, runs = S.providers(spark), {}
    for name, options in (("spark", {}), ("arrow", {"batch_rows": "7"}), ("spark", {"quantize_io": "1"}), ("arrow", {"quantize_io": "1"}), ("arrow", {"quantize_io": "0"})):
        chosen = O.choose_provider(catalogue, name, options)
        assert chosen["ep_name"] == name and chosen["options"] == options and chosen["slots"] > 0
        df = O.run_on(chosen, v, w)
        assert df.columns == v.columns + ["y"] and bool(plans.python_nodes(df)) == (name == "arrow")
        runs.setdefault(options.get("quantize_io", "0"), []).append({r.vec_id: r.y for r in df.select("vec_id", "y").collect()})
    assert all(a == same[0] for same in runs.values() for a in same) and runs["0"][0] != runs["1"][0]
    with pytest.raises(LookupError, match="no provider named npu"):
        O.choose_provider(catalogue, "npu")
    with pytest.raises(LookupError, match="takes no option batch_rows, x"):
        O.choose_provider(catalogue, "spark", {"x": "1", "batch_rows": "2"})
    with pytest.raises(ValueError, match="quantize_io"):
        O.run_on(O.choose_provider(catalogue, "spark", {"quantize_io": "yes"}), v, w)


def test_error_log(spark, caplog):
    """What the log holds after a failure: a level, the message, the error with its trace."""
    wrong = S.cases(spark, [(0, [2.0], [1.0])])
    with caplog.at_level("INFO", "quillon"):
        O.guarded_report(lambda: O.tolerance_check(wrong, "input", "expected", strict=True), spark)
        teardown(("cache", lambda: 1 / 0))
        O.log_rows(wrong.select("case_id"))
    check, step, row = [r for r in caplog.records if r.name == "quillon"]
    assert (check.levelname, check.getMessage()) == ("ERROR", "check failed") and "Validation failed" in str(check.exc_info[1])
    assert (step.levelname, step.getMessage(), step.exc_info[0]) == ("ERROR", "teardown step cache", ZeroDivisionError)
    assert (row.levelname, row.getMessage()) == ("INFO", "{'case_id': 0}")
