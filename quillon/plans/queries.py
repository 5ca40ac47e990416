"""The registered queries on vector tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import functions as Q
from quillon import operators as O
from quillon import sources as S
from quillon.session import Registry, shared_folder

SCALE, ZERO_POINT, LO, HI = 1 / 128, 3, -128, 127
WIDTH = 64


def dense_weights(n: int = WIDTH) -> list[list[float]]:
    """Small multiples of 1/8: products and sums of float32 values stay exact in doubles."""
    return [[((i * 7 + j * 3) % 11 - 5) / 8.0 for j in range(n)] for i in range(n)]


def tensor_scan(spark: SparkSession, d: str) -> DataFrame:
    return S.vectors(spark, d).select("vec_id", F.size("embedding").alias("n"))


def row_pick(spark: SparkSession, d: str) -> DataFrame:
    return S.vectors(spark, d).select("vec_id", Q.pick(F.col("embedding"), 0).alias("first_value"))


def provider_filter(spark: SparkSession, d: str) -> DataFrame:
    """Event types stand in for provider names."""
    return O.provider_filter(S.table(spark, d, "events").select("event_id", "event_type"), "event_type", "click")


def matmul_identity(spark: SparkSession, d: str) -> DataFrame:
    return O.matmul_relational(S.vectors(spark, d), O.identity_weights(spark, WIDTH))


def matmul_dense(spark: SparkSession, d: str) -> DataFrame:
    y = O.matmul(S.vectors(spark, d), dense_weights())
    return y.select("vec_id", F.posexplode("y").alias("j", "y"))


def _qdq(spark: SparkSession, d: str) -> DataFrame:
    return O.qdq(S.vectors(spark, d), SCALE, ZERO_POINT, LO, HI)


def qdq_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    both = _qdq(spark, d).select("vec_id", F.posexplode(F.arrays_zip("q", "dq")).alias("i", "z"))
    return both.select("vec_id", "i", F.col("z.q").alias("q"), F.col("z.dq").alias("dq"))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return O.tolerance_check(_qdq(spark, d), "dq", "embedding")


def qdq_max_error(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("vec_id", "max_error")


def tolerance_check(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("vec_id", "max_error", "pass")


def max_abs_fold(spark: SparkSession, d: str) -> DataFrame:
    return S.vectors(spark, d).select("vec_id", Q.max_abs(F.col("embedding")).alias("m"))


def error_by_label(spark: SparkSession, d: str) -> DataFrame:
    """The grouping key is an extension."""
    return O.max_error_by(_checked(spark, d), "label")


def array_render(spark: SparkSession, d: str) -> DataFrame:
    """The fixed input as text, and that of each nation's keys."""
    keys = S.table(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("case_id"), Q.tensor(F.col("n_nationkey"), F.col("n_regionkey")).alias("input"))
    return S.self_check(spark).select("case_id", "input").unionByName(keys).select("case_id", Q.render(F.col("input")).alias("text"))


def status_report(spark: SparkSession, d: str) -> DataFrame:
    return O.status_report(_checked(spark, d))


def self_check(spark: SparkSession, d: str) -> DataFrame:
    """The fixed 1x4 vector times a 4x4 identity against its expectation, and so the first four values of each vector."""
    eye = [[float(i == j) for j in range(4)] for i in range(4)]
    four = F.slice("embedding", 1, 4)
    vectors = S.vectors(spark, d).select((F.col("vec_id") + 1).alias("case_id"), four.alias("input"), four.alias("expected"))
    y = O.matmul(S.self_check(spark).unionByName(vectors), eye, "input")
    return O.tolerance_check(y, "y", "expected").select("case_id", "y", "max_error", "pass")


def batch_inference(spark: SparkSession, d: str) -> DataFrame:
    """A model saved from the table's first vectors, quantized, and read as a blob, applied to all vectors, brought back from theirs; float32 sums of these are exact."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    first = _qdq(spark, d).where(F.col("vec_id") < WIDTH)
    O.save_model(first.select(F.posexplode("q").alias("i", "w"), F.col("vec_id").alias("j")), path)
    model = O.load_model(S.blob(spark, f"{path}/*.parquet"))
    y = O.batch_inference(_qdq(spark, d).withColumn("dq", F.col("dq").cast("array<float>")), model, "dq", width=WIDTH)
    return y.select("vec_id", F.posexplode("y").alias("i", "y"))


def provider_run(spark: SparkSession, d: str) -> DataFrame:
    """The dense product by the provider that is asked for, with its options."""
    provider = O.choose_provider(S.providers(spark), "arrow", {"quantize_io": "1", "batch_rows": "512"})
    y = O.run_on(provider, S.vectors(spark, d), dense_weights(), (SCALE, ZERO_POINT, LO, HI))
    return y.select("vec_id", F.posexplode("y").alias("j", "y"))


def elementwise_error(spark: SparkSession, d: str) -> DataFrame:
    e = _qdq(spark, d).withColumn("e", Q.errors(F.col("dq"), F.col("embedding")))
    return e.select("vec_id", F.posexplode("e").alias("i", "error"))


# Outputs and expectations fed to the error step: bounds, NaN, infinity, lengths, unknown elements.
EDGES = [
    ([1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0]), ([1.5, 2.0], [1.0, 2.0]), ([0.0625, 2.0], [0.0, 2.0]), ([float("nan"), 2.0], [1.0, 2.0]),
    ([float("inf"), 2.0], [1.0, 2.0]), ([1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0]), ([1.0, 2.0, 9.0], [1.0, 2.0]), ([], []),
    ([None, 2.0], [1.0, 2.0]), ([9.0, 2.0], [None, 2.0]), ([None], [None]), ([1.0, 2.0, None], [1.0, 2.0]), (None, [1.0]), ([1.0], None),
]


def edge_cases(spark: SparkSession, d: str) -> DataFrame:
    """The fixed cases, and each vector bent by one of seven ways or none. Both NaN policies; an output that is too short or has an unknown element fails, one that is too long passes."""
    x, kind = F.col("embedding"), F.col("vec_id") % 8
    with_first = lambda v: F.concat(F.array(v.cast("float")), F.slice(x, 2, 64))
    bent = (F.slice(x, 1, 63), F.concat(x, F.slice(x, 1, 1)), with_first(F.lit(float("nan"))), with_first(F.lit(float("-inf"))), with_first(F.lit(None)), with_first(x[0] + 1), F.lit(None).cast("array<float>"))
    output = F.when(kind == 7, x)
    for k, v in enumerate(bent):
        output = output.when(kind == k, v)
    vectors = S.vectors(spark, d).select((F.col("vec_id") + len(EDGES)).alias("case_id"), output.alias("input"), x.alias("expected"))
    df = S.cases(spark, [(i, a, b) for i, (a, b) in enumerate(EDGES)]).unionByName(vectors)
    errs = Q.errors(F.col("input"), F.col("expected"))
    passes = lambda policy: Q.within(Q.max_error(errs, policy))
    return df.select("case_id", passes("fail").alias("pass_strict"), passes("ignore").alias("pass_ignoring_nan"), Q.max_error(errs).isNull().alias("unknown"), Q.max_abs(F.col("input")).isNull().alias("abs_unknown"))


def failures(spark: SparkSession, d: str) -> DataFrame:
    """Errors that become rows, over the vectors and events: a check that fails, no such provider, no such model, a wrong type, and none."""
    vectors = S.vectors(spark, d).select("vec_id", F.col("embedding").alias("expected"), F.col("embedding").alias("input"))
    wrong = vectors.withColumn("input", F.transform("expected", lambda v: v * 0 + 1)).withColumn("expected", F.transform("expected", lambda v: v * 0))
    checked = lambda df: O.tolerance_check(df, "input", "expected", strict=True)
    makes = {
        "fine": lambda: checked(vectors),
        "strict": lambda: checked(wrong),
        "provider": lambda: O.provider_filter(S.table(spark, d, "events"), "event_type", "npu", required=True),
        "model": lambda: S.blob(spark, f"{d}/no_such_model.onnx"),
        "type": lambda: checked(O.typed(vectors.withColumn("input", F.col("vec_id").cast("string")), "vec_id long, expected array<float>, input array<float>")),
    }
    kind = F.regexp_extract("error", r"^(\w+)", 1)
    told = F.regexp_extract("error", r"Validation failed\. Max error = [0-9.]+|no provider named \w+|PATH_NOT_FOUND|INVALID_COLUMN_OR_FIELD_DATA_TYPE", 0)
    rows = [O.guarded_report(make, spark).select(F.lit(k).alias("case"), "status", "n", F.coalesce(F.when(kind.like("%Exception"), "engine").otherwise(kind), F.lit("")).alias("raised"), F.coalesce(told, F.lit("")).alias("told")) for k, make in makes.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def environment(spark: SparkSession, d: str) -> DataFrame:
    """For each region that asks for a provider of the catalogue: its row, the engine's version and a setting, by name."""
    asked = S.table(spark, d, "region").select("r_regionkey", F.when(F.col("r_regionkey") % 2 == 0, "spark").otherwise("npu").alias("ep_name"))
    row = asked.join(F.broadcast(O.provider_filter(S.providers(spark), "ep_name", "spark", required=True)), "ep_name")
    version = F.lit(S.runtime(spark).first()["engine_version"])
    return row.select("r_regionkey", "ep_name", (F.col("slots") > 0).alias("has_slots"), F.rlike(version, F.lit(r"^\d+\.\d+")).alias("has_version"), F.lit(S.setting(spark, "quillon.no.such", "none")).alias("setting"))


def blob_scan(spark: SparkSession, d: str) -> DataFrame:
    """A file as one blob: whole, with its leading bytes."""
    b = S.blob(spark, f"{d}/region.parquet")
    return b.select((F.length("content") == F.col("length")).alias("whole"), F.decode(F.substring("content", 1, 4), "UTF-8").alias("magic"))


def registered_function(spark: SparkSession, d: str) -> DataFrame:
    """A function registered for a query and gone after it is planned."""
    own = Registry(spark)
    own.define("quillon_scaled", "x DOUBLE, by DOUBLE", "DOUBLE", "x * by + 1")
    out = S.table(spark, d, "nation").select("n_nationkey", F.expr("quillon_scaled(n_nationkey, 0.5D)").alias("y"))
    own.unregister()
    return out


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Values put into a message, and a template without its common indent."""
    block = Q.concat("\n    Region ", F.col("r_regionkey"), "\n      ", F.col("r_name"), "\n\n    end\n  ")
    return S.table(spark, d, "region").select("r_regionkey", Q.concat("Max error = ", F.col("r_regionkey") / 4, "; ", F.lit(None)).alias("message"), Q.dedent(block).alias("report"))


def lenient_pick(spark: SparkSession, d: str) -> DataFrame:
    """An element that is not there: NULL instead of an error."""
    return S.vectors(spark, d).select("vec_id", Q.pick(F.col("embedding"), 64, strict=False).alias("beyond"), Q.pick(F.col("embedding"), 63, strict=False).alias("last_value"))


def durations(spark: SparkSession, d: str) -> DataFrame:
    """Nanoseconds to milliseconds; event ids stand in for clock differences."""
    return S.table(spark, d, "events").select("event_id", Q.nanos_to_millis(F.col("event_id") * 1000).alias("ms"))


def rendered(spark: SparkSession, d: str) -> DataFrame:
    """Paths, fixed-point text of values that halve evenly, a map's entry, the first rule that holds."""
    k = F.col("n_nationkey")
    return S.table(spark, d, "nation").select(
        "n_nationkey",
        Q.join_path(F.lit("lib"), F.col("n_name")).alias("path"),
        Q.fixed3(k / 8).alias("text"),
        Q.option_map({"backend_type": "spark"})["backend_type"].alias("backend"),
        Q.first_match((k > 20, F.lit("dynamic")), (k > 10, F.lit("dark")), default=F.lit("light")).alias("choice"),
    )


def signature(spark: SparkSession, d: str) -> DataFrame:
    return S.signature(S.vectors(spark, d))


def output_pick(spark: SparkSession, d: str) -> DataFrame:
    """The first output by position, packed into a tensor and typed."""
    y = S.vectors(spark, d).select(Q.tensor(F.col("vec_id"), F.col("label")).alias("t"))
    return O.pick_output(y, 0).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Scan, identity matmul, error against the input, reduction, predicate."""
    eye = [[float(i == j) for j in range(WIDTH)] for i in range(WIDTH)]
    y = O.matmul(S.vectors(spark, d), eye)
    return O.tolerance_check(y, "y", "embedding").select("vec_id", "max_error", "pass")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (tensor_scan, row_pick, provider_filter, matmul_identity, matmul_dense, qdq_roundtrip, qdq_max_error, tolerance_check, max_abs_fold, error_by_label, array_render, status_report, self_check, batch_inference, provider_run, elementwise_error, edge_cases, lenient_pick, durations, rendered, signature, output_pick, failures, environment, blob_scan, registered_function, texts, flagship)
}

_ELEMENTS = "SELECT vec_id, label, CAST(unnest(range(64)) AS INTEGER) AS i, unnest(embedding) AS v FROM embeddings"
_Q = f"""SELECT vec_id, label, i, v, CAST(least(greatest(round_even(CAST(v AS DOUBLE) * 128, 0)::DOUBLE + {ZERO_POINT}, {LO}), {HI}) AS INTEGER) AS q FROM ({_ELEMENTS})"""
_DQ = f"SELECT vec_id, label, i, v, q, CAST(q - {ZERO_POINT} AS DOUBLE) / 128 AS dq FROM ({_Q})"
_ERR = f"SELECT vec_id, label, max(abs(dq - CAST(v AS DOUBLE))) AS max_error FROM ({_DQ}) GROUP BY vec_id, label"



def _array(values: list | None) -> str:
    if values is None:
        return "NULL::FLOAT[]"
    return "[" + ", ".join("NULL" if v is None else f"'{v}'::FLOAT" for v in values) + "]::FLOAT[]"


ORACLES: dict[str, str] = {
    "tensor_scan": "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n FROM embeddings",
    "row_pick": "SELECT vec_id, embedding[1] AS first_value FROM embeddings",
    "provider_filter": "SELECT event_id, event_type FROM events WHERE event_type = 'click'",
    "matmul_identity": f"SELECT vec_id, i AS j, CAST(v AS DOUBLE) AS y FROM ({_ELEMENTS})",
    "matmul_dense": f"SELECT vec_id, CAST(j AS INTEGER) AS j, sum(CAST(v AS DOUBLE) * (((i * 7 + j * 3) % 11 - 5) / 8.0::DOUBLE)) AS y FROM ({_ELEMENTS}) CROSS JOIN range(64) AS c(j) GROUP BY vec_id, j",
    "qdq_roundtrip": f"SELECT vec_id, i, q, dq FROM ({_DQ})",
    "qdq_max_error": f"SELECT vec_id, max_error FROM ({_ERR})",
    "tolerance_check": f"SELECT vec_id, max_error, NOT (max_error > {Q.TOLERANCE}) AS pass FROM ({_ERR})",
    "max_abs_fold": "SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(x))) AS m FROM embeddings",
    "error_by_label": f"SELECT label, max(max_error) AS max_error FROM ({_ERR}) GROUP BY label",
    "array_render": """
        SELECT CAST(0 AS BIGINT) AS case_id, CAST([1.0::FLOAT, 2.0::FLOAT, 3.0::FLOAT, 4.0::FLOAT] AS VARCHAR) AS text
        UNION ALL SELECT CAST(n_nationkey + 1 AS BIGINT), CAST([n_nationkey::FLOAT, n_regionkey::FLOAT] AS VARCHAR) FROM nation""",
    "status_report": f"SELECT count(*) AS n, count(*) FILTER (WHERE NOT (max_error > {Q.TOLERANCE})) AS n_pass, coalesce(max(max_error), 0) AS max_error, CASE WHEN count(*) = count(*) FILTER (WHERE NOT (max_error > {Q.TOLERANCE})) THEN 'PASS' ELSE 'FAILED' END AS status FROM ({_ERR})",
    "self_check": """
        SELECT CAST(0 AS BIGINT) AS case_id, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE, 4.0::DOUBLE] AS y, 0.0::DOUBLE AS max_error, true AS pass
        UNION ALL SELECT vec_id + 1, CAST(embedding[1:4] AS DOUBLE[]), 0.0::DOUBLE, true FROM embeddings""",
    "batch_inference": f"SELECT a.vec_id, CAST(m.vec_id AS INTEGER) AS i, CAST(sum(a.dq * m.q) AS FLOAT) AS y FROM ({_DQ}) a JOIN ({_Q}) m USING (i) WHERE m.vec_id < {WIDTH} GROUP BY ALL",
    "provider_run": f"SELECT vec_id, CAST(j AS INTEGER) AS j, sum(dq * (((i * 7 + j * 3) % 11 - 5) / 8.0::DOUBLE)) AS y FROM ({_DQ}) CROSS JOIN range(64) AS c(j) GROUP BY vec_id, j",
    "elementwise_error": f"SELECT vec_id, i, abs(dq - CAST(v AS DOUBLE)) AS error FROM ({_DQ})",
    "edge_cases": f"""
        SELECT case_id, coalesce(len(output) >= len(expected) AND len(list_filter(errs, lambda e: e IS NULL OR isnan(e) OR e > {Q.TOLERANCE})) = 0, false) AS pass_strict,
               coalesce(len(output) >= len(expected) AND len(list_filter(errs, lambda e: e IS NULL OR (NOT isnan(e) AND e > {Q.TOLERANCE}))) = 0, false) AS pass_ignoring_nan,
               coalesce(len(output) < len(expected) OR len(list_filter(errs, lambda e: e IS NULL)) > 0, true) AS unknown,
               coalesce(len(list_filter(output, lambda v: v IS NULL)) > 0, true) AS abs_unknown
        FROM (SELECT *, list_transform(range(1, len(expected) + 1), lambda i: abs(output[i]::DOUBLE - expected[i]::DOUBLE)) AS errs
              FROM (SELECT * FROM (VALUES {", ".join(f"({i}::BIGINT, {_array(a)}, {_array(b)})" for i, (a, b) in enumerate(EDGES))}) AS t(case_id, output, expected)
                    UNION ALL SELECT vec_id + {len(EDGES)}, CASE vec_id % 8 WHEN 0 THEN embedding[1:63] WHEN 1 THEN list_append(embedding, embedding[1]) WHEN 2 THEN list_prepend('nan'::FLOAT, embedding[2:])
                        WHEN 3 THEN list_prepend('-inf'::FLOAT, embedding[2:]) WHEN 4 THEN list_prepend(NULL::FLOAT, embedding[2:]) WHEN 5 THEN list_prepend(embedding[1] + 1::FLOAT, embedding[2:]) WHEN 7 THEN embedding END, embedding FROM embeddings))""",
    "failures": """SELECT * FROM (VALUES ('fine', 'PASS', (SELECT count(*) FROM embeddings), '', ''), ('strict', 'FAILED', 0, 'engine', 'Validation failed. Max error = 1.0'),
        ('provider', 'FAILED', 0, 'LookupError', 'no provider named npu'), ('model', 'FAILED', 0, 'engine', 'PATH_NOT_FOUND'),
        ('type', 'FAILED', 0, 'engine', 'INVALID_COLUMN_OR_FIELD_DATA_TYPE')) AS t("case", status, n, raised, told)""",
    "environment": "SELECT r_regionkey, 'spark' AS ep_name, true AS has_slots, true AS has_version, 'none' AS setting FROM region WHERE r_regionkey % 2 = 0",
    "blob_scan": "SELECT true AS whole, 'PAR1' AS magic",
    "registered_function": "SELECT n_nationkey, n_nationkey * 0.5::DOUBLE + 1 AS y FROM nation",
    "texts": "SELECT r_regionkey, 'Max error = ' || CAST(r_regionkey / 4.0::DOUBLE AS VARCHAR) || '; null' AS message, 'Region ' || r_regionkey || chr(10) || '  ' || r_name || chr(10) || chr(10) || 'end' AS report FROM region",
    "lenient_pick": "SELECT vec_id, embedding[65] AS beyond, embedding[64] AS last_value FROM embeddings",
    "durations": "SELECT event_id, (event_id * 1000) / 1000000.0::DOUBLE AS ms FROM events",
    "rendered": "SELECT n_nationkey, 'lib/' || n_name AS path, printf('%.3f', n_nationkey / 8.0::DOUBLE) AS text, 'spark' AS backend, CASE WHEN n_nationkey > 20 THEN 'dynamic' WHEN n_nationkey > 10 THEN 'dark' ELSE 'light' END AS choice FROM nation",
    "signature": """
        SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS name,
               replace(replace(replace(lower(column_type), 'float[]', 'array<float>'), 'integer', 'int'), 'varchar', 'string') AS type FROM (DESCRIBE embeddings)""",
    "output_pick": "SELECT CAST(vec_id AS FLOAT) AS a, CAST(label AS FLOAT) AS b FROM embeddings",
    "flagship": "SELECT vec_id, 0.0::DOUBLE AS max_error, true AS pass FROM embeddings",
}
