"""Operators on vector tables: matmul, quantize round trip, error reduction, reports."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon import functions as Q

LOG = logging.getLogger("quillon")

#: Weights of up to so many cells travel inside the plan; larger ones, up to LOCAL_CELLS of 8 bytes, are broadcast once to Python workers.
INLINE_CELLS, LOCAL_CELLS = 65536, 1 << 22
#: Weight tables of up to so many cells (12 bytes each) are broadcast; the copies a larger one is dealt in.
BROADCAST_CELLS, SALTS = 1 << 20, 16


def provider_filter(df: DataFrame, column: str, name: str, required: bool = False) -> DataFrame:
    """Rows whose provider has this name. With required, no such row is an error."""
    out = df.where(F.col(column) == F.lit(name))
    if required and out.isEmpty():
        raise LookupError(f"no provider named {name}")
    return out


def choose_provider(catalogue: DataFrame, name: str, options: Mapping[str, str] | None = None) -> dict[str, object]:
    """The catalogue's row of this name with the options given to it, as a dict. An unknown provider, or an option that it does not take, is an error."""
    row = provider_filter(catalogue, "ep_name", name, required=True).first()
    given = dict(options or {})
    if unknown := sorted(set(given) - set(row["options"])):
        raise LookupError(f"provider {name} takes no option {', '.join(unknown)}")
    return row.asDict() | {"options": given}


def run_on(provider: Mapping[str, object], vectors: DataFrame, weights: Sequence[Sequence[float]], quantization: tuple[float, int, int, int] = (1 / 128, 3, -128, 127), value: str = "embedding", out: str = "y") -> DataFrame:
    """vector x weights by what choose_provider gave; both providers sum in index order, so they agree to the bit.

    `spark` multiplies in expressions where the weights fit a plan, `arrow` always in Python workers,
    `batch_rows` vectors at once. With quantize_io = 1 the input is quantized and brought back first,
    by (scale, zero_point, lo, hi); 0, the default, leaves it as it is.
    """
    options, rows = provider["options"], str(provider["options"].get("batch_rows", "0"))
    if options.get("quantize_io", "0") not in ("0", "1") or not rows.isdecimal():
        raise ValueError(f"quantize_io is 0 or 1, batch_rows a number: {options}")
    held = vectors.withColumn("_x", F.col(value))
    if options.get("quantize_io") == "1":
        held = held.withColumn("_x", F.transform("_x", lambda v: Q.dequantize(Q.quantize(v, *quantization), *quantization[:2])))
    if provider["ep_name"] == "arrow":
        return held.withColumn(out, _batched(vectors, weights, int(rows))(F.col("_x"))).drop("_x")
    return matmul(held, weights, "_x", out).drop("_x")


def matmul(vectors: DataFrame, weights: Sequence[Sequence[float]], value: str = "embedding", out: str = "y") -> DataFrame:
    """vector x weights as an array column, in place: no shuffle.

    A vector whose length is not the number of weight rows gives NULL, a NULL element NULL sums.
    Sums are in index order, whichever form the size of the weights calls for, so results are the
    same to the bit. Weights beyond LOCAL_CELLS are an error: as tables they can be multiplied by
    matmul_relational or by quillon.operators.blocks.
    """
    rows, cols = len(weights), len(weights[0])
    if rows * cols > LOCAL_CELLS:
        raise ValueError(f"{rows} x {cols} weights are too many to send along; give them as a table")
    if rows * cols > INLINE_CELLS:
        return vectors.withColumn(out, _batched(vectors, weights)(F.col(value)))
    turned = json.dumps([[float(weights[i][j]) for i in range(rows)] for j in range(cols)])
    by_col = F.from_json(F.lit(turned), "array<array<double>>")  # folded into one literal
    x = F.transform(F.col(value), lambda v: v.cast("double"))
    product = F.transform(by_col, lambda w: F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p))
    return vectors.withColumn(out, F.when(F.size(value) == rows, product))


def _batched(vectors: DataFrame, weights: Sequence[Sequence[float]], batch_rows: int = 0) -> Callable:
    """A function of a vector column that multiplies by broadcast weights, a batch of vectors at once: an Arrow batch, or batch_rows of it."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.asarray(weights, dtype=np.float64))

    def product(values: pd.Series) -> pd.Series:
        w = shared.value
        fits = np.array([v is not None and len(v) == len(w) for v in values], dtype=bool)
        result = np.full(len(values), None, dtype=object)
        if fits.any():
            x = np.array([[np.nan if e is None else e for e in v] for v in values[fits]], dtype=np.float64)
            missing = np.array([any(e is None for e in v) for v in values[fits]])
            y = np.zeros((len(x), w.shape[1]))
            for k in range(0, len(x), batch_rows or len(x)):
                part = slice(k, k + (batch_rows or len(x)))
                for i in range(len(w)):  # in index order, as the fold in place
                    y[part] += x[part, i, None] * w[i]
            for at, row, unknown in zip(np.flatnonzero(fits), y, missing, strict=True):
                result[at] = [None] * w.shape[1] if unknown else row
        return pd.Series(result)

    return F.pandas_udf(product, "array<double>")


def matmul_relational(vectors: DataFrame, weights: DataFrame, key: str = "vec_id", value: str = "embedding", broadcast_cells: int = BROADCAST_CELLS, salts: int = SALTS) -> DataFrame:
    """vector x weights(i, j, w), as rows (key, j, y). Cells that are not stored count as zero.

    A NULL element with a stored weight gives NULL. Weights of up to broadcast_cells, which is
    counted, are broadcast. Larger ones are joined on the inner index, of which there are few
    values, so each is dealt in `salts` copies and the vectors among those. Sums are combined
    before the shuffle on (key, j).
    """
    x = vectors.select(F.col(key).alias("_k"), F.posexplode(value).alias("_i", "_v"))
    w = weights.select(F.col("i").alias("_wi"), F.col("j"), F.col("w"))
    if w.limit(broadcast_cells + 1).count() <= broadcast_cells:
        joined = x.join(F.broadcast(w), F.col("_i") == F.col("_wi"))
    else:
        x = x.withColumn("_s", F.pmod(F.xxhash64("_k"), F.lit(salts)))
        w = w.withColumn("_ws", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = x.join(w, (F.col("_i") == F.col("_wi")) & (F.col("_s") == F.col("_ws")))
    y = F.when(~F.bool_or(F.col("_v").isNull()), F.sum(F.col("_v").cast("double") * F.col("w")))
    return joined.groupBy(F.col("_k").alias(key), "j").agg(y.alias("y"))


def identity_weights(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(1.0).alias("w"))


def qdq(df: DataFrame, scale: float, zero_point: int, lo: int, hi: int, value: str = "embedding") -> DataFrame:
    """Adds arrays q and dq: the value quantized, and brought back."""
    q = F.transform(F.col(value), lambda v: Q.quantize(v, scale, zero_point, lo, hi))
    return df.withColumn("q", q).withColumn("dq", F.transform("q", lambda v: Q.dequantize(v, scale, zero_point)))


def tolerance_check(df: DataFrame, output: str, expected: str, tolerance: float = Q.TOLERANCE, nan_policy: str = "fail", strict: bool = False) -> DataFrame:
    """Adds max_error and pass. In strict mode a row that fails raises in the query."""
    out = df.withColumn("max_error", Q.max_error(Q.errors(F.col(output), F.col(expected)), nan_policy))
    ok = Q.within(F.col("max_error"), tolerance)
    if strict:
        ok = F.when(ok, F.lit(True)).otherwise(F.raise_error(Q.concat("Validation failed. Max error = ", F.col("max_error"))).cast("boolean"))
    return out.withColumn("pass", ok)


def max_error_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.max("max_error").alias("max_error"))


def status_report(checked: DataFrame) -> DataFrame:
    """One row: n, n_pass, max_error, status. An empty input passes with error 0."""
    return checked.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("pass")).alias("n_pass"),
        F.coalesce(F.max("max_error"), F.lit(0.0)).alias("max_error"),
    ).withColumn("status", F.when(F.col("n") == F.col("n_pass"), "PASS").otherwise("FAILED"))


def observed(checked: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame, and its count of rows, passes and largest error, which come with the next action on it."""
    seen = Observation(name)
    metrics = F.count(F.lit(1)).alias("n"), F.count_if(F.col("pass")).alias("n_pass"), F.max("max_error").alias("max_error")
    return checked.observe(seen, *metrics), seen


def error_text(e: Exception) -> str:
    """The class and the message of an error."""
    return f"{type(e).__name__}: {e}"


def guarded_report(make: Callable[[], DataFrame], spark) -> DataFrame:
    """status_report of make(), or one FAILED row with the error's class and message."""
    schema = "n long, n_pass long, max_error double, status string, error string"
    try:
        r = status_report(make()).first()
        return spark.createDataFrame([(r["n"], r["n_pass"], r["max_error"], r["status"], None)], schema)
    except Exception as e:
        LOG.exception("check failed")
        return spark.createDataFrame([(0, 0, None, "FAILED", error_text(e))], schema)


def batch_inference(df: DataFrame, make_predict: Callable, value: str = "embedding", out: str = "y", width: int = 64, batch_size: int = 1024) -> DataFrame:
    """A model that only exists as Python code, applied in Arrow batches; it is loaded once a worker."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    udf = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=[[width]])
    return df.withColumn(out, udf(F.col(value)))


#: Bytes of a model that are sent to the workers; a larger one is an error.
MODEL_BYTES = 1 << 28


def save_model(weights: DataFrame, path: str) -> None:
    """weights(i, j, w) as a model: one Parquet file in the folder `path`. Their size is checked when they are loaded."""
    weights.select(F.col("i").cast("int"), F.col("j").cast("int"), F.col("w").cast("float")).coalesce(1).write.parquet(path)


def load_model(model: DataFrame, most: int = MODEL_BYTES) -> Callable:
    """What batch_inference asks for, of a model in one blob, as sources.blob gives it.

    The blob's length is looked at before its content; beyond `most` bytes, or with other than one
    blob, it is an error. Its bytes are broadcast, and each worker makes its weights of them once.
    """
    found = model.select("path", "length").limit(2).collect()
    if len(found) != 1 or found[0]["length"] > most:
        raise ValueError(f"a model is one blob of up to {most} bytes; found {[r['length'] for r in found]}")
    shared = model.sparkSession.sparkContext.broadcast(bytes(model.select("content").first()["content"]))

    def make() -> Callable:
        import io

        import pyarrow.parquet as pq

        cells = pq.read_table(io.BytesIO(shared.value)).to_pandas()
        w = np.zeros((cells["i"].max() + 1, cells["j"].max() + 1), dtype=np.float32)
        w[cells["i"], cells["j"]] = cells["w"]
        return lambda x: x @ w

    return make


def pick_output(df: DataFrame, position: int) -> DataFrame:
    """The column at a position; IndexError if there is none."""
    return df.select(F.col(f"`{df.columns[position]}`"))


def typed(df: DataFrame, schema: str) -> DataFrame:
    """The frame under an explicit schema; a column that cannot be read as its type raises."""
    return df.to(StructType.fromDDL(schema))


def compiled(df: DataFrame) -> float:
    """Milliseconds to analyse, optimize and plan, without running."""
    began = time.perf_counter_ns()
    df._jdf.queryExecution().executedPlan()
    return (time.perf_counter_ns() - began) / 1_000_000.0


def timed(df: DataFrame) -> float:
    """Milliseconds to run the whole plan into a sink that keeps nothing."""
    began = time.perf_counter_ns()
    df.write.format("noop").mode("overwrite").save()
    return (time.perf_counter_ns() - began) / 1_000_000.0


def log_rows(df: DataFrame, log: Callable[[dict], object] | None = None) -> int:
    """Hand every row to the log, a partition at a time on the driver; meant for reports."""
    log = log or (lambda row: LOG.info("%s", row))
    n = 0
    for n, row in enumerate(df.toLocalIterator(), 1):
        log(row.asDict())
    return n
