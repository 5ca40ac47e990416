"""Tables, literal vectors, model blobs and metadata as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR_CASE = T.StructType([
    T.StructField("case_id", T.LongType()),
    T.StructField("input", T.ArrayType(T.FloatType())),
    T.StructField("expected", T.ArrayType(T.FloatType())),
])

# The self-check's input and expectation.
SELF_CHECK_INPUT = [1.0, 2.0, 3.0, 4.0]
SELF_CHECK_EXPECTED = [1.0, 2.0, 3.0, 4.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def blob(spark: SparkSession, path: str) -> DataFrame:
    """A model as bytes. A missing path raises when it is loaded."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def cases(spark: SparkSession, rows: Iterable[tuple[int, Sequence[float] | None, Sequence[float] | None]]) -> DataFrame:
    return spark.createDataFrame(list(rows), VECTOR_CASE)


def self_check(spark: SparkSession) -> DataFrame:
    return cases(spark, [(0, SELF_CHECK_INPUT, SELF_CHECK_EXPECTED)])


def providers(spark: SparkSession) -> DataFrame:
    """The catalogue of what can execute a plan here, and the options that each takes: expressions in the engine, or Python workers fed by Arrow."""
    sc = spark.sparkContext
    rows = [("spark", sc.master, sc.defaultParallelism, ["quantize_io"]), ("arrow", sc.master, sc.defaultParallelism, ["quantize_io", "batch_rows"])]
    return spark.createDataFrame(rows, "ep_name string, device string, slots int, options array<string>")


def runtime(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(spark.version).alias("engine_version"), F.version().alias("build"))


def setting(spark: SparkSession, key: str, default: str | None = None) -> str | None:
    return spark.conf.get(key, default)


def signature(df: DataFrame) -> DataFrame:
    """Column names and types by position."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")
