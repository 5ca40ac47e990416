"""The tolerance check over a stream of vectors; it keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon import functions as Q
from quillon.operators import tolerance_check
from quillon.sources import VECTOR_CASE


def vector_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(VECTOR_CASE).option("maxFilesPerTrigger", max_files).parquet(path)


def checked_stream(stream: DataFrame, tolerance: float = Q.TOLERANCE) -> DataFrame:
    return tolerance_check(stream, "input", "expected", tolerance)
