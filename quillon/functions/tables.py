"""Table functions: rows of a table in, other rows out. An extension."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.types import DoubleType, LongType, StructType

CHANGE_POINTS = "quillon_change_points"


class ChangePoints:
    """Rows at which a value differs by more than `least` from the one before it, in order of time, for each key.

    Called with a table and the names of key, time and value; the output has the key and the time in
    their own types, the value, the change, and the row's number in its key. Null values are passed
    over. Rows stream through: only the last value is held.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, time: AnalyzeArgument, value: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument has to be a table")
        names = key.value, time.value, value.value
        missing = [n for n in names if n not in rows.dataType.names]
        if missing:
            raise ValueError(f"no such column: {', '.join(map(str, missing))}")
        out = StructType().add(names[0], rows.dataType[names[0]].dataType).add(names[1], rows.dataType[names[1]].dataType)
        out = out.add("value", DoubleType()).add("change", DoubleType()).add("position", LongType())
        return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn(names[0])], orderBy=[OrderingColumn(names[1])])

    def __init__(self):
        self.last, self.n = None, 0

    def eval(self, row, key: str, time: str, value: str, least: float) -> Iterator[tuple]:
        self.n += 1
        now = row[value]
        if now is None:
            return
        if self.last is not None and abs(now - self.last) > least:
            yield row[key], row[time], float(now), float(now - self.last), self.n
        self.last = now


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register(CHANGE_POINTS, udtf(ChangePoints))
