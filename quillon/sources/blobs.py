"""A registered data source: vectors in a folder of blobs, each a block of ids and a block of float32 values. An extension."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

MAGIC, HEAD = b"QVB1", "<4sIQ"
FORMAT, PUSHDOWN = "quillon_vectors", "spark.sql.python.filterPushdown.enabled"


def local(path: str) -> str:
    """A folder that driver and executors have mounted; other stores are beyond this source."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"not a mounted folder: {path}")
    return path.removeprefix("file://").removeprefix("file:")


def write(vectors: DataFrame, folder: str, rows: int = 10_000) -> int:
    """Writes vectors(vec_id, embedding), all of one length, as blobs of up to `rows`, sorted by id; the number of blobs.

    Blobs are ranges of ids, named by them. A blob appears under its name when it is whole; a task
    that is run again writes further copies under other names, so only blobs that tasks report stay.
    """
    into = local(folder)
    os.makedirs(into, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                own = batch.slice(at, rows)
                ids = own.column(0).to_numpy()
                values = own.column(1).flatten().to_numpy().astype("<f4")
                name = f"{ids.min()}_{ids.max()}_{uuid.uuid4().hex}.vec"
                with open(f"{into}/.{name}", "wb") as f:
                    f.write(struct.pack(HEAD, MAGIC, len(values) // len(ids), len(ids)) + ids.astype("<i8").tobytes() + values.tobytes())
                os.rename(f"{into}/.{name}", f"{into}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    ranged = vectors.select("vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    names = ranged.mapInArrow(run, "name string").toLocalIterator()
    n = 0
    with open(f"{into}/.blobs", "w") as f:
        for n, r in enumerate(names, 1):
            f.write(f"{r['name']}\n")
    os.rename(f"{into}/.blobs", f"{into}/blobs")
    return n


class Blob(InputPartition):
    def __init__(self, path: str):
        super().__init__(None)
        self.path = path


def span(name: str) -> tuple[int, int]:
    low, high, _ = name.split("_")
    return int(low), int(high)


def may_hold(f: Filter, low: int, high: int) -> bool:
    """Whether a blob of ids low to high can have a row that the filter passes; yes, for filters of other kinds or columns."""
    if getattr(f, "attribute", None) != ("vec_id",):
        return True
    match f:
        case EqualTo():
            return low <= f.value <= high
        case In():
            return any(low <= v <= high for v in f.value if v is not None)
        case GreaterThan():
            return high > f.value
        case GreaterThanOrEqual():
            return high >= f.value
        case LessThan():
            return low < f.value
        case LessThanOrEqual():
            return low <= f.value
    return True


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.filters = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.filters = filters
        return filters  # blobs are skipped by them; rows are left to the engine

    def partitions(self) -> list[InputPartition]:
        with open(f"{self.folder}/blobs") as f:
            names = f.read().split()
        return [Blob(f"{self.folder}/{n}") for n in names if all(may_hold(f, *span(n)) for f in self.filters)]

    def read(self, partition: Blob) -> Iterator[pa.RecordBatch]:
        if partition is None or not getattr(partition, "path", None):
            return
        with open(partition.path, "rb") as f:
            magic, width, n = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))
            if magic != MAGIC:
                raise ValueError(f"not a blob of vectors: {partition.path}")
            ids, values = np.fromfile(f, "<i8", n), np.fromfile(f, "<f4", n * width)
        if len(values) != n * width:
            raise ValueError(f"a blob that is cut off: {partition.path}")
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values))
        yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["vec_id", "embedding"])


class Vectors(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "vec_id long, embedding array<float>"

    def reader(self, schema) -> Reader:
        return Reader(local(self.options["path"]))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of a folder; filters on vec_id decide which blobs are opened, for which PUSHDOWN is turned on in the session."""
    spark.dataSource.register(Vectors)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format(FORMAT).load(folder)
