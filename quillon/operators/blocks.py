"""Products of two distributed matrices, in dense blocks. An extension of matmul to sides of any size.

A matrix is a table of blocks (bi, bj, height, width, data), data the float64 cells by rows. Blocks
meet by a join on the inner block index; a task adds up the products of one output block before
anything is shuffled, and partial sums are added in two steps, so what moves is blocks, not cells,
and no output block gathers all its terms in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a block; output blocks that a task holds before it hands them on; parts that the sums of one output block are added in first.
SIZE, HELD, PARTS = 256, 64, 16
SCHEMA = "bi long, bj long, height int, width int, data binary"


def from_vectors(rows: DataFrame, index: Column, vector: Column, width: int, size: int = SIZE) -> DataFrame:
    """The matrix whose row `index` (0 and up, each once; rows that are not there are zero) is the vector, of `width` numbers."""

    def block(own: pa.Table) -> pa.Table:
        cells = np.zeros((size, width))
        cells[own["r"].to_numpy()] = own["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        bi = own["bi"][0].as_py()
        at = range(0, width, size)
        parts = [cells[:, j : j + size] for j in at]
        return pa.table([pa.array(c, t) for c, t in zip(([bi] * len(parts), range(len(parts)), [size] * len(parts), [p.shape[1] for p in parts], [p.tobytes() for p in parts]), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bi", "bj", "height", "width", "data"])

    placed = rows.select(F.floor(index / size).cast("long").alias("bi"), (index % size).cast("int").alias("r"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    return placed.groupBy("bi").applyInArrow(block, SCHEMA)  # a group has at most `size` rows


def transposed(m: DataFrame) -> DataFrame:
    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [_cells(d.as_py(), h.as_py()).T.tobytes() for d, h in zip(b["data"], b["height"], strict=True)]
            yield pa.RecordBatch.from_arrays([b["bj"], b["bi"], b["width"], b["height"], pa.array(data, pa.binary())], names=["bi", "bj", "height", "width", "data"])

    return m.select("bi", "bj", "height", "width", "data").mapInArrow(turned, SCHEMA)


def _cells(data: bytes, height: int) -> np.ndarray:
    return np.frombuffer(data).reshape(height, -1)


def product(a: DataFrame, b: DataFrame, parts: int = PARTS, held: int = HELD) -> DataFrame:
    """a times b, whose blocks have to agree in size; blocks that are not there are zero."""
    names = ["bi", "bj", "part", "height", "width", "data"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        part = 0
        for batch in batches:
            for bi, bj, k, h, mid, x, y in zip(*(c for c in batch.columns), strict=True):
                at, part = (bi.as_py(), bj.as_py()), k.as_py() % parts
                x, y = _cells(x.as_py(), h.as_py()), _cells(y.as_py(), mid.as_py())
                inner = min(x.shape[1], len(y))  # a last block may be narrower than the one that it meets is high; the rest is zero
                made = x[:, :inner] @ y[:inner]
                sums[at] = sums[at] + made if at in sums else made
                if len(sums) > held:
                    yield handed(sums, part)
                    sums = {}
        if sums:
            yield handed(sums, part)

    def handed(sums: dict[tuple[int, int], np.ndarray], part: int) -> pa.RecordBatch:
        rows = [(i, j, part, *m.shape, m.tobytes()) for (i, j), m in sums.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sum of one group's blocks, one at a time."""
        total, head = None, None
        for batch in batches:
            for i, j, p, h, w, data in zip(*(batch[n] for n in names), strict=True):
                own = _cells(data.as_py(), h.as_py())
                total, head = own if total is None else total + own, (i.as_py(), j.as_py(), p.as_py(), h.as_py(), w.as_py())
        if head:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*head, total.tobytes()), types, strict=True)], names=names)

    left = a.select(F.col("bi"), F.col("bj").alias("k"), "height", F.col("data").alias("x"))
    right = b.select(F.col("bi").alias("k"), "bj", F.col("height").alias("mid"), F.col("data").alias("y"))
    met = left.join(right, "k").select("bi", "bj", "k", "height", "mid", "x", "y")
    schema = "bi long, bj long, part int, height int, width int, data binary"
    some = met.mapInArrow(multiplied, schema).groupBy("bi", "bj", "part").applyInArrow(_whole(added), schema)
    return some.groupBy("bi", "bj").applyInArrow(_whole(added), schema).drop("part")


def _whole(added):
    def run(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(added(iter(group.to_batches())))

    return run


def cells(m: DataFrame, size: int = SIZE) -> DataFrame:
    """i, j, value of every cell of the stored blocks."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bi, bj, h, data in zip(b["bi"], b["bj"], b["height"], b["data"], strict=True):
                own = _cells(data.as_py(), h.as_py())
                i, j = np.indices(own.shape)
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel() + bi.as_py() * size), pa.array(j.ravel() + bj.as_py() * size), pa.array(own.ravel())], names=["i", "j", "value"])

    return m.select("bi", "bj", "height", "data").mapInArrow(spread, "i long, j long, value double")
