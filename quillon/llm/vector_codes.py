"""Vectors compressed to one byte for each of four parts, with codebooks learnt in whole numbers.

Components become floor(1024 x). Vectors are cut into PARTS consecutive parts; each position
has a codebook of up to ENTRIES entries, at first those of the smallest ids. A round assigns
every part to its nearest entry and moves each entry to the floor of its parts' mean.

The nearest entry is found by lower bounds from coarse to fine: of a block, the means of two
vectors and the norms of what remains of them bound their squared distance from below, by
(block length) * (difference of means)^2 + (difference of residual norms)^2. One block a part
is compared with all entries, then halves and quarters with the entries still left; at each
level the entry of the least bound gets its exact distance, which the others' bounds must not
pass. Those that survive the finest level get exact distances in whole numbers. Bounds are
floating point, taken with a margin far above its error, so no entry is lost by rounding.

A round reads the vectors once and shuffles, for each task and used entry, a count and sums;
a codebook (4 x 256 entries, whatever the input) is all that reaches the driver and the tasks.
Vectors are never moved. Codes are saved before their errors are summed by label; labels of
many rows are broadcast, so that their rows stay where they are.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are
dropped. Vectors fit if their length is that of the smallest id's, a positive multiple of
four, and their components lie within `limit`, where squared errors fit 64 bits; those that
do not fit stay, with a null code and error, and take no part in codebooks. Equal distances
go to the lower index. Rows that share an id are rows of their own, in the order of their
vectors; null ids come last. With fewer than 256 rows there are as many entries. A table
without a vector gives no rows. Labels that are null are one label. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import matched, saved

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Blocks of a part at each level of bounds; vectors compared at once; share and amount a bound may pass the best distance by.
LEVELS, CHUNK, MARGIN = (1, 2, 4), 512, (1e-9, 1e-3)


def limit(length: int) -> int:
    """The largest component, as a whole number, for which sums of squared differences and their bounds fit 64 bits."""
    return min((1 << 31) * PARTS // length, math.isqrt((1 << 61) // length))


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)


@dataclass
class Level:
    """Of each vector, the sums of its blocks and the norms of what differs from their means."""

    lengths: np.ndarray
    sums: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, blocks: int) -> Level:
        cuts = np.arange(blocks) * x.shape[1] // blocks
        lengths = np.diff(np.append(cuts, x.shape[1]))
        sums, squares = np.add.reduceat(x, cuts, axis=1), np.add.reduceat(x * x, cuts, axis=1)
        return cls(lengths, sums / lengths, np.sqrt((lengths * squares - sums * sums) / lengths))


def levels(x: np.ndarray) -> list[Level]:
    return [Level.of(x, b) for b in LEVELS if b == 1 or b <= x.shape[1]]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


class Codebook:
    """The entries of one part, with their levels."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.levels = entries, levels(entries)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry of each row, and how many exact distances were taken."""
        found = [self._nearest(x[i : i + CHUNK]) for i in range(0, len(x), CHUNK)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), sum(f[2] for f in found)

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        own, best, taken, row, entry = levels(x), None, 0, None, None
        for mine, theirs in zip(own, self.levels, strict=True):
            if row is None:  # against all entries
                bound = (np.square(mine.sums - theirs.sums.T) * mine.lengths + np.square(mine.norms - theirs.norms.T)).ravel()
                row, entry = np.divmod(np.arange(bound.size), len(self.entries))
            else:
                bound = np.square(mine.sums[row] - theirs.sums[entry]) @ mine.lengths + np.square(mine.norms[row] - theirs.norms[entry]).sum(axis=1)
            starts = np.flatnonzero(np.diff(row, prepend=-1))  # each row keeps an entry, so there is one start a row
            first = np.flatnonzero(bound == np.minimum.reduceat(bound, starts)[row])
            first = first[np.flatnonzero(np.diff(row[first], prepend=-1))]
            least = distances(x, self.entries[entry[first]])
            taken += len(x)
            best = least if best is None else np.minimum(best, least)
            keep = bound <= (best * (1 + MARGIN[0]) + MARGIN[1])[row]
            row, entry = row[keep], entry[keep]
        exact = distances(x[row], self.entries[entry])
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(exact, starts)
        hit = np.flatnonzero(exact == least[row])
        hit = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]  # entries ascend in a row, so the first is the lowest
        return entry[hit], least, taken + len(exact)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length))


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vector x of the rows whose vector is whole and finite, and whether it may fit."""
    x = F.col("embedding")
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select("vec_id", "label", x.alias("x")).where(x.isNotNull() & ~broken)
    n = F.size("x")
    most = F.least(F.floor(F.lit(float(PARTS << 31)) / n), F.floor(F.sqrt(F.lit(float(1 << 61)) / n)))
    return rows.withColumn("fits", (n > 0) & (n % PARTS == 0) & (F.aggregate("x", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v.cast("double")))) * SCALE < most))


def _fitting(length: int) -> Column:
    return F.col("fits") & (F.size("x") == length)


def first_codebooks(rows: DataFrame) -> list[np.ndarray]:
    """The parts of the vectors of the smallest ids; empty if no vector fits."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    one = rows.where("fits").orderBy(*order).select(F.size("x")).first()
    if one is None:
        return []
    smallest = rows.where(_fitting(one[0])).orderBy(*order).limit(ENTRIES).select("x").collect()
    return _parts(whole(np.array([r[0] for r in smallest])))


def moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after a round: each entry at the floor of the mean of the parts it is nearest to."""
    width = books[0].shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(books)
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in shared.value]
        n, sums = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width), np.int64)
        for batch in batches:
            for p, part in enumerate(_parts(_matrix(batch.column(0), width * PARTS))):
                entry, _, _ = own[p].nearest(part)
                n[p] += np.bincount(entry, minlength=ENTRIES)
                np.add.at(sums[p], entry, part)
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (p, e, n[p, e], *sums[p, e].T)], names=["part", "entry", "n", *names])

    schema = ", ".join(f"{c} long" for c in ["part", "entry", "n", *names])
    partial = rows.where(_fitting(width * PARTS)).select("x").mapInArrow(run, schema)
    out = [b.copy() for b in books]
    for r in partial.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).collect():
        out[r["part"]][r["entry"]] = [r[c] // r["n"] for c in names]
    return out


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def coded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of kept rows; code and error are null where the vector does not fit."""
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    if not books:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    length = books[0].shape[1] * PARTS
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in shared.value]
        for batch in batches:
            found = [own[p].nearest(part) for p, part in enumerate(_parts(_matrix(batch.column(2), length)))]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes().hex()
            texts = [codes[i : i + 2 * PARTS] for i in range(0, len(codes), 2 * PARTS)]
            error = np.sum([f[1] for f in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    fits = _fitting(length)
    fine = rows.where(fits).select("vec_id", "label", "x").mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error long")
    others = rows.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return fine.unionByName(others)


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes (vec_id, label, code, error) of vectors(vec_id, embedding, label), saved, and the codebooks."""
    rows = kept(vectors)
    books = first_codebooks(rows)
    for _ in range(rounds if books else 0):
        after = moved(rows, books)
        if all(np.array_equal(a, b) for a, b in itertools.zip_longest(after, books)):
            break  # further rounds change nothing
        books = after
    return saved(coded(rows, books)), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over rows of the same label, to saved codes(vec_id, label, code, error)."""
    keyed = codes.withColumn("none", F.col("label").isNull()).withColumn("same", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = saved(keyed.groupBy("none", "same").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")))
    return matched(keyed, sums, ["none", "same"], codes.count()).drop("none", "same")


def decoded(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Adds to codes the vector that each code stands for, in whole numbers; null where there is no code."""
    tables = F.array(*[F.from_json(F.lit(str(b.tolist())), "array<array<long>>") for b in books])
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("decoded", F.flatten(F.array(*[F.get(F.get(tables, F.lit(p)), entry(p)) for p in range(PARTS)])) if books else F.lit(None).cast("array<long>"))
