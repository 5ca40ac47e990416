"""Texts rearranged so that a model learns to fill in the middle.

A text is decoded into an array of UTF-32 code points. Each gets a class; units end where two
neighbouring classes say so (ENDS), found for the whole array at once. Two ranks drawn from a
hash of the document's id cut prefix, middle and suffix, which are slices of the array. The
output is prefix, suffix, middle, or suffix, prefix, middle, each after its mark; or the plain
text, where it is empty, holds a mark, or the id's draw says so.

Marks in the output are those put there, so `restored` gives back every text exactly.

Rows are independent: nothing is shuffled, a task holds one batch and gives it back in parts
of about BATCH characters. Draws depend on the id alone, so a lost task's rows come out alike.

Defined results: null text is empty; an empty text is plain with no units; very long texts are
taken whole; rows that share an id share its draws, a null id draws as an empty one; repeated
rows give repeated rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import text_of

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Characters of output after which a part of a batch is handed on.
BATCH = 4 << 20

NEWLINE, BLANKS = 10, np.array([9, 10, 11, 12, 13, 32], dtype="<u4")
#: For each kind of unit, whether one ends between a left class (row) and a right class (column).
ENDS = {
    "line": np.array([[False, False], [True, True]]),  # class 1: newline; a line ends after one
    "word": np.array([[False, False], [True, False]]),  # class 1: blank; a word takes the blanks after it
    "character": np.array([[True, True], [True, True]]),
}


def classes(codes: np.ndarray, unit: str) -> np.ndarray:
    return (codes == NEWLINE if unit == "line" else np.isin(codes, BLANKS)).astype(np.int8)


def bounds(codes: np.ndarray, unit: str = "line") -> np.ndarray:
    """0 and the end of each unit; the last unit ends with the text."""
    if not len(codes):
        return np.zeros(1, dtype=np.int64)
    own = classes(codes, unit)
    inner = np.flatnonzero(ENDS[unit][own[:-1], own[1:]]) + 1
    return np.concatenate([[0], inner, [len(codes)]])


def encoded(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le")


def rearranged(text: str, draws: tuple[int, int, int, int], unit: str = "line", rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle (None if plain), and the output."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    at = bounds(codes, unit)
    n = len(at) - 1
    if not text or any(m in text for m in marks) or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, last = sorted(at[d % (n + 1)] for d in draws[:2])
    p, s, m = marks
    prefix, middle, suffix = p + encoded(codes[:first]), m + encoded(codes[first:last]), s + encoded(codes[last:])
    form = "spm" if draws[3] % 100 < spm else "psm"
    return n, form, int(first), int(last - first), suffix + prefix + middle if form == "spm" else prefix + suffix + middle


def draws_of(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, unit: str = "line", rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output, for each row of docs(doc_id, text).

    rate: of 100 documents, how many are rearranged; spm: of 100 of those, how many start with the suffix.
    Each mark must start with a character that stands in none of them again, so that marks can be told.
    """
    if unit not in ENDS:
        raise ValueError(f"unit: {unit}")
    if len(set(marks)) != 3 or any(not m or "".join(marks).count(m[0]) != sum(x[0] == m[0] for x in marks) for m in marks):
        raise ValueError(f"marks: {marks}")
    names, types = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"], [None, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, text, *draws in zip(*batch.columns, strict=True):
                own = rearranged(text.as_py(), tuple(d.as_py() for d in draws), unit, rate, spm, marks)
                rows.append((doc_id.as_py(), *own))
                size += len(own[-1])
                if size >= BATCH:
                    yield packed(rows, batch.schema.field(0).type)
                    rows, size = [], 0
            if rows:
                yield packed(rows, batch.schema.field(0).type)

    def packed(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    drawn = docs.select("doc_id", text_of().alias("text"), *[d.alias(f"h{k}") for k, d in enumerate(draws_of(F.col("doc_id"), seed))])
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return drawn.mapInArrow(run, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. Marks stand in this order: psm P S M, spm S P M."""
    p, s, m = marks
    between = lambda a, b: F.substring_index(F.substring(output, F.length(F.lit(a)) + 1, F.length(output)), b, 1)
    after = lambda mark: F.substring(output, F.instr(output, mark) + len(mark), F.length(output))
    psm = F.concat(between(p, s), after(m), F.substring_index(after(s), m, 1))
    spm = F.concat(F.substring_index(after(p), m, 1), after(m), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
