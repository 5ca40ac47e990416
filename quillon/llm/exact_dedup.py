"""Exact dedup: groups by a 128-bit content hash, bytes compared inside groups.

Only hashes and ids are shuffled for all rows. Texts move only for rows whose hash
may occur twice, and of those a group's smallest and largest text are aggregated
on the map side: the two are equal exactly if all bytes of the group are.

A text that a large part of all rows has does not gather these rows in one task: the few
hashes of so many rows are broadcast.

Defined results: null text counts as empty; texts of any length are hashed and compared whole; a null doc_id is never kept over another;
rows that repeat a doc_id and its text form one group and are all marked as kept;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import ascii_lower, bitmap, has_repeats, matched, saved, text_of, with_maybe, without


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, bits: int | None = None, hash_of: Callable[[Column], Column] = content_hash, stable: Callable = F.max) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs(doc_id, text).

    stable picks the id that stays of equal texts: F.max or F.min.
    """
    whole = docs.select(F.col("doc_id"), ascii_lower(text_of()).alias("t")).withColumn("h", hash_of(F.col("t")))
    rows = saved(whole.select("doc_id", "h", F.unhex(F.sha2("t", 256)).alias("sha")))
    total = rows.count()
    groups = saved(rows.groupBy("h").agg(stable("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), total)

    doubtful = with_maybe(whole, bitmap(groups, "h", bits), "h", "maybe").where("maybe").drop("maybe")
    extremes = doubtful.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    mixed = saved(extremes.where("lo <> hi").select("h"))

    out = matched(rows, groups.withColumn("n", F.col("group_size")), "h", total, "left")
    if not mixed.isEmpty():  # different bytes under one hash: these rows are grouped by their bytes
        apart = doubtful.join(mixed, "h", "left_semi").withColumn("sha", F.unhex(F.sha2("t", 256)))
        exact = apart.groupBy("h", "t").agg(stable("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.join(mixed, "h", "left_anti").unionByName(apart.join(exact, ["h", "t"]).drop("t"))
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat an id and a text, or a text without id, one stays."""
    gone = exact_groups(docs, **options).where("NOT kept").select("doc_id", F.col("text_sha256").alias("mark"))
    left = without(docs, gone, F.sha2(ascii_lower(text_of()), 256))
    if has_repeats(docs):
        left = left.withColumn("_same_text", F.md5(ascii_lower(text_of()))).dropDuplicates(["doc_id", "_same_text"]).drop("_same_text")
    return left
