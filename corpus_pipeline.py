"""From raw documents to packed training sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact_dedup, langid, mixing, packing, simhash
from quillon.llm.common import documents, remove, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter have no language; they go."""
    return langid.with_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose five-word shingles are similar, 0.8 or more by Jaccard, directly or through others, the one with the smallest id stays.

    Texts without words are alike, a null id goes before another, repeated rows are one.
    """
    return simhash.similar_deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; those without words go.

    A null source is the last one, a null text has no words, rows that share an id are taken each by itself.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the sequence and offset of each; a null or empty text is one token."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: Languages, similarities and packing are beyond SQL; the tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table. What is between them lies in the folder of spark.checkpoint.dir.

    A stage's table goes when the next one is written; the last before packing, the training corpus, stays.
    """
    root = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, last = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{root}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                remove(spark, last)
            last = path
    return docs
