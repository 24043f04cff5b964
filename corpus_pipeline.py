"""The corpus pipeline: stages that each call one operator of ``voxelloom.llm``.

Every stage works on all that the one before kept and returns the columns of
``documents``; the last one returns the packed pieces with their ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import decontaminate, line_dedup, packing, quality, simhash
from voxelloom.llm.common import table
from voxelloom.session import shared_dir


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are equal or similar to an earlier one go; ``n_chars`` follows."""
    size = F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))
    return line_dedup.deduplicate(docs).withColumn("n_chars", size)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the one with the smallest id stays."""
    return simhash.deduplicate(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids along the curve."""
    import public_tokenizers

    return packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("packing", pack),
]

#: Trained models and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written to the
    shared folder and read again for the next one."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
