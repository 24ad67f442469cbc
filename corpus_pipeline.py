"""The corpus pipeline: documents pass five stages, each written as Parquet and read again by the next.

Documents that the quality classifier rejects go; of each group of near-duplicates the one with the smallest id stays; documents with a
benchmark item go; secrets in the texts are replaced by a mark; what is left is encoded into SentencePiece numbers. Rows with a null id
can't be named by a decision and pass all stages. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloft.llm import decontaminate, quality, secret_scans, sentencepieces, simhash_dedup
from sigloft.llm.catalog import vocabulary
from sigloft.llm.common import table
from sigloft.session import shared_folder, stored

#: Near-duplicate groups and held-out accuracy have no SQL, so the stages are tested against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scans.redacted(docs, shared_folder(spark, "blob-ledger"))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = sentencepieces.encoded(docs, vocabulary("piece_bpe_32k.model"))
    return pieces.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the documents after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
