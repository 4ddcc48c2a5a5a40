"""The corpus pipeline: quality rules, language, near duplicates, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; ``run`` writes every stage's
frame as Parquet into the shared checkpoint folder and gives it to the next one as its docs.
All stages but the last return the columns of ``documents``; the last returns packed pieces.

Repeated doc_ids are possible after mixing (a document taken in two passes has a row each).
An empty table runs through and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wearline.llm import language, mixing, ngram_join, packing, quality
from wearline.llm.common import scratch_table, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the base rules or their host's verdict reject go."""
    return quality.reject(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents without a recognisable language go."""
    return language.reject(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each class of near duplicates stays."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: sources are drawn to their target weights, block by block."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: what was mixed is packed into sequences."""
    return packing.pack(packing.pieces(docs, packing.vocabulary_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL can express neither the trained network nor the packing: tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir))
    return docs
