"""A training corpus from ``documents``: five stages, each an operator of ``staylens.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``; the last returns the packed pieces.

Null texts have no language and go in the first stage; rows repeated with one
id are one row after the second; an empty table passes through as no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from staylens.llm import exact_dedup, language, mixing, ngram_join, packing
from staylens.llm.common import documents
from staylens.session import cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    return language.keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of equal texts stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of linked texts stays."""
    return ngram_join.keep_one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in their sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", source_mix),
    ("packing", pack),
]

# Language ID and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
