"""The corpus pipeline: documents through five training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskbook.llm import bpe, decontaminate, quality_rules, secrets, simhash
from riskbook.llm.common import documents, ship, table, written

VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    ship(spark)
    return simhash.drop_copies(docs, shingle=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    ship(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live secrets masked."""
    return secrets.mask(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digests."""
    ship(spark)
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), keep_ids=True)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_duplicates),
          ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each but the last written as Parquet and read again.

    A NULL or empty text fails the quality rules and goes in the first stage.
    Very long texts go through whole.  Rows with a NULL or repeated ``doc_id``
    are rows of their own; of copies, repeated rows among them, the one with
    the smallest id stays (no id counts as the largest, the first written row
    decides ties).  An empty table gives an empty result.  Columns that
    ``documents`` has besides its own are carried to the last stage, whatever
    their names.
    """
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
