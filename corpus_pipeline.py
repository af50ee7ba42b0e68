"""The corpus pipeline: five operators in a row, each on all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread
as the next one's docs. All but the last return the columns of ``documents``; the last returns where each piece of each document is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import common, exact_dedup, mixing, packing, quality, simhash


# Stages write their result in the shared folder, so that the shuffle files of whole texts go at once.
# Every stage: null texts count as empty; texts of any length are handled whole; rows with equal ids or equal in all columns are rows of their own; an
# empty table gives an empty one; extra columns of any name are kept (the last stage returns its own columns only). The operators' docstrings say more.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or stray from every language reference go.

    Null and empty texts have no words and go; of equal rows all stay or all go; a null lang makes no reference but is judged."""
    with common.batches(spark):  # what is given to Python runs while batches are small
        return common.written(spark, lambda: quality.keep(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest doc_id (null last); of rows equal in both, one. Null and empty texts are one group."""
    return common.written(spark, lambda: exact_dedup.deduplicate(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id stays (null last; of equal ids one). Null and empty texts have fingerprint zero."""
    with common.batches(spark):
        return common.written(spark, lambda: simhash.deduplicate(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it, 0 to 3. A null source is a source of its own; null and empty texts have size 0; rows of equal rank are taken in an
    order of their sizes."""
    return common.written(spark, lambda: mixing.apply(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of at most 1024 tokens. Null and empty texts are their end id; copies are pieces of their own."""
    with common.batches(spark):
        return packing.report(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Fingerprints, tokenizer and genetic search are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; tables between stages are in the shared folder, and go once they are read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:  # all but the last write their tables themselves
        docs = stage(spark, docs, sf_dir)
    return docs
