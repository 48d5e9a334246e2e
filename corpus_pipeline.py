"""Corpus pipeline: quality rules, near duplicates, decontamination, mixing, token records.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``: the
first three drop rows, the fourth drops and repeats them as the mix takes them, and the last describes the
records it wrote (doc_id, start, n_tokens, ids_crc32). Stages handle nulls, empty tables, repeated rows and
extra columns as their operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tunekiln.llm import decontaminate, line_rules, mixing, near_join, records
from tunekiln.llm.common import land, read
from tunekiln.session import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and hold enough content lines."""
    prepare(spark)
    return line_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    prepare(spark)
    return near_join.keep_one(docs, percent=80, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark windows."""
    prepare(spark)
    return decontaminate.keep_documents(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, repeated as often as it takes them."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in framed records, read back and checked."""
    prepare(spark)
    return records.write_and_describe(docs, spark).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("token records", token_records),
]

# the line labels, the knapsack and the tokenizer have no SQL form; tests compare each stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = land(docs, f"stage-{i + 1}")
    return docs
