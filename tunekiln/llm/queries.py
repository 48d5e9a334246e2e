"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import alignment, class_lm, decontaminate, impact_index, language, line_rules, merkle, mixing, near_join, pseudonyms, ranking, records, secrets
from .common import fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(fn):
    def run(spark, sf_dir):
        prepare(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@_register
def op1_viterbi_language(spark, sf_dir):
    """Language of every whole text, learnt outside the held-out fold."""
    return language.held_out_predictions(read(spark, sf_dir, "documents")).drop("spans")


@_register
def op2_feistel_pseudonyms(spark, sf_dir):
    """Every whole text with personal numbers, addresses and dates replaced by keyed pseudonyms."""
    return pseudonyms.mask(read(spark, sf_dir, "documents"), pseudonyms.DEMO_KEY)


@_register
def op3_brown_class_lm(spark, sf_dir):
    """Unigram base score and class bigram score of every whole text, counted outside the held-out fold."""
    return class_lm.score(read(spark, sf_dir, "documents"))


@_register
def op4_token_efficiency_secrets(spark, sf_dir):
    """Secret spans of every whole text: the base kinds and strings that a token vocabulary splits badly."""
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


@_register
def op5_positional_index(spark, sf_dir):
    """Benchmark words in every whole text, by windows found through a positional inverted index."""
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL["op5_positional_index"] = decontaminate.ORACLE


@_register
def op6_length_delimited_records(spark, sf_dir):
    """Token ids of all documents in framed binary records, read back and checked."""
    return records.write_and_describe(read(spark, sf_dir, "documents"), spark).select("doc_id", "start", "n_tokens", "ids_crc32")


@_register
def op7_bradley_terry(spark, sf_dir):
    """Quality score of every whole text, learnt from preference pairs outside the held-out fold."""
    return ranking.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_register
def op8_line_crf(spark, sf_dir):
    """Base quality rules and the content share of lines labelled by a conditional random field."""
    return line_rules.judge(read(spark, sf_dir, "documents"))


@_register
def op9_parity_sketch_join(spark, sf_dir):
    """Component of every document under 3-word shingle similarity of 0.9 or more."""
    return near_join.join(read(spark, sf_dir, "documents"))


@_register
def op10_subset_sum_mix(spark, sf_dir):
    """Words that the mix takes of every document, repeats counted."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_register
def op11_impact_ordered_topk(spark, sf_dir):
    """The 20 best rows by integer inner product for every 20th vector, over an impact-ordered index."""
    return impact_index.search(read(spark, sf_dir, "embeddings"), impact_index.query_rows())


SQL["op11_impact_ordered_topk"] = impact_index.ORACLE


@_register
def op12_token_alignment(spark, sf_dir):
    """Tokens, groups and links of every whole text under two vocabularies, and how common its links are."""
    return alignment.alignment(read(spark, sf_dir, "documents"))


@_register
def op13_pointer_jumping_manifest(spark, sf_dir):
    """Leaf, subroot and root of every document, its proof, and the root folded from the damaged or original leaf."""
    return merkle.verify(read(spark, sf_dir, "documents"))


SQL["op13_pointer_jumping_manifest"] = merkle.ORACLE
