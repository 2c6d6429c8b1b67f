"""Corpus pipeline: toxicity filter, exact dedup, near dedup, repeated-passage
removal, packing. Every stage is written as Parquet and read again, so each
one works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayline.llm import (bloom_dedup, ngram_join, packing, suffix_dedup, toxicity_grammar)
from assayline.llm.common import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, trained on the labels, does not reject."""
    return toxicity_grammar.clean_rows(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts: the smallest doc_id."""
    return bloom_dedup.single_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicate texts: the smallest doc_id."""
    return ngram_join.kept_rows(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages seen earlier."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row a piece."""
    return packing.packed_documents(docs, packing.default_tokenizer())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("repeated_passages", repeated_passages), ("packing", pack)]

#: Tokenizing and learned scores have no SQL form; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
