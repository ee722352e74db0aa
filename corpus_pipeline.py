"""A training corpus from ``documents``: stages that each apply one operator to what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dendrospark.llm import decontam, secrets, shingle_join, sp_bpe, toxicity
from dendrospark.llm.queries import table, tokenizer_path
from dendrospark.llm.shared import discard, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    return shingle_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, digests of ids and of the decoded text."""
    return sp_bpe.encode_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]
ORACLE_SQL = None  # the learned lexicon and the encoder can't be written in SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
