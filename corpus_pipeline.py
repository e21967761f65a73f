"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage works on all that its predecessor kept.  All but the last return the columns of
documents; the last returns the encoded form of what is left.  Rows that share a doc_id stay or go
together in the near-duplicate stage; the mixing stage may repeat rows (epochs).  Each stage accepts an empty
table and null texts: these are empty texts, which the language stage rejects, as it does all texts without a letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rscframe.llm import bpe, language, mixing, neardup, quality
from rscframe.llm.textkit import Workspace, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.7 or more."""
    return quality.accepted(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart by its profile."""
    return language.identified(docs, language.learn_profiles(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8)."""
    return neardup.without_near_duplicates(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the weights of their domain, language and source."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, digests of the ids and of the decoded text."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each),
    ("mixing sources to target weights", target_mix),
    ("BPE encoding and decoding", encoded),
]

ORACLE_SQL = None  # models and approximate keys are beyond SQL; tests/llm/test_pipeline.py checks columns and effects of the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, work.cut(stage(spark, docs, sf_dir))
        work.drop(before)
    return docs
