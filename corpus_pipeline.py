"""A corpus pipeline: language ID, exact dedup, near dedup, mixing, and encoding.

Every stage takes null, empty and very long texts, null and repeated ids, an empty table, and columns of any other
name, which it hands on (the last stage returns its own columns). Each stage's docstring says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from longview.llm import bpe, exact, language, mixing, ngram
from longview.llm.common import Scratch, cut
from longview.llm.queries import BUDGET, TARGETS

#: SQL can't express the n-gram centroids, naming rounds, fitted rates or byte pairs.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters (null and empty ones too), or far from every language; wholly repeated rows fare alike."""
    return language.accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest as written stays, then the smallest id, a null id last; rows equal in id and text all stay, as one."""
    return exact.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at Jaccard 0.8 on five-word shingles the smallest id stays; texts without words, and rows without id, stay."""
    return ngram.one_of_each_group(docs, width=5, percent=80)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat, or go, so that expected tokens by quality meet the targets; rows equal in id and text are treated alike."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS, budget=BUDGET)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens of each row, and digests of its ids and of the decoded text; a null text is empty."""
    return bpe.digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_domains),
    ("bpe", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read back before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir))
        return cut(STAGES[-1][1](spark, docs, sf_dir))
