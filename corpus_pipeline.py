"""A training corpus out of `documents`: rules, near-duplicates, secrets, mixing, token ids.

Each stage works on all rows that the one before it kept. Stages but the last return the columns of
`documents`, and any others that came in, whatever their names; n_chars follows the text where a stage changes it.

Defined results of all stages: an empty table gives an empty one; a null text has no words, so the rules
reject it, and where a stage is called on its own it has no shingles, no secrets, size 0 and no ids; null ids
and sources stay; repeated rows are rows of their own, but one of each group of near-duplicates stays; very
long texts go through whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import partenum_join, quality_divergence, secret_ledger, source_mixing, sp_viterbi
from wardline.llm.common import table
from wardline.llm.entry import MODEL
from wardline.sources.scratch import forget, made, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_divergence.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that links join."""
    return partenum_join.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    clean = secret_ledger.redact(docs, secret_ledger.Ledger(spark))  # the result reads the ledger
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks."""
    return source_mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids: the token ids of each text."""
    return sp_viterbi.encode_column(docs.select("doc_id", "source", "text"), MODEL).drop("text")


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens)]
#: SQL can express neither the links over several steps nor the token ids.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, in a folder of the shared one; what the others wrote is deleted once it is read."""
    docs, at = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        there = made - {at}
        at = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        forget(spark, *(made - there - {at}))
    return docs
