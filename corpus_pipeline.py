"""From raw documents to token counts: five operators of vouch.llm, each on all that the one before it kept.

Quality, copies, near copies and benchmark leaks are removed in turn, and what is left is tokenised. Each stage's
result is a Parquet table of its own. With a run_id, run() finds the stages that an earlier run has finished and
goes on after them, so a failed run is taken up where it broke off.

Every stage takes (spark, docs, sf_dir) and handles the same cases: null texts count as empty, texts of any length
are read whole, rows of a null doc_id are judged like others, repeated rows are told in each docstring, an empty
table gives an empty one, and all but the last return the columns of docs as they are, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vouch.llm import bpe, decontaminate, exact_dedup, quality, simhash
from vouch.llm.common import finished, shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Repeated rows go or stay together; without usable labels all stay.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as it stands, then the smallest doc_id.

    All empty texts are one group; of repeated rows one stays.
    """
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest doc_id: shingles of five words, five bits of difference.

    Texts without words are one group; rows of one doc_id go or stay together.
    """
    return simhash.keep_one_each(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Repeated rows go or stay together; without items all stay."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document; repeated rows repeat their result, empty texts have no tokens."""
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("leaks", leak_stage), ("tokens", token_stage)]
#: Trained scores, fingerprints and tokens are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """Applies the stages to sf_dir's documents; each result is written as Parquet and read again.

    Stages that a run of the same run_id has finished are read instead; without one, all are run.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/vouch-pipeline-{run_id or uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        if not finished(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
