"""Corpus pipeline: quality classifier, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents; each result is written
as Parquet and read again as the next stage's docs, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import packing, quality, simhash, substrings
from pairloom.llm.common import spool, table, texts
from pairloom.session import ship


def _shipped(stage):
    """The stage, after the package has been sent to the executors."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


@_shipped
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Documents that the classifier scores `least` or more."""
    scored = quality.score(docs, table(spark, sf_dir, "labels"), into="__quality")
    return scored.where(F.col("__quality") >= least).select(docs.columns)


@_shipped
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document of smallest doc_id."""
    return simhash.one_of_each(docs)


@_shipped
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller doc_id holds too; other texts stay as they are."""
    done = substrings.strip_repeats(docs.drop("n_chars"), into="__stripped")
    text = F.when(F.col("__stripped.n_removed") > 0, F.col("__stripped.kept")).otherwise(F.col("text"))
    return done.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@_shipped
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences of 1024 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", keep_quality), ("near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("packing", pack)]

#: No SQL: a fitted classifier, linked fingerprints and token ids are not to be had there; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's result is written and read again."""
    docs = texts(spark, sf_dir)
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
