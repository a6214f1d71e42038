"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm import line_dedup, mixing, packing, quality, simhash
from parley.llm.scratch import Scratch, scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_shared_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("dedup_lines", dedup_lines),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
#: Tokenising can't be stated in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again; what a stage leaves goes as soon as the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), False
    for name, stage in STAGES[:-1]:
        with scope(spark):
            after = scratch.keep(stage(spark, docs, sf_dir), name)
        if written:
            scratch.drop(docs)
        docs, written = after, True
    return STAGES[-1][1](spark, docs, sf_dir)
