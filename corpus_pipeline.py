"""A training corpus in five stages, each of which takes what the previous one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, mixing, quality, setsketch, sharding
from tidemark.llm.storage import materialise


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return setsketch.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The languages at their target weights: every document once at least, some several times."""
    return mixing.mix(docs, mixing.languages(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), mixing.TARGETS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and each row's shard and slot."""
    return sharding.shard(docs, shards=8, carry=True)


STAGES = [
    ("quality classifier", good_documents),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]
#: SQL can't express the classifier that the first stage learns, nor what the mixture fits.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each one's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, "stage")
    return docs
