"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, html_extract, mixing, neighbours, passages, quality, setsketch, sharding, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=8)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's transcript, read by a model of the conversations whose number 5 doesn't divide."""
    turns, held_out = _table(spark, sf_dir, "conversations"), F.coalesce(F.col("conv_id") % 5 == 0, F.lit(False))
    model = chat.learn(turns.filter(~held_out))
    return chat.format_transcripts(chat.transcripts(turns), model).select("conv_id", held_out.alias("held_out"), "n_turns", "roles", "rendered")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.rates(docs, mixing.languages(docs, _table(spark, sf_dir, "labels")), mixing.TARGETS).drop("source", "n_chars")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_html_extraction": op3_html_extraction,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_neighbours": op10_neighbours,
}
ORACLES = {
    "op1_sharding": sharding.shard_sql(8),
    "op7_decontamination": decontam.leaks_sql(),
    "op8_near_duplicates": setsketch.near_duplicates_sql(),
    "op10_neighbours": neighbours.nearest_sql(5, 50),
}
