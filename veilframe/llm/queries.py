"""The queries of the numbered operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import (
    alignment,
    chat,
    decontaminate,
    language_id,
    line_rules,
    merkle,
    near_dedup,
    oracles,
    packing,
    quality,
    sharding,
    simhash,
    substring_dedup,
    toxicity,
)
from veilframe.llm.base import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {"op1_near_dedup": oracles.NEAR_DEDUP, "op6_substring_dedup": oracles.SUBSTRING_DEDUP, "op10_line_rules": oracles.LINE_RULES, "op13_merkle_manifest": oracles.MERKLE}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=2, percent=80)


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    kept = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.balanced_shards(_table(spark, sf_dir, "documents"))
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(_table(spark, sf_dir, "documents")).drop("text")


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(language_id.document_rows(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


@query
def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over web pages, whose markup and addresses give all its evidence."""
    return language_id.identify(language_id.page_rows(_table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(chat.as_tool_log(_table(spark, sf_dir, "conversations")), chat.SCHEMAS)


@query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))
