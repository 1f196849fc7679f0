"""Queries of problems 7 to 9."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import garbling, leakage, mixing
from palimpsest.sources.tables import table

#: The public vocabulary that documents are measured with.
TOKENIZER = os.environ.get("PALIMPSEST_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item in how many documents it leaks, and in how many more a passage is held that reaches into its instructions."""
    items = table(spark, d, "eval_items")
    n = leakage.leaks(table(spark, d, "documents"), items, heads=True).groupBy("item_id")
    n = n.agg(F.count_if(~F.col("by_head")).alias("documents"), F.count_if("by_head").alias("documents_by_head"))
    return items.select("item_id", "task").join(n, "item_id").select("item_id", "task", "documents", "documents_by_head")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), TOKENIZER)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), TOKENIZER), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garbling.garbled(table(spark, d, "documents"), restored=False)


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbling.garbled(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p7_found, p7_items, p8_mix, p8_shares, p9_found, p9_restored)}

ORACLE: dict[str, str] = {}
