"""The operators as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import bpe, language, mixing, neardup, pii, pitman, quality, repair, rules, sharding, simhash, sql, toxicity, variants
from tallyframe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judge(table(spark, folder, "documents"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(table(spark, folder, "documents"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, folder, "documents")))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, folder, "documents"))


def op7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.compare(table(spark, folder, "documents"))


def op11_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.audit(table(spark, folder, "conversations"))


def op12_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(table(spark, folder, "documents"))


def op13_pitman(spark: SparkSession, folder: str) -> DataFrame:
    return pitman.score(table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (
        op1_rules, op2_simhash, op3_pii, op4_bpe, op5_toxicity, op6_shards, op7_mix, op8_quality, op9_language, op10_simhash, op11_repair,
        op12_variants, op13_pitman, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op11_repair": sql.OP11, "op12_variants": sql.OP12}
