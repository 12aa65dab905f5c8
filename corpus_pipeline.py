"""Documents to tokens: quality rules, near copies, private data, mixing and encoding.

Every stage takes what its predecessor kept, written as Parquet in the shared folder. All but the last
return the columns of documents; n_chars follows the text. The mix repeats a document as often as it
takes it, so an id may occur twice from there on.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyframe.llm import bpe, mixing, neardup, pii, rules
from tallyframe.llm.common import table, whole_text
from tallyframe.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _row_key() -> list[Column]:
    """What tells rows apart for a verdict that depends on id, text, language and source only."""
    values = [x for c in COLUMNS[:4] for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(*values).alias("_key"), F.crc32(whole_text().cast("binary")).alias("_crc")]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the outlier estimate of their language and source reject.

    Null and empty texts fail the base rules; equal rows share their verdict, as do a null language or source
    among themselves; an empty table stays empty.
    """
    keyed = docs.select(*COLUMNS, *_row_key())
    judged = rules.judge(keyed, keep=["_key", "_crc"])
    rejected = judged.where(~F.col("kept")).select("_key", "_crc").distinct()
    return keyed.join(rejected, ["_key", "_crc"], "left_anti").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies, as ``neardup.keep_one`` says: also of rows without an id."""
    return neardup.keep_one(docs, COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; null texts stay null, with a null n_chars, and every row stays."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mix of its source's target does.

    Texts without words keep their whole copies, which weigh nothing; a null source is one of its own; ties of the random numbers go by
    id, and equal rows are taken as often as all of them together; an empty table stays empty.
    """
    taken = mixing.mix(docs).groupBy("doc_id", "number").agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("rows"))
    taken = materialise(taken.where("copies > 0"), "taken").withColumnsRenamed({"doc_id": "_id", "number": "_number"})
    rows = docs.select(*COLUMNS, mixing.number().alias("_row"))
    if not taken.where("rows > 1").isEmpty():  # equal rows are counted together
        rows = rows.dropDuplicates(["doc_id", "_row"])
    joined = rows.join(taken, rows["doc_id"].eqNullSafe(taken["_id"]) & (rows["_row"] == taken["_number"]))
    return joined.select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_")).drop("_")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of every row; null and empty texts have no ids, repeated rows are encoded each."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("near_copies", near_copies), ("private_data", private_data), ("mixture", mixture), ("tokens", tokens),
]
#: fingerprints, estimates, hashes and merges are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
