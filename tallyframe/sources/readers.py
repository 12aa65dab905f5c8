"""Readers with declared schemas; nothing is inferred and nothing malformed is skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyframe.contract import Table
from tallyframe.sources.files import list_files, require_headers

MCC_KEY = r"^[0-9]{4}\z"


def read_text_columns(
    spark: SparkSession, path: str | list[str], columns: list[str], *, multiline: bool = False,
) -> DataFrame:
    """Delimited file with every field as text and empty fields as NULL.

    Quotes are escaped by doubling. Files stay splittable unless ``multiline`` is asked for;
    without it a record with a quoted line break stops the job instead of being misread.
    """
    return _whole(_text_records(spark, path, columns, multiline))


#: a record that does not fit its schema is put here by Spark's readers, and named by no message
_MALFORMED = "_malformed_record"


def _text_records(spark: SparkSession, path: str | list[str], columns: list[str], multiline: bool) -> DataFrame:
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*columns, _MALFORMED]])
    return (
        spark.read.schema(schema)
        .options(header=True, quote='"', escape='"', sep=",", nullValue="", mode="PERMISSIVE", columnNameOfCorruptRecord=_MALFORMED,
                 enforceSchema=False, multiLine=multiline, columnPruning=False, encoding="UTF-8")
        .csv(path)
    )


def _whole(records: DataFrame) -> DataFrame:
    """The rows, or an error that names the file of a malformed record and nothing of its content."""
    stop = F.raise_error(F.concat(F.lit("Malformed record in "), F.col("_metadata.file_name")))
    columns = [c for c in records.columns if c != _MALFORMED]
    return records.where(F.when(F.col(_MALFORMED).isNotNull(), stop.cast("boolean")).otherwise(F.lit(True))).select(
        *columns, "_metadata").select(*columns)


def rejects(spark: SparkSession, path: str | list[str], columns: list[str], *, multiline: bool = False) -> DataFrame:
    """``(file, records, malformed)``: how many records of each delimited file do not have the declared columns."""
    records = _text_records(spark, path, columns, multiline).select("*", F.col("_metadata.file_path").alias("file"))
    return records.groupBy("file").agg((F.count(columns[0]) + F.count_if(F.col(columns[0]).isNull())).alias("records"), F.count(_MALFORMED).alias("malformed"))


def read_strict(spark: SparkSession, path: str, table: Table, *, multiline: bool = False) -> DataFrame:
    """A contract table as text; stops on header drift before any row is read."""
    require_headers(list_files(spark, path), table.raw_names)
    return read_text_columns(spark, path, table.raw_names, multiline=multiline)


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """``(mcc, description)`` for every entry of JSON object files, repeated keys included.

    A description that is no text is null, and so reported as a problem.
    """
    content = spark.read.text(path, wholetext=True).select(
        F.from_json(F.regexp_replace("value", "^\ufeff", ""), "map<string,variant>").alias("m"), F.col("_metadata.file_name").alias("file"))
    entries = F.coalesce("m", F.raise_error(F.concat(F.lit("Not a JSON object: "), "file")).cast("map<string,variant>"))
    values = content.select(F.explode(entries).alias("mcc", "v"))
    return values.select("mcc", F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")).alias("description"))


def json_entry_problems(entries: DataFrame) -> DataFrame:
    """Keys that are repeated, not four digits, or lack a description."""
    return (
        entries.groupBy("mcc")
        .agg(F.count(F.lit(1)).alias("entries"),
             F.count_if(F.coalesce(F.trim("description"), F.lit("")) == "").alias("blank_descriptions"))
        .where((F.col("entries") > 1) | (F.col("blank_descriptions") > 0) | ~F.col("mcc").rlike(MCC_KEY))
    )


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    entries = json_entries(spark, path)
    problem = json_entry_problems(entries).take(1)
    if problem:
        kind = "Duplicate key" if problem[0].entries > 1 else "Invalid entry"
        raise ValueError(f"{kind} in the JSON lookup; keys are four digits with a non-blank description")
    return entries


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object per line; blank lines are skipped, anything else malformed stops the job."""
    declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    held = T.StructType([*declared.fields, T.StructField(_MALFORMED, T.StringType())])
    return _whole(spark.read.schema(held).options(mode="PERMISSIVE", columnNameOfCorruptRecord=_MALFORMED).json(path))


MANIFEST_COLUMNS = [
    "doc_id", "category", "doc_type", "format", "title", "date", "path", "word_count", "entities", "summary",
]


def keep_last(rows: DataFrame, key: str) -> DataFrame:
    """One row per key of a file source, the last in file order; combined map-side before the shuffle.

    The place of a row is its file, its block in the file and its position in the block, because
    Spark may read blocks in another order than they are stored.
    """
    others = [c for c in rows.columns if c != key]
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    placed = rows.select("*", place.alias("_place"))
    last = placed.groupBy(key).agg(F.max_by(F.struct(*others), "_place").alias("_row"))
    return last.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def read_manifest(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    return keep_last(read_text_columns(spark, path, columns or MANIFEST_COLUMNS), "doc_id")
