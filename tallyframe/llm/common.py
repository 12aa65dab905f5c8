"""Reading, batching and ranking helpers of the text operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.session import materialise

#: a word is a run of characters that are neither blank nor U+0009 to U+000D
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)


#: rows that a task turns into Python values at once
ROWS = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: str = "text") -> Column:
    """Runs of other characters than blanks; each becomes one letter, so no list of words is made."""
    marked = F.regexp_replace(whole_text(text), WORD + "+", "x")
    return F.char_length(F.translate(marked, "\t\n\x0b\x0c\r ", "")).cast("long")


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def map_batches(rows: DataFrame, schema: str, start: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """A function of column lists over Arrow batches, ``ROWS`` rows at a time, as texts may be long.

    ``start`` runs once per task and returns the function.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema), prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for place in range(0, batch.num_rows, ROWS):
                work = work or start()
                part = batch.slice(place, ROWS)
                yield pa.RecordBatch.from_pydict(work({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns)}), schema=arrow)

    return rows.mapInArrow(run, schema)


def ranked(rows: DataFrame, order: str, rank: str) -> DataFrame:
    """Add the position from 0 in the order of one column, nulls last, without one task seeing all rows.

    Rows are dealt by ranges and written; a position is the number of rows in earlier ranges plus
    the position inside the range. Only one count per range reaches the driver.
    """
    by = F.col(order).asc_nulls_last()
    dealt = materialise(rows.repartitionByRange(by).withColumn("_range", F.spark_partition_id()), "ranked")
    sizes = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())
    starts, seen = [], 0
    for place, size in sizes:
        starts += [F.lit(place), F.lit(seen)]
        seen += size
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    before = F.create_map(*starts)[F.col("_range")] if starts else F.lit(0)
    return dealt.withColumn(rank, inside + before).drop("_range")
