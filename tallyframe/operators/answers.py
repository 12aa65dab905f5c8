"""Checks on generated answers, charts and suggestions, all within the row."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyframe.functions.convert import parse, strip
from tallyframe.operators.linking import MAX_SUGGESTION_LENGTH, MAX_SUGGESTIONS
from tallyframe.sources.publish import json_safe

# Fixed value: what is said instead of a serialised answer.
FALLBACK_ANSWER = "The result is shown in the table/chart above; ask a narrower question for a written summary."
CHART_TYPES = ("bar", "line")
MAX_CHART_POINTS = 25


def clean_suggestions(df: DataFrame, suggestions: str, asked: list[str]) -> DataFrame:
    """Trimmed, non-blank, short enough, not the asked question, no repeats (any case); the first three.

    Done in steps, so that each list is built once per row.
    """
    asked_keys = F.array(*[F.coalesce(F.lower(strip(F.col(a))), F.lit("")) for a in asked])
    trimmed = F.transform(F.array_compact(suggestions), lambda s: strip(s))
    usable = df.withColumn("_usable", F.filter(
        trimmed, lambda s: (F.length(s) > 0) & (F.length(s) <= MAX_SUGGESTION_LENGTH)))
    keyed = usable.withColumn("_keys", F.transform("_usable", lambda s: F.lower(s)))
    # a set difference keeps the order of first occurrences and drops repeats
    first = keyed.withColumn("_first", F.slice(F.array_except("_keys", asked_keys), 1, MAX_SUGGESTIONS))
    return first.withColumn(suggestions, F.transform(
        "_first", lambda key: F.element_at("_usable", F.array_position("_keys", key).cast("int")))).select(*df.columns)


def check_chart(kind: Column, x: Column, y: Column, columns: Column) -> Column:
    """The chart specification, or NULL unless type and both axes are valid."""
    valid = kind.isin(*CHART_TYPES) & F.array_contains(columns, x) & F.array_contains(columns, y)
    return F.when(valid, F.struct(kind.alias("type"), x.alias("x"), y.alias("y")))


def chart_points(results: DataFrame, by: list[str], position: str, x: str, y: str) -> DataFrame:
    """The first 25 rows of each result as points; the cut comes before unusable values are dropped.

    A missing label becomes a dash, a missing value zero; text that is no finite number is dropped.
    """
    if isinstance(results.schema[y].dataType, T.BooleanType):
        results = results.withColumn(y, F.col(y).cast("int"))
    text = F.coalesce(F.trim(F.col(y).cast("string")), F.lit(""))
    number = F.when(text == "", F.lit(0.0)).otherwise(parse(text, "double"))
    window = Window.partitionBy(*by).orderBy(position)
    first = results.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= MAX_CHART_POINTS)
    points = first.select(*by, position, F.coalesce(F.col(x).cast("string"), F.lit("—")).alias("label"), number.alias("value"))
    infinite = F.col("value").isin(float("inf"), float("-inf"))
    return points.where(F.col("value").isNotNull() & ~F.isnan("value") & ~infinite)


def _serialised(answers: pd.Series) -> pd.Series:
    def one(answer: str | None) -> bool:
        if not answer or answer[0] not in "[{":
            return False
        try:
            return isinstance(ast.literal_eval(answer), (list, dict))
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return False

    return answers.map(one).astype(bool)


def check_answer(answer: Column) -> Column:
    """Replace an answer that is a serialised list or object by a fixed sentence.

    Serialised means: it starts with a bracket and reads as a literal of lists, dictionaries, tuples,
    texts, numbers, booleans and nothing; only such a reader settles quotes inside quotes.
    """
    serialised = F.pandas_udf(_serialised, "boolean")
    # a condition does not spare Python, but what cannot be a literal travels there as null
    bracketed = F.when(F.substring(answer, 1, 1).isin("[", "{"), answer)
    return F.when(serialised(bracketed), F.lit(FALLBACK_ANSWER)).otherwise(answer)


def result_digest(result: DataFrame, order: list[Column]) -> DataFrame:
    """SHA-256 of the columns and rows of a bounded result, in row order, written as compact JSON.

    Numbers are digested as numbers and dates as ISO text. The result must already carry its row bound
    (``access.bounded``): at most 100 rows meet in one task here.
    """
    columns = result.columns
    numbered = result.select(F.struct(*order).alias("_order"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    rows = json_safe(numbered.agg(F.transform(F.sort_array(F.collect_list(F.struct("_order", "_row"))), lambda r: r["_row"]).alias("rows")))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"result_digest": [hashlib.sha256(json.dumps(
                {"columns": columns, "rows": [[_plain(r[c]) for c in columns] for r in found]},
                sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest() for found in batch["rows"]]})

    return rows.mapInPandas(digest, "result_digest string")


def _plain(value):
    return value.item() if isinstance(value, np.generic) else value


def distinct_in_order(values: Column, allowed: Column) -> Column:
    """Repeats removed, first occurrence kept, restricted to the allowed values."""
    return F.array_distinct(F.filter(values, lambda v: F.array_contains(allowed, v)))
