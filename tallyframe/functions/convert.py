"""Strict text-to-type conversions.

Each kind is a pair: a parse that yields NULL for anything it cannot read, and a strict
form that turns "not blank but unreadable" into an error naming the column only. Parsing
uses the try_ functions so that no engine message can quote the offending value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.contract import KINDS, Table

# Accepted token shapes.
INTEGER_TOKEN = r"-?[0-9]+"
DIGITS_TOKEN = r"[0-9]+"
MONEY_TOKEN = r"[$]?-?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.][0-9]{1,2})?"
POSTAL_TOKEN = r"[0-9]{1,5}([.]0)?"
TIMESTAMP_TOKEN = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?)?"
MONTH_TOKEN = r"[0-9]{1,2}/[0-9]{4}"
DOUBLE_TOKEN = r"[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|NaN|Infinity)"


def full_match(text: Column, pattern: str) -> Column:
    # \z, because $ also matches before a final line break
    return text.rlike(rf"^(?:{pattern})\z")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends (``trim`` removes spaces only)."""
    # the lookbehind lets each run of white space be tried once, however long it is
    return F.regexp_replace(text, r"(?U)^\s+|(?<!\s)\s+\z", "")


def _token(pattern: str, prepare: Callable[[Column], Column], kind: str) -> Callable[[Column], Column]:
    def parse(text: Column) -> Column:
        token = F.trim(text)
        return F.when(full_match(token, pattern), prepare(token).try_cast(KINDS[kind]))

    return parse


def _unchanged(token: Column) -> Column:
    return token


def _money_digits(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit("$"), F.lit("")), F.lit(","), F.lit(""))


def _flag(text: Column) -> Column:
    token = F.upper(F.trim(text))
    return F.when(token == "YES", F.lit(True)).when(token == "NO", F.lit(False))


def _month(text: Column) -> Column:
    token = F.trim(text)
    return F.when(full_match(token, MONTH_TOKEN), F.try_to_timestamp(token, F.lit("M/yyyy")).cast("date"))


def _postal(text: Column) -> Column:
    token = F.trim(text)
    return F.when(
        full_match(token, POSTAL_TOKEN), F.lpad(F.regexp_replace(token, r"[.]0\z", ""), 5, "0")
    ).otherwise(blank_to_null(text))


PARSERS: dict[str, Callable[[Column], Column]] = {
    "bigint": _token(INTEGER_TOKEN, _unchanged, "bigint"),
    "integer": _token(INTEGER_TOKEN, _unchanged, "integer"),
    "digits": _token(DIGITS_TOKEN, _unchanged, "digits"),
    "money": _token(MONEY_TOKEN, _money_digits, "money"),
    "timestamp": _token(TIMESTAMP_TOKEN, _unchanged, "timestamp"),
    "flag": _flag,
    "month": _month,
    # the cast alone would also read suffixed numbers such as 5d
    "double": _token(DOUBLE_TOKEN, _unchanged, "double"),
    "postal": _postal,
    "text": blank_to_null,
    "verbatim": _unchanged,
}
#: kinds for which every text is acceptable
TOTAL_KINDS = {"text", "postal", "verbatim"}


def parse(text: Column, kind: str) -> Column:
    return PARSERS[kind](text)


def malformed(text: Column, kind: str) -> Column:
    """True where the text is neither blank nor readable as this kind."""
    if kind in TOTAL_KINDS:
        return F.lit(False)
    return F.coalesce(blank_to_null(text).isNotNull() & PARSERS[kind](text).isNull(), F.lit(False))


def strict(text: Column, kind: str, name: str) -> Column:
    """Parse, or stop the job with a message that never contains the value."""
    value = PARSERS[kind](text)
    if kind in TOTAL_KINDS:
        return value
    stop = F.raise_error(F.lit(f"Malformed {kind} value in column {name}")).cast(KINDS[kind])
    return F.coalesce(value, F.when(blank_to_null(text).isNotNull(), stop))


def convert(raw: DataFrame, table: Table) -> DataFrame:
    """Typed source table: every declared column, raw names, declared order."""
    return raw.select([
        strict(F.col(c.raw), c.kind, c.raw).alias(c.raw, metadata=dict(table.source_schema()[c.raw].metadata))
        for c in table.columns
    ])


def reject_report(raw: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One scan: ``(column_name, bad_rows)`` per column."""
    counts = raw.agg(*[F.count_if(malformed(F.col(name), kind)).alias(name) for name, kind in kinds.items()])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.col(name).alias("bad_rows")) for name in kinds
    ])))


def split_entities(text: Column, separator: str = ";") -> Column:
    parts = F.transform(F.split(text, separator), lambda part: strip(part))
    return F.filter(parts, lambda part: F.length(part) > 0)


def embedding_text(title: Column, text: Column) -> Column:
    return F.concat(title, F.lit("\n\n"), strip(text))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda word: F.length(word) > 0))
