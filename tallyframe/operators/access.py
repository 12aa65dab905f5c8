"""Governed projection: allowlisted relations, columns and functions, bounded results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.contract import MAX_RESULT_ROWS, TABLES, Table


class AccessDenied(ValueError):
    """A request outside the allowlists."""


def canonical(source: DataFrame, table: Table) -> DataFrame:
    """Exposed columns only, under their canonical names."""
    return source.select([
        F.col(c.raw).alias(c.canonical, metadata={"sensitivity": c.sensitivity}) for c in table.exposed
    ])


class GovernedCatalog:
    """Relations that may be read, by fully qualified name."""

    schema = "main"

    def __init__(self, relations: dict[str, DataFrame]):
        self._relations = {f"{self.schema}.{name}".lower(): df for name, df in relations.items()}

    def _relation(self, name: str) -> DataFrame:
        parts = name.lower().split(".")
        if len(parts) == 1:
            raise AccessDenied(f"Name relations as {self.schema}.relation")
        relation = self._relations.get(name.lower())
        if len(parts) != 2 or relation is None:
            raise AccessDenied(f"No such relation for you: {name}")
        return relation

    def _columns(self, name: str, columns: list[str]) -> list[str]:
        available, alias = self._relation(name).columns, name.lower().split(".")[1]
        by_lower = {c.lower(): c for c in available}
        picked = []
        for column in columns:
            if "*" in column:
                raise AccessDenied("Columns are to be named one by one")
            prefix, _, bare = column.rpartition(".")
            known = (bare if bare in available else None) if prefix else by_lower.get(bare.lower())
            if known is None or (prefix and prefix.lower() != alias):
                raise AccessDenied(f"No such column for you: {column}")
            picked.append(known)
        return picked

    def select(self, name: str, columns: list[str], limit: int | None = None) -> DataFrame:
        """Explicit columns of one relation; a qualified name (``t.column``) must match exactly."""
        return bounded(self._relation(name).select(*self._columns(name, columns)), limit)

    def total(self, name: str, by: list[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
        """Measures (new name to allowed function and column) per combination of columns; bound the result to show it."""
        values = {new: call(function, F.col(self._columns(name, [column])[0])) for new, (function, column) in measures.items()}
        return self._relation(name).groupBy(*self._columns(name, by)).agg(*[v.alias(n) for n, v in values.items()])


def bounded(df: DataFrame, limit: int | None = None, *, scalar: bool = False) -> DataFrame:
    """Apply the row bound: 100 when none is given, 1 to 100 when it is; a scalar aggregate needs none."""
    if limit is None:
        return df if scalar else df.limit(MAX_RESULT_ROWS)
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_RESULT_ROWS:
        raise AccessDenied(f"Ask for 1 to {MAX_RESULT_ROWS} rows")
    return df.limit(limit)


# The functions a governed expression may call.
ALLOWED_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "ABS": F.abs,
    "AVG": lambda c: F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0)),
    "CASE": F.when,
    "CAST": lambda c, kind: c.cast(kind),
    "CEIL": F.ceil,
    "COALESCE": F.coalesce,
    "COUNT": F.count,
    "COUNT_DISTINCT": F.count_distinct,
    "EXTRACT": lambda part, c: F.extract(F.lit(part), c).cast("long"),
    "FLOOR": F.floor,
    "IF": lambda test, yes, no: F.when(test, yes).otherwise(no),
    "LOWER": F.lower,
    "MAX": F.max,
    "MIN": F.min,
    "NULLIF": F.nullif,
    "ROUND": F.round,
    "SUM": F.sum,
    "TIMESTAMP_TRUNC": lambda unit, c: F.date_trunc(unit, c).cast("timestamp_ntz"),
    "UPPER": F.upper,
}


def call(function: str, *arguments) -> Column:
    """Build an expression from an allowed function name."""
    builder = ALLOWED_FUNCTIONS.get(function.upper())
    if builder is None:
        raise AccessDenied(f"No such function for you: {function.upper()}")
    return builder(*arguments)


# The only payload fields that may leave retrieval.
SAFE_PAYLOAD = ("doc_id", "title", "category", "doc_type", "date", "summary")
CITATION_FIELDS = ("title", "doc_type", "category", "date")


def safe_payload(hits: DataFrame) -> DataFrame:
    """Allowed text fields plus the document text; hits without a string id or text are dropped."""
    text_fields = {f.name for f in hits.schema.fields if f.dataType.simpleString() == "string"}
    if not {"doc_id", "text"} <= text_fields:
        return hits.select("*").where(F.lit(False))
    keep = [c for c in SAFE_PAYLOAD if c in text_fields]
    return hits.where((F.col("doc_id") != "") & F.col("text").isNotNull()).select(
        *[c for c in hits.columns if c in ("query_id", "rank")], *keep, "text",
    )


def citations(hits: DataFrame, cited: DataFrame, by: list[str]) -> DataFrame:
    """Citation metadata of the retrieved documents that were cited, in retrieval order (``rank``)."""
    kept = hits.join(cited.select(*by, "doc_id").distinct(), [*by, "doc_id"], "left_semi")
    fields = [c for c in CITATION_FIELDS if c in hits.columns]
    return kept.select(*by, "rank", F.col("doc_id").alias("source_hash"), *fields)
