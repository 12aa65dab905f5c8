"""Governed metrics: one aggregate expression per name, reused at every grain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def _money(value: Column) -> Column:
    return value.cast("decimal(38,2)")


def _total(value: Column) -> Column:
    return _money(F.coalesce(F.sum(value), F.lit(0)))


def _amount() -> Column:
    return F.col("amount")


def _errors() -> Column:
    return F.count_if(F.col("errors").isNotNull())


def average(value: Column) -> Column:
    """Mean as a double; NULL when there is nothing to average."""
    return F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0))


METRICS: dict[str, Callable[[], Column]] = {
    "transaction_count": lambda: F.count(F.lit(1)),
    "positive_amount_total": lambda: _total(F.when(_amount() > 0, _amount())),
    "negative_amount_magnitude": lambda: _total(F.when(_amount() < 0, -_amount())),
    "net_amount": lambda: _total(_amount()),
    "average_positive_amount": lambda: average(F.when(_amount() > 0, _amount())),
    "negative_transaction_count": lambda: F.count_if(_amount() < 0),
    "error_recorded_count": _errors,
    "error_recorded_rate": lambda: _errors().cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0)),
    "transacting_customer_count": lambda: F.count_distinct("client_id"),
}


def metric(name: str) -> Column:
    return METRICS[name]().alias(name)


def metrics(df: DataFrame, names: list[str]) -> DataFrame:
    return metrics_by(df, names, [])


def metrics_by(df: DataFrame, names: list[str], dimensions: list[Column | str]) -> DataFrame:
    """Metrics recomputed at the asked grain in one pass; non-additive ones are never rolled up.

    With distinct customers Spark groups by dimension and customer first, map-side, and then by dimension: a
    customer's rows are one row by then, so what is shuffled follows customers, not transactions.
    """
    return df.groupBy(*dimensions).agg(*[metric(name) for name in names])


def identity_holds(df: DataFrame) -> DataFrame:
    """Net must equal positive minus negative."""
    parts = metrics(df, ["net_amount", "positive_amount_total", "negative_amount_magnitude"])
    return parts.withColumn(
        "identity_holds", F.col("net_amount") == F.col("positive_amount_total") - F.col("negative_amount_magnitude"))


def month(timestamp: Column | str) -> Column:
    column = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return F.trunc(column.cast("date"), "month")
