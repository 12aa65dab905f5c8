"""All registered queries."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from tallyframe.plans import registry

_MODULES = ("measures", "governed", "access", "conversions", "checks", "files", "retrieval", "texts", "dialogue", "streams")

for _module in _MODULES:
    importlib.import_module(f"tallyframe.plans.{_module}")


def _prepared(function: registry.Query) -> registry.Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        # results are compared as UTC wall-clock values
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, folder)

    return run


def queries() -> dict[str, registry.Query]:
    return {name: _prepared(function) for name, function in registry.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
