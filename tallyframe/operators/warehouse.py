"""Raw files to a verified warehouse: check, convert, validate, publish, copy, verify."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.contract import TABLES
from tallyframe.functions.convert import convert
from tallyframe.operators.access import canonical
from tallyframe.operators.quality import compare_reports, quality_report, require_clean, require_types
from tallyframe.session import materialise
from tallyframe.sources.files import fingerprint_changes, fingerprints, list_files
from tallyframe.sources.publish import exists, publish, read_published
from tallyframe.sources.readers import read_json_map, read_strict

REPORT = "quality_report"
FINGERPRINTS = "source_fingerprints"


def source_path(folder: str, name: str) -> str:
    table = TABLES[name]
    return f"{folder.rstrip('/')}/{table.source}.{'json' if table.file_format == 'json_object' else 'csv'}"


def source_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 of every source file, by file name so that copies of a folder compare equal."""
    files = list_files(spark, [source_path(folder, name) for name in TABLES])
    return fingerprints(files).withColumn("path", F.regexp_replace("path", "^.*/", ""))


def read_sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Typed source tables; header drift and lookup problems stop the run before anything is written."""
    raw = {
        name: read_json_map(spark, source_path(folder, name)) if table.file_format == "json_object"
        else read_strict(spark, source_path(folder, name), table)
        for name, table in TABLES.items()
    }
    return {name: convert(df, TABLES[name]) for name, df in raw.items()}


def open_warehouse(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The stored source tables, typed by the contract."""
    return {t.source: read_published(spark, path, t.source, t.source_schema()) for t in TABLES.values()}


def report_of(tables: dict[str, DataFrame]) -> DataFrame:
    by_name = {name: tables[TABLES[name].source] for name in TABLES}
    return quality_report(by_name, {name: canonical(df, TABLES[name]) for name, df in by_name.items()})


def _checked_report(tables: dict[str, DataFrame]) -> DataFrame:
    for table in TABLES.values():
        require_types(tables[table.source], table.source_schema(), table.source)
    types = [(t.source, "view_type", c, kind) for t in TABLES.values()
             for c, kind in canonical(tables[t.source], t).dtypes]
    for table in TABLES.values():
        require_types(canonical(tables[table.source], table), table.canonical_schema(), table.name)
    stated = report_of(tables)
    report = materialise(stated.unionByName(stated.sparkSession.createDataFrame(types, stated.schema)), "quality-report")
    require_clean(report)
    return report


def _stop_on_other_sources(approved: DataFrame | None, found: DataFrame) -> None:
    if approved is not None and fingerprint_changes(approved, found).take(1):
        raise ValueError("The files are not those of the approved fingerprints")


def _stop_on_other_counts(approved: DataFrame | None, report: DataFrame) -> None:
    if approved is not None and row_count_differences(approved, report).take(1):
        raise ValueError("A table does not have its approved row count")


def prepare(
    spark: SparkSession, folder: str, destination: str, *,
    approved_fingerprints: DataFrame | None = None, approved_rows: DataFrame | None = None,
) -> DataFrame:
    """Import a folder of source files; returns the published quality report.

    Given approved fingerprints stop files that differ before anything is written, approved row counts
    (``table_name, row_count``) stop tables that differ before they are published.

    Tables, report and fingerprints appear at the destination together or not at all. Files
    are fingerprinted before and after, so a file changed during the run is noticed.
    """
    if exists(spark, destination):
        raise FileExistsError(f"Destination already exists: {destination}")
    before = materialise(source_fingerprints(spark, folder), "fingerprints")
    _stop_on_other_sources(approved_fingerprints, before)

    def validate(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        report = _checked_report(tables)
        if fingerprint_changes(before, source_fingerprints(spark, folder)).take(1):
            raise ValueError("A source file was changed while it was imported")
        _stop_on_other_counts(approved_rows, report)
        return {REPORT: report, FINGERPRINTS: before}

    sources = read_sources(spark, folder)
    return publish({TABLES[n].source: df for n, df in sources.items()}, destination, validate=validate)[REPORT]


def require_manifest(
    spark: SparkSession, path: str, *, report: DataFrame, approved_fingerprints: DataFrame, approved_rows: DataFrame,
) -> None:
    """Stored evidence must match the approved fingerprints, the data as it is now and the approved row counts.

    ``approved_rows`` is ``(table_name, row_count)``.
    """
    if not exists(spark, f"{path}/{REPORT}"):
        raise ValueError("There is no quality report beside the tables; import them first")
    _stop_on_other_sources(approved_fingerprints, spark.read.parquet(f"{path}/{FINGERPRINTS}"))
    if compare_reports(spark.read.parquet(f"{path}/{REPORT}"), report).take(1):
        raise ValueError("The tables are not those that the stored report describes")
    _stop_on_other_counts(approved_rows, report)


def row_count_differences(approved_rows: DataFrame, report: DataFrame) -> DataFrame:
    counted = report.where(F.col("check_name") == "row_count").select(
        "table_name", F.col("value").cast("long").alias("actual"))
    joined = approved_rows.join(counted, "table_name", "left")
    return joined.where(~F.col("row_count").eqNullSafe(F.col("actual")))


def copy_warehouse(
    spark: SparkSession, source: str, destination: str, *, approved_fingerprints: DataFrame, approved_rows: DataFrame,
) -> DataFrame:
    """Copy a prepared warehouse and prove the copy by reading it back; returns the copy's report."""
    tables = open_warehouse(spark, source)
    expected = _checked_report(tables)
    require_manifest(spark, source, report=expected,
                     approved_fingerprints=approved_fingerprints, approved_rows=approved_rows)
    publish(tables, destination)
    actual = _checked_report(open_warehouse(spark, destination))
    if compare_reports(expected, actual).take(1):
        raise ValueError("The copy does not have the report of its source; it is left in place to be looked at")
    return actual
