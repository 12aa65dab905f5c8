"""The quality report of a growing snapshot, refreshed from changed files only.

Every file leaves a state that merges with others: counts, extremes, sums and signatures in one row, its keys as a
sorted run, and for facts how many rows each pair of client and card and each category has. States are kept under a
stamp of the file's path, size and time, so a refresh lists files, reads those with an unknown stamp, and
merges the states of the files that are there now; what was removed or replaced is left out by its stamp.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tallyframe.contract import TABLES, Table
from tallyframe.operators import quality
from tallyframe.session import compiled_in_parts

#: what a stamp is made of
_PARTS = ("file_path", "file_size", "file_modification_time")


def _stamp() -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(f"_metadata.{p}").cast("string") for p in _PARTS]), 256)


def _merged(check: str, column: str) -> Column:
    """How a check's values of several files become one."""
    if check.startswith("first_"):
        return F.min(column)
    if check.startswith("last_"):
        return F.max(column)
    if check == "signature":
        return F.coalesce(F.bit_xor(column), F.lit(0))
    counted = check.endswith("_count") or check in ("row_count", "null_keys")
    return F.coalesce(F.sum(column), F.lit(0)) if counted else F.sum(column).cast("decimal(38,2)")


@dataclass
class Refresh:
    """What a refresh found: files that are there, files that it read, and key runs that had to be merged."""

    files: dict[str, int] = field(default_factory=dict)
    read: dict[str, list[str]] = field(default_factory=dict)
    merged_runs: dict[str, int] = field(default_factory=dict)


class ReportStore:
    """States of files below ``path``; one refresh at a time writes to it, readers of earlier reports are not disturbed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- stored states

    def _read(self, kind: str, table: Table, schema: T.StructType) -> DataFrame:
        """Nothing is stored before the first refresh; an empty folder reads as no rows."""
        return self.spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(self._folder(kind, table))

    def _folder(self, kind: str, table: Table) -> str:
        return f"{self.path}/{kind}/{table.name}"

    def _write(self, rows: DataFrame, kind: str, table: Table) -> None:
        """A refresh that failed half way is written over, stamp by stamp."""
        with compiled_in_parts(self.spark):  # the checks of a table are one wide aggregate
            rows.write.partitionBy("stamp").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self._folder(kind, table))

    def _schemas(self, table: Table) -> dict[str, T.StructType]:
        empty = self.spark.createDataFrame([], table.source_schema())
        key, stamp = table.source_schema()[table.key].dataType, T.StructField("stamp", T.StringType())
        states = empty.agg(*[v.alias(f"c{i}") for i, v in enumerate(quality.table_checks(table).values())]).schema
        runs = [T.StructField("key", key)]
        out = {"states": T.StructType([*states.fields, T.StructField("keys", T.LongType()), T.StructField("low", key), T.StructField("high", key), stamp]),
               "keys": T.StructType([*runs, stamp])}
        if table.name == "transactions":
            n = T.StructField("n", T.LongType())
            raw = {c.canonical: c for c in table.exposed}
            out["pairs"] = T.StructType([*(T.StructField(c, raw[c].spark_type) for c in ("client_id", "card_id")), n, stamp])
            out["categories"] = T.StructType([T.StructField("mcc", raw["mcc"].spark_type), n, stamp])
        return out

    def _ready(self, schemas: dict[str, T.StructType], table: Table) -> None:
        """Folders exist from the first refresh on."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        for kind in schemas:
            folder = fs.Path(self._folder(kind, table))
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)

    # ---- refreshing

    def _listed(self, folder: str) -> DataFrame:
        """(stamp, file) of the files of a table; only their names and sizes are looked at."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
        return files.select(_stamp().alias("stamp"), F.col("_metadata.file_path").alias("file"))

    def _absorb(self, files: list[str], table: Table, schemas: dict[str, T.StructType]) -> None:
        """Store the states of files that are not known yet, the row that vouches for them last."""
        rows = self.spark.read.schema(table.source_schema()).parquet(*files).select("*", _stamp().alias("stamp"))
        if table.name == "transactions":
            raw = {c.canonical: F.col(c.raw).alias(c.canonical) for c in table.exposed}
            for kind, by in (("pairs", ("client_id", "card_id")), ("categories", ("mcc",))):
                self._write(rows.groupBy("stamp", *[raw[c] for c in by]).agg(F.count(F.lit(1)).alias("n")), kind, table)
        key = F.col(table.key).alias("key")
        keys = rows.where(F.col(table.key).isNotNull()).select("stamp", key).distinct()
        self._write(keys.repartitionByRange("stamp", "key").sortWithinPartitions("stamp", "key"), "keys", table)
        runs = self._read("keys", table, schemas["keys"]).groupBy("stamp").agg(
            F.count(F.lit(1)).alias("keys"), F.min("key").alias("low"), F.max("key").alias("high"))
        checks = [value.alias(f"c{i}") for i, value in enumerate(quality.table_checks(table).values())]
        counted = rows.groupBy("stamp").agg(*checks).join(runs, "stamp", "left").withColumn("keys", F.coalesce("keys", F.lit(0)))
        self._write(counted, "states", table)

    def _distinct_keys(self, live: DataFrame, table: Table, schemas: dict[str, T.StructType], found: Refresh) -> DataFrame:
        """Keys of runs that overlap no other are counted already; only the others are read and merged."""
        order = Window.orderBy("low", "high", "stamp")  # one row per file
        runs = live.where("keys > 0").select("stamp", "keys", "low", "high")
        before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
        marked = runs.withColumn("_apart", F.coalesce(before < F.col("low"), F.lit(True)) & F.coalesce(F.lead("low").over(order) > F.col("high"), F.lit(True)))
        rows = marked.collect()
        meeting = [r["stamp"] for r in rows if not r["_apart"]]
        found.merged_runs[table.name] = len(meeting)
        apart = sum(r["keys"] for r in rows if r["_apart"])
        if not meeting:
            return self.spark.range(1).select(F.lit(apart).cast("long").alias("distinct_keys"))
        read = self._read("keys", table, schemas["keys"]).where(F.col("stamp").isin(meeting))
        return read.agg((F.count_distinct("key") + F.lit(apart)).alias("distinct_keys"))

    def refresh(self, folders: dict[str, str]) -> tuple[DataFrame, Refresh]:
        """The report that ``quality.quality_report`` gives for the tables in these folders, and what was read for it.

        ``folders`` has the folder of every table of the contract, with typed files in source layout. A table without
        files, or with empty ones, is reported as empty.
        """
        found, parts, live, schemas = Refresh(), [], {}, {}
        for name, table in TABLES.items():
            schemas[name] = self._schemas(table)
            self._ready(schemas[name], table)
            listed = self._listed(folders[name])
            known = self._read("states", table, schemas[name]["states"]).select("stamp").distinct()
            fresh = sorted(r["file"] for r in listed.join(known, "stamp", "left_anti").select("file").collect())
            found.read[name], found.files[name] = fresh, listed.count()
            if fresh:
                self._absorb(fresh, table, schemas[name])
            live[name] = listed.select("stamp")
            states = self._read("states", table, schemas[name]["states"]).join(live[name], "stamp", "left_semi")
            merged = states.agg(*[_merged(check, f"c{i}").alias(f"c{i}") for i, (check, _) in enumerate(quality.table_checks(table))])
            parts.append(quality.check_rows(merged, table))
            parts.append(quality.as_report(self._distinct_keys(states, table, schemas[name], found), table.source))

        def runs(kind: str, *by: str) -> DataFrame:
            table = TABLES["transactions"]
            stored = self._read(kind, table, schemas["transactions"][kind]).join(live["transactions"], "stamp", "left_semi")
            return stored.groupBy(*by).agg(F.sum("n").alias("n"))

        def keys(name: str, *columns: str) -> DataFrame:
            table = TABLES[name]
            raw = {c.canonical: c.raw for c in table.exposed}
            read = self.spark.read.schema(table.source_schema()).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folders[name])
            return read.select(*[F.col(raw[c]).alias(c) for c in columns])

        counters = quality.relationship_counts(
            runs("pairs", "client_id", "card_id"), runs("categories", "mcc"), keys("cards", "card_id", "client_id"),
            keys("users", "client_id"), keys("mcc_codes", "mcc"))
        parts.append(quality.as_report(counters, "relationships"))
        return reduce(DataFrame.unionByName, parts), found
