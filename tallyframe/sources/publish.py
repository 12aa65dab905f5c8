"""Staged, non-overwriting publication of one or more tables, and verified copies."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


#: the last thing a publication writes
COMMITTED = "_COMMITTED"


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _path(spark, path)
    return system.exists(target)


def publish(
    tables: dict[str, DataFrame], destination: str, *,
    validate: Callable[[dict[str, DataFrame]], dict[str, DataFrame] | None] | None = None,
) -> dict[str, DataFrame]:
    """Write every table below a staging folder, validate what was written, then publish by one rename.

    ``validate`` sees the tables as re-read from staging; it raises to stop, and may return
    evidence tables that are published together with the data.

    Nothing appears at the destination unless all tables were written and validated, and an
    existing destination is refused. A failure removes the staging folder; only a job that is killed leaves it.
    """
    spark = next(iter(tables.values())).sparkSession
    if exists(spark, destination):
        raise FileExistsError(f"Destination already exists: {destination}")
    staging = f"{destination.rstrip('/')}.staging-{uuid.uuid4().hex}"
    def write(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("errorifexists").parquet(f"{staging}/{name}")
        return spark.read.schema(df.schema).parquet(f"{staging}/{name}")

    system, target = _path(spark, destination)
    try:
        written = {name: write(name, df) for name, df in tables.items()}
        if validate:
            written |= {name: write(name, df) for name, df in (validate(dict(written)) or {}).items()}
        nested = _path(spark, f"{destination}/{staging.rsplit('/', 1)[1]}")[1]
        if system.exists(target) or not system.rename(_path(spark, staging)[1], target) or system.exists(nested):
            system.delete(nested, True)  # someone else's destination appeared meanwhile, and the rename went into it
            raise FileExistsError(f"Destination could not be published: {destination}")
    except BaseException:
        system.delete(_path(spark, staging)[1], True)
        raise
    # where a rename is no single step, readers must not see half of it: they require this mark
    system.create(_path(spark, f"{destination}/{COMMITTED}")[1], True).close()
    return {name: read_published(spark, destination, name, df.schema) for name, df in written.items()}


def read_published(spark: SparkSession, destination: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A table of a published destination; one whose publication did not end is refused."""
    if not exists(spark, f"{destination}/{COMMITTED}"):
        raise FileNotFoundError(f"Nothing was published at {destination}")
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{destination}/{name}")


#: row hashes are compared in this many groups before rows are
_BUCKETS = 4096


def _hashed(column: Column, dtype: T.DataType) -> list[Column]:
    if isinstance(dtype, (T.IntegralType, T.StringType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return [column, column.isNull()]
    return [F.to_json(F.struct(column))]


def copy_differences(source: DataFrame, copy: DataFrame) -> DataFrame:
    """``(side, rows)``: rows of either side that the other lacks, multiplicity included.

    Counts, sums and parities of row hashes are compared per group of hashes first, which moves a few
    numbers per task; only rows of groups that differ are shuffled and compared by their content. Both
    sides are read once where no group differs. At most one number per group reaches the driver.
    """
    columns = source.columns
    # a null leaves a hash as it is, so where nulls are is part of it; nested values are hashed as text
    row = F.xxhash64(*[part for f in source.schema.fields for part in _hashed(F.col(f"`{f.name}`"), f.dataType)])
    bucket = F.pmod(row, F.lit(_BUCKETS))

    def summed(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(bucket.alias("_bucket")).agg(F.struct(
            F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).alias(side))

    differing = summed(source, "_a").join(summed(copy, "_b"), "_bucket", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("_bucket")
    found = [r["_bucket"] for r in differing.collect()]
    if not found:
        return source.sparkSession.range(1).select(F.lit(0).cast("long").alias("missing_in_copy"), F.lit(0).cast("long").alias("extra_in_copy"))
    source, copy = (df.where(bucket.isin(found)) for df in (source, copy))
    both = source.select(*columns, F.lit(1).alias("_n")).unionByName(copy.select(*columns, F.lit(-1).alias("_n")))
    balance = both.groupBy(*columns).agg(F.sum("_n").alias("balance"))
    return balance.agg(
        F.coalesce(F.sum(F.when(F.col("balance") > 0, F.col("balance"))), F.lit(0)).alias("missing_in_copy"),
        F.coalesce(F.sum(F.when(F.col("balance") < 0, -F.col("balance"))), F.lit(0)).alias("extra_in_copy"),
    )


def _json_safe(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DecimalType):
        return column.cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        seconds = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.when(micros.endswith(".000000"), seconds).otherwise(micros)
    if isinstance(dtype, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda item: _json_safe(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(column), lambda entry: F.struct(
            entry["key"].cast("string").alias("key"), _json_safe(entry["value"], dtype.valueType).alias("value"))))
    if isinstance(dtype, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[
            _json_safe(column[f.name], f.dataType).alias(f.name) for f in dtype.fields]))
    return column


def json_safe(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as ISO text, nested values kept in shape."""
    return df.select([_json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def json_rows(df: DataFrame, name: str = "row") -> DataFrame:
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in safe.columns]), {"ignoreNullFields": "false"}).alias(name))


def write_report(report: DataFrame, path: str) -> None:
    """Report rows as JSON lines; an existing report is not replaced."""
    json_safe(report).write.mode("errorifexists").json(path)
