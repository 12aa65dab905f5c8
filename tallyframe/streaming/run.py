"""Starting streams and reading what they wrote."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.session import fresh_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def stream_settings(spark: SparkSession, settings: dict[str, str]):
    """Settings for streams started inside the block; restored afterwards."""
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def run_to_end(
    files: str, stream: DataFrame, time: str, marker: dict, *, path: str | None = None, checkpoint: str | None = None,
) -> DataFrame:
    """Process a finite folder of files to its very end and return the output.

    What waits for the watermark after the last file is released by a marker row that is written into the
    folder with a time far behind the newest one, and read by the same stream. ``marker`` gives the row's
    other columns; choose keys that no real row has, because its own state is never closed.
    """
    spark = stream.sparkSession
    path, checkpoint = path or fresh_path(spark, "stream-output"), checkpoint or fresh_path(spark, "stream-checkpoint")
    run_available(stream, path, checkpoint)
    rows = spark.read.parquet(files)
    last = rows.agg((F.max(time) + F.expr("interval 400 days")).alias("t"))
    last.select(*[(F.col("t") if c == time else F.lit(marker.get(c))).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]).where(
        F.col(time).isNotNull()).write.mode("append").parquet(files)
    return run_available(stream, path, checkpoint)


def run_available(
    stream: DataFrame, path: str | None = None, checkpoint: str | None = None, *, advance_watermark: bool = True,
) -> DataFrame:
    """Process everything available, append the output as Parquet and return it.

    Keyed state lives on executor disks. A last empty batch lets the watermark catch up with
    the input; a stream with processing-time state must turn that off, as it would never end.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, "stream-output")
    checkpoint = checkpoint or fresh_path(spark, "stream-checkpoint")
    with stream_settings(spark, {_PROVIDER: _ROCKSDB, _EMPTY_BATCHES: str(advance_watermark).lower()}):
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
