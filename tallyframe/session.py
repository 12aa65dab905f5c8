"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # recording the call site of every expression costs more than building it
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
_local_dirs: dict[str, str] = {}


def build_session(master: str | None = None, app_name: str = "tallyframe", **settings: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, ANSI, adaptive execution)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def compiled_in_parts(spark: SparkSession) -> Iterator[None]:
    """For jobs over wide rows that run inside: one method for a whole stage is too long for the JVM to compile it, so it
    would be interpreted; with this limit Spark makes a method per part instead."""
    key, least = "spark.sql.codegen.hugeMethodLimit", 8000
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), least)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """For jobs that are each run once and keep their rows in a table: the files of a job's shuffles go when it ends,
    instead of staying on the executors' disks until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a missing
    setting is an error, because a machine-local path is not visible to other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tallyframe-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_local_dirs[app])
    return _local_dirs[app]


def fresh_path(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that no earlier call has used."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage through a table in the shared folder, so a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = fresh_path(spark, purpose)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the table of a materialised frame that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    shared = hadoop.Path(shared_folder(spark))
    system = shared.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in {hadoop.Path(f).getParent().toString() for f in df.inputFiles()}:
        path = hadoop.Path(folder)
        if system.makeQualified(path.getParent()).equals(system.makeQualified(shared)):
            system.delete(path, True)
