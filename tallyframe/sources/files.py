"""Per-file checks that run in tasks: header lines and fingerprints.

The file list comes from Spark, so any number of files is checked in parallel; a file is
streamed in blocks and never held whole in memory.
"""

from __future__ import annotations

import csv
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_BLOCK = 8 * 1024 * 1024


def list_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``(path, length)`` of every file; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length")


def _open(path: str):
    from pyarrow import fs

    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_stream(parts.path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests = []
        for path in batch["path"]:
            digest = hashlib.sha256()
            with _open(path) as stream:
                while block := stream.read(_BLOCK):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield batch.assign(sha256=digests)


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    csv.field_size_limit(2**31 - 1)
    for batch in batches:
        headers = []
        for path in batch["path"]:
            with _open(path) as stream, io.TextIOWrapper(stream, encoding="utf-8-sig", newline="") as text:
                try:
                    headers.append(next(csv.reader(text), []))  # reads on to the end of the first record
                except UnicodeDecodeError:
                    raise ValueError(f"The header is not UTF-8: {path}") from None
        yield pd.DataFrame({"path": batch["path"], "header": headers})


def _one_file_per_row(files: DataFrame) -> DataFrame:
    # files are few and heavy: spread them by path, not by the size of the list
    return files.repartition(F.col("path"))


def fingerprints(files: DataFrame) -> DataFrame:
    """``(path, length, sha256)`` for a file list."""
    return _one_file_per_row(files).mapInPandas(_digests, "path string, length long, sha256 string")


def fingerprint_changes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files added, removed or changed between two fingerprint tables."""
    pair = expected.alias("e").join(actual.alias("a"), F.col("e.path") == F.col("a.path"), "full_outer")
    return pair.where(~F.col("e.sha256").eqNullSafe(F.col("a.sha256"))).select(
        F.coalesce("e.path", "a.path").alias("path"),
        F.col("e.sha256").alias("expected"), F.col("a.sha256").alias("actual"),
    )


def headers(files: DataFrame) -> DataFrame:
    """``(path, header)``: the first record of each file, without a byte-order mark."""
    return _one_file_per_row(files).mapInPandas(_headers, "path string, header array<string>")


def header_drift(files: DataFrame, expected: list[str]) -> DataFrame:
    """Files whose header is not exactly the declared column list, in order."""
    declared = F.array(*[F.lit(name) for name in expected])
    return headers(files).where(~F.col("header").eqNullSafe(declared))


def require_headers(files: DataFrame, expected: list[str]) -> None:
    drifted = header_drift(files, expected).select("path").take(1)
    if drifted:
        raise ValueError(f"Unexpected header in {drifted[0].path}")
