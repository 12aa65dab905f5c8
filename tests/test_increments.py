"""Refreshed reports against full ones after files come, change and go."""

from __future__ import annotations

import random
import shutil
import tempfile
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from tallyframe.contract import TABLES
from tallyframe.operators import access, quality
from tallyframe.operators.increments import ReportStore

VALUES = {
    "bigint": lambda r: r.randrange(40), "integer": lambda r: r.randrange(9), "digits": lambda r: r.randrange(13), "money": lambda r: Decimal(r.randrange(-999, 999)) / 100,
    "flag": lambda r: r.random() < 0.5, "timestamp": lambda r: datetime(2020, 1, 1) + timedelta(hours=r.randrange(999)), "month": lambda r: date(2020, r.randrange(1, 13), 1),
    "text": lambda r: r.choice(["a", "b", "c,d"]), "postal": lambda r: "02139", "double": lambda r: r.random(), "verbatim": lambda r: f"{r.randrange(20):04}"}


def rows_of(name, seed, n, first=None):
    """Random rows; ids run from ``first`` on, or repeat and miss at random."""
    rng, table = random.Random(f"{name}{seed}"), TABLES[name]
    out = []
    for i in range(n):
        row = [None if rng.random() < 0.1 else VALUES[c.kind](rng) for c in table.columns]
        if first is not None:
            row[[c.raw for c in table.columns].index(table.key)] = f"{first + i:04}" if name == "mcc_codes" else first + i
        out.append(tuple(row))
    return out


class Snapshot:
    def __init__(self, spark):
        self.spark, self.root = spark, tempfile.mkdtemp()
        self.folders = {name: f"{self.root}/{name}" for name in TABLES}

    def put(self, name, part, rows):
        self.spark.createDataFrame(rows, TABLES[name].source_schema()).coalesce(1).write.mode("overwrite").parquet(f"{self.folders[name]}/{part}")

    def drop(self, name, part):
        shutil.rmtree(f"{self.folders[name]}/{part}")

    def full(self):
        read = {n: self.spark.read.schema(t.source_schema()).option("recursiveFileLookup", "true").parquet(self.folders[n]) for n, t in TABLES.items()}
        canonical = {n: access.canonical(df, TABLES[n]) for n, df in read.items()}
        return listed(quality.quality_report(read, canonical))


def listed(report):
    return sorted(tuple(r) for r in report.select("table_name", "check_name", "column_name", "value").collect())


@pytest.fixture
def snapshot(spark):
    out = Snapshot(spark)
    for name in TABLES:
        out.put(name, "a", rows_of(name, 1, 60))
        out.put(name, "b", rows_of(name, 2, 30))
    return out


def test_refreshes_equal_full_reports(spark, snapshot):
    store = ReportStore(spark, tempfile.mkdtemp() + "/states")
    report, found = store.refresh(snapshot.folders)
    assert listed(report) == snapshot.full()
    assert all(len(f) == 2 for f in found.read.values())

    report, found = store.refresh(snapshot.folders)
    assert listed(report) == snapshot.full() and not any(found.read.values())

    snapshot.put("transactions", "c", rows_of("transactions", 3, 25))  # comes
    snapshot.put("cards", "b", rows_of("cards", 4, 31))  # changes
    snapshot.drop("users", "a")  # goes
    snapshot.put("mcc_codes", "b", [])  # is emptied
    report, found = store.refresh(snapshot.folders)
    assert listed(report) == snapshot.full()
    assert {n: len(f) for n, f in found.read.items()} == {"transactions": 1, "cards": 1, "users": 0, "mcc_codes": 1}
    assert all(f"/{part}/" in found.read[n][0] for n, part in (("transactions", "c"), ("cards", "b")))

    # another store over the same states knows what this one read
    report, found = ReportStore(spark, store.path).refresh(snapshot.folders)
    assert listed(report) == snapshot.full() and not found.read["transactions"]


def test_only_overlapping_key_runs_are_merged(spark, snapshot):
    for part, first in (("a", 0), ("b", 1000), ("c", 2000)):
        snapshot.put("transactions", part, rows_of("transactions", part, 40, first))
    store = ReportStore(spark, tempfile.mkdtemp() + "/states")
    report, found = store.refresh(snapshot.folders)
    assert listed(report) == snapshot.full() and found.merged_runs["transactions"] == 0
    snapshot.put("transactions", "d", rows_of("transactions", "d", 40, 1020))  # repeats twenty keys of b
    report, found = store.refresh(snapshot.folders)
    assert listed(report) == snapshot.full() and found.merged_runs["transactions"] == 2
    assert quality.report_failures(report).where("table_name = 'transactions_data'").count() == 1


def test_a_refresh_that_failed_half_way_is_repeated(spark, snapshot, monkeypatch):
    store = ReportStore(spark, tempfile.mkdtemp() + "/states")
    write = store._write

    def failing(rows, kind, table):
        if kind == "states":
            raise RuntimeError("lost")
        write(rows, kind, table)

    monkeypatch.setattr(store, "_write", failing)
    with pytest.raises(RuntimeError):
        store.refresh(snapshot.folders)
    report, _ = ReportStore(spark, store.path).refresh(snapshot.folders)
    assert listed(report) == snapshot.full()


def test_states_are_written_by_methods_the_jvm_compiles(spark, snapshot, monkeypatch):
    """The wide aggregate of a table is not one method of a stage, and the session's own limit is back afterwards."""
    store, key, seen = ReportStore(spark, tempfile.mkdtemp() + "/states"), "spark.sql.codegen.hugeMethodLimit", []
    folder, before = store._folder, spark.conf.get(key)
    monkeypatch.setattr(store, "_folder", lambda kind, table: seen.append((kind, spark.conf.get(key))) or folder(kind, table))
    report, _ = store.refresh(snapshot.folders)
    assert ("states", "8000") in seen and spark.conf.get(key) == before
    assert listed(report) == snapshot.full()
