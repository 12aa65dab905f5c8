"""Versioned tables: what readers see before, during and after compactions."""

from __future__ import annotations

import random
import tempfile

import pytest

from tallyframe.streaming.versions import VersionedTable

SCHEMA = "point_id long, text string, n long"


@pytest.fixture
def table(spark):
    path = tempfile.mkdtemp()
    return VersionedTable(spark, path, spark.createDataFrame([], SCHEMA).schema)


def put(table, version, rows, writer="w", finished=True):
    folder = f"{table.path}/version={version}/writer={writer}"
    table.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(folder)
    if not finished:
        table._fs.delete(table._hadoop.Path(f"{folder}/_SUCCESS"), False)


def seen(df):
    return {r["point_id"]: (r["text"], r["n"]) for r in df.collect()}


def test_reads_equal_the_newest_versions_whenever_compacted(spark, table):
    rng, truth = random.Random(1), {}
    versions = rng.sample(range(100), 12)  # later batches may have lower versions
    for step, version in enumerate(versions):
        rows = [(k, f"v{version}", step) for k in rng.sample(range(30), 8)]
        put(table, version, rows)
        for k, text, n in rows:
            if version >= truth.get(k, (-1,))[0]:
                truth[k] = version, (text, n)
        assert seen(table.rows()) == {k: row for k, (_, row) in truth.items()}
        if step % 3 == 2:
            table.compact(files=3)
            assert seen(table.rows()) == {k: row for k, (_, row) in truth.items()}
        if step % 6 == 5:
            table.vacuum()
            assert seen(table.rows()) == {k: row for k, (_, row) in truth.items()}


def test_readers_keep_their_snapshot(spark, table):
    put(table, 1, [(1, "a", 0), (2, "a", 0)])
    before = table.rows()
    table.compact(files=2)
    based = table.rows()
    put(table, 2, [(2, "b", 1), (3, "b", 1)])
    table.compact(files=2)
    put(table, 3, [(1, "c", 2)])
    assert seen(before) == seen(based) == {1: ("a", 0), 2: ("a", 0)}
    assert seen(table.rows()) == {1: ("c", 2), 2: ("b", 1), 3: ("b", 1)}


def test_a_compaction_shows_only_when_it_is_published(spark, table, monkeypatch):
    put(table, 1, [(1, "a", 0)])
    publish, during = table._publish, []

    def watched(manifest):
        put(table, 2, [(1, "b", 1)])  # arrives while the base is written
        during.append((table.manifest().number, seen(table.rows())))
        publish(manifest)

    monkeypatch.setattr(table, "_publish", watched)
    assert table.compact(files=1).folded == ("version=1/writer=w",)
    assert during == [(0, {1: ("b", 1)})]
    assert table.manifest().number == 1 and seen(table.rows()) == {1: ("b", 1)}


def test_a_compaction_that_fails_changes_nothing(spark, table, monkeypatch):
    put(table, 1, [(1, "a", 0)])

    def lost(manifest):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(table, "_publish", lost)
        with pytest.raises(RuntimeError):
            table.compact(files=1)
    assert table.manifest().base is None and seen(table.rows()) == {1: ("a", 0)}
    table.compact(files=1)
    assert "version=1/writer=w" in table.vacuum() and seen(table.rows()) == {1: ("a", 0)}
    assert len(table._names("base")) == 1


def test_of_two_compactions_the_first_published_wins(spark, table):
    put(table, 1, [(1, "a", 0)])
    other = VersionedTable(spark, table.path, table.schema)
    first = table.compact(files=1)
    with pytest.raises(RuntimeError):
        other._publish(first)
    assert table.manifest() == first


def test_unfinished_batches_are_not_read(spark, table):
    put(table, 1, [(1, "a", 0)])
    put(table, 2, [(1, "half", 1)], finished=False)
    assert seen(table.rows()) == {1: ("a", 0)}
    assert table.compact(files=1).folded == ("version=1/writer=w",)


def test_reads_after_a_compaction_cost_live_rows(spark, table):
    for version in range(6):
        put(table, version, [(k, f"v{version}", version) for k in range(10)])
    table.compact(files=2)
    plan = table.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan and table.rows().count() == 10
    assert table.compact() == table.manifest()  # nothing new, nothing written
    assert len(table._names("base")) == 1


def test_an_empty_table(spark, table):
    assert table.rows().collect() == [] and table.compact().base is None and table.vacuum() == []
