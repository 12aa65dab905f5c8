"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    columns, rows = spark_rows(QUERIES[name](spark, FOLDER))
    if name in ORACLES:
        assert (columns, rows) == duck_rows(duck, ORACLES[name])
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() == 100


def test_star_join_holds_no_map_of_nearly_unique_keys(spark):
    """Such a map grows with a task's rows; what is combined are codes and segments."""
    plan = QUERIES["join_star_inner"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    groups = [line.split("Aggregate [", 1)[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert groups and not any("card_id" in g or "client_id" in g for g in groups)
