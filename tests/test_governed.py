"""Governed questions: what is refused, and that combined totals equal those of joined rows."""

from __future__ import annotations

import itertools
from dataclasses import replace

import pytest

from tallyframe.contract import TABLES
from tallyframe.operators.access import AccessDenied
from tallyframe.operators.governed import (
    All, Any, Arith, Call, Case, Cast, Col, Compare, Extract, Governed, Having, In, IsNull, Join, Lit, Not, Question, Trunc, relations_used)
from tallyframe.plans import governed as plans

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
ROWS = Call("COUNT")


@pytest.fixture(scope="module")
def star(spark):
    return plans.relations(spark, FOLDER)


@pytest.fixture(scope="module")
def empty(spark):
    """The whole contract's exposed columns, without rows."""
    return Governed({name: spark.createDataFrame([], table.canonical_schema()) for name, table in TABLES.items()})


@pytest.mark.parametrize("name", list(plans.REVIEWED))
def test_reviewed_questions_equal_their_queries(spark, star, name):
    found, query = star.answer(plans.REVIEWED[name]), entry.queries()[name](spark, FOLDER)
    assert dict(found.dtypes) == dict(query.dtypes)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in query.select(*found.columns).collect()]


def cards(*select, **more) -> Question:
    return Question(**{"relation": "main.cards", "alias": "c", "select": select or (("x", Col("c.card_brand")),)} | more)


PRIVATE = [c for t in TABLES.values() for c in t.restricted]
REFUSED = {
    "another schema": cards(relation="source.cards"),
    "no schema": cards(relation="cards"),
    "a catalogue": cards(relation="other.main.cards"),
    "an unknown relation": cards(relation="main.payments"),
    "a wildcard": cards(("x", Col("*"))),
    "a qualified wildcard": cards(("x", Col("c.*"))),
    "another alias": cards(("x", Col("d.card_brand"))),
    "a qualified name in other letters": cards(("x", Col("c.CARD_BRAND"))),
    "a private column in a filter": cards(where=Compare(Col("cvv"), "=", Lit("1"))),
    "a private column in a total": cards(("x", Call("MAX", (Col("c.card_number"),)))),
    "a private column in a group": cards(("n", ROWS), group=(Col("expires"),)),
    "a private column in a case": cards(("x", Case(((Compare(Col("cvv"), "=", Lit(1)), Lit(1)),)))),
    "an order by what is not selected": cards(order=(("cvv", False),)),
    "a function": cards(("x", Call("READ_TEXT", (Lit("/etc/passwd"),)))),
    "a nested function": cards(("x", Call("UPPER", (Call("GETENV", (Lit("HOME"),)),)))),
    "a total in a filter": cards(where=Compare(ROWS, ">", Lit(1))),
    "a total in a total": cards(("x", Call("SUM", (Call("COUNT", (Col("c.card_id"),)),)))),
    "a total without an argument": cards(("x", Call("SUM"))),
    "a distinct sum": cards(("x", Call("SUM", (Col("c.credit_limit"),), distinct=True))),
    "groups kept without groups": cards(having=Compare(ROWS, ">", Lit(1))),
    "no rows": cards(limit=0),
    "too many rows": cards(limit=101),
    "a yes for a number of rows": cards(limit=True),
    "nothing selected": Question("main.cards", "c", ()),
    "one name twice": cards(("x", Col("c.card_id")), ("X", Col("c.client_id"))),
    "a name that is text": cards(("1; drop", Col("c.card_id"))),
    "a type": cards(("x", Cast(Col("c.card_id"), "binary"))),
    "a part of a time": cards(("x", Extract("epoch", Col("c.account_open_month")))),
    "a unit of a time": cards(("x", Trunc("decade", Col("c.account_open_month")))),
    "an unknown path": cards(joins=(Join("card_merchant", "m", "c"),)),
    "a path from elsewhere": cards(joins=(Join("transaction_category", "m", "c"),)),
    "a path from no alias": cards(joins=(Join("card_customer", "u", "x"),)),
    "a crossed join": cards(joins=(Join("card_customer", "u", "c", "cross"),)),
    "an alias twice": cards(joins=(Join("card_customer", "c", "c"),)),
    "a column of two relations": cards(("x", Col("client_id")), joins=(Join("card_customer", "u", "c"),)),
    "existence along a path that ends elsewhere": cards(exists=(Having("transaction_customer", "t", "c"),)),
    "existence with a private column": Question(
        "main.users", "u", (("n", ROWS),), exists=(Having("card_customer", "c", "u", Compare(Col("c.cvv"), "=", Lit("1"))),)),
    "a private column of an inner question": cards(("x", Col("cvv")), relation=cards(("y", Col("c.card_id")))),
    "an inner question outside": cards(("x", Col("y")), relation=cards(("y", Col("cvv")))),
    "types that do not fit": cards(("x", Call("SUM", (Col("c.has_chip"),)))),
    "an unknown comparison": cards(where=Compare(Col("c.card_brand"), "~", Lit("V"))),
    "an unknown operation": cards(("x", Arith(Col("c.card_id"), "^", Lit(2)))),
    "options of no kind": cards(where=In(Col("c.card_brand"), (object(),))),
    "no options": cards(where=In(Col("c.card_brand"), ())),
    "a value of no kind": cards(("x", Lit(b"x"))),
}


@pytest.mark.parametrize("name", list(REFUSED))
def test_refusals(empty, name):
    with pytest.raises(AccessDenied):
        empty.answer(REFUSED[name])


@pytest.mark.parametrize("column", PRIVATE)
def test_private_columns_cannot_be_asked_for(empty, column):
    for table in TABLES.values():
        for written in (column, f"q.{column}"):
            if column in table.restricted:
                with pytest.raises(AccessDenied) as refused:
                    empty.answer(Question(f"main.{table.name}", "q", (("x", Col(written)),)))
                assert column not in str(refused.value)


def test_deep_questions_are_refused(empty):
    node = Col("c.card_id")
    for _ in range(200):
        node = Arith(node, "+", Lit(1))
    with pytest.raises(AccessDenied):
        empty.answer(cards(("x", node)))


def test_bounds(star):
    unbounded = Question("main.transactions", "t", (("mcc", Col("mcc")),))
    assert star.answer(unbounded).count() == 100
    assert star.answer(replace(unbounded, limit=7)).count() == 7
    totals = star.answer(Question("main.transactions", "t", (("n", ROWS),)))
    assert totals.count() == 1 and "Limit" not in totals._jdf.queryExecution().optimizedPlan().toString()


def test_totals_of_nothing(empty):
    found = empty.answer(cards(("n", ROWS), ("s", Call("SUM", (Col("credit_limit"),))), ("a", Call("AVG", (Col("credit_limit"),)))))
    assert [tuple(r) for r in found.collect()] == [(0, None, None)]
    joined = empty.answer(cards(("n", ROWS), ("a", Call("AVG", (Col("credit_limit"),))), joins=(Join("card_customer", "u", "c"),)))
    assert [tuple(r) for r in joined.collect()] == [(0, None)]


def test_relations_used():
    inner = Question("main.transactions", "t", (("n", ROWS),), joins=(Join("transaction_category", "m", "t"),))
    assert relations_used(inner) == ("main.transactions", "main.mcc_codes")
    outer = Question(inner, "x", (("n", Col("n")),))
    assert relations_used(outer) == ("main.transactions", "main.mcc_codes")
    assert relations_used(Question("main.users", "u", (("n", ROWS),), exists=(Having("card_customer", "c", "u"),))) == ("main.users", "main.cards")


def _small(spark):
    """Repeated and missing keys, nulls and amounts on both sides of zero."""
    facts = [(i, i % 5 if i % 7 else None, i % 3, None if i % 11 == 0 else float(i - 20), "ab"[i % 2]) for i in range(60)]
    people = [(0, "x"), (1, "y"), (1, "z"), (2, None), (None, "w")]
    codes = [("a", "alpha")]
    return Governed({
        "transactions": spark.createDataFrame(facts, "transaction_id long, client_id long, card_id long, amount double, mcc string"),
        "users": spark.createDataFrame(people, "client_id long, gender string"), "mcc_codes": spark.createDataFrame(codes, "mcc string, description string")})


def test_combined_totals_equal_totals_of_joined_rows(spark, monkeypatch):
    """Also where the far side repeats a key, and for each kind of join and total."""
    small, amount = _small(spark), Col("t.amount")
    totals = (("n", ROWS), ("s", Call("COALESCE", (Call("SUM", (amount,)), Lit(0.0)))), ("a", Call("AVG", (amount,))), ("lo", Call("MIN", (amount,))),
              ("hi", Call("MAX", (amount,))), ("c", Call("COUNT", (amount,))))
    keys = {"gender": Col("u.gender"), "what": Col("m.description"), "mcc": Col("t.mcc"), "big": Compare(Col("t.amount"), ">", Lit(0.0))}
    for first, second, chosen in itertools.product(("left", "inner"), ("left", "inner"), ((), ("gender",), ("what", "mcc"), ("gender", "big"))):
        asked = Question(
            "main.transactions", "t", (*((k, keys[k]) for k in chosen), *totals),
            joins=(Join("transaction_customer", "u", "t", first), Join("transaction_category", "m", "t", second)),
            where=Any((IsNull(amount), Not(Compare(amount, "=", Lit(3.0))))), having=Compare(ROWS, ">", Lit(1)) if chosen else None)
        combined = sorted(map(str, small.answer(asked).collect()))
        with monkeypatch.context() as patch:
            patch.setattr(Governed, "_combines", lambda *_: False)
            assert combined == sorted(map(str, small.answer(asked).collect()))


def test_distinct_counts_are_not_combined(spark):
    small = _small(spark)
    asked = Question("main.transactions", "t", (("g", Col("u.gender")), ("d", Call("COUNT", (Col("t.mcc"),), distinct=True))), joins=(Join("transaction_customer", "u", "t"),))
    assert {r["g"]: r["d"] for r in small.answer(asked).collect()}[None] == 2


def test_facts_are_grouped_before_the_join(star):
    plan = star.answer(plans.REVIEWED["category_positive_amount"])._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("t__mcc")
    assert "Aggregate" in plan[plan.index("Join LeftOuter"):] and join
