"""The rules that any rebuild must keep, on random tables, against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyframe.contract import TABLES
from tallyframe.functions import convert as cv
from tallyframe.operators import access, joins, metrics, quality

LABELS = [None, "A", "B", "A,B", "B,A", "A,A"]


def facts_of(seed: int, n: int = 400) -> list[dict]:
    rng = random.Random(seed)
    return [{
        "transaction_id": i, "transaction_at": datetime(2021, 1, 1) + timedelta(hours=rng.randrange(24 * 90)),
        "client_id": rng.choice([None, *range(9)]), "card_id": rng.choice([None, *range(14)]),
        "amount": rng.choice([None, Decimal(0), Decimal(rng.randrange(-99999, 99999)) / 100]),
        "mcc": rng.choice(["01", "02", "03", None]), "errors": rng.choice(LABELS)} for i in range(n)]


FACTS = facts_of(1)
OWNERS = {c: (None if c == 3 else c % 7) for c in range(11)}
INCOMES = {u: (None if u == 2 else Decimal(1000 * u) + Decimal("0.50")) for u in range(6)}
NAMES = {"01": "one", "03": "three"}


@pytest.fixture(scope="module")
def tables(spark):
    schema = "transaction_id long, transaction_at timestamp_ntz, client_id long, card_id long, amount decimal(18,2), mcc string, errors string"
    return {
        "transactions": spark.createDataFrame([tuple(f.values()) for f in FACTS], schema).repartition(4),
        "cards": spark.createDataFrame(list(OWNERS.items()), "card_id long, client_id long"),
        "users": spark.createDataFrame(list(INCOMES.items()), "client_id long, yearly_income decimal(18,2)"),
        "mcc_codes": spark.createDataFrame(list(NAMES.items()), "mcc string, description string")}


def expected_metrics(facts: list[dict]) -> dict:
    amounts = [f["amount"] for f in facts if f["amount"] is not None]
    gains, n, errors = [a for a in amounts if a > 0], len(facts), sum(f["errors"] is not None for f in facts)
    return {
        "transaction_count": n, "positive_amount_total": sum(gains, Decimal(0)), "net_amount": sum(amounts, Decimal(0)),
        "negative_amount_magnitude": -sum((a for a in amounts if a < 0), Decimal(0)),
        "average_positive_amount": float(sum(gains)) / len(gains) if gains else None,
        "negative_transaction_count": sum(a < 0 for a in amounts), "error_recorded_count": errors,
        "error_recorded_rate": errors / n if n else None,
        "transacting_customer_count": len({f["client_id"] for f in facts} - {None})}


def test_metrics_at_every_grain(tables):
    """Distinct customers are counted anew in each group, so they do not add up; rows with errors stay in."""
    names = list(metrics.METRICS)
    for grain in ([], ["mcc"], ["client_id", "mcc"], ["card_id"]):
        groups = defaultdict(list)
        for f in FACTS:
            groups[tuple(f[g] for g in grain)].append(f)
        found = {tuple(r[g] for g in grain): {m: r[m] for m in names} for r in metrics.metrics_by(tables["transactions"], names, grain).collect()}
        assert found == {g: expected_metrics(rows) for g, rows in groups.items()}


def test_nothing_to_count_is_zero_and_nothing_to_average_is_null(tables):
    row = metrics.metrics(tables["transactions"].where("transaction_id < 0"), list(metrics.METRICS)).first().asDict()
    assert row == expected_metrics([])


def test_periods_exclude_their_end(tables):
    day = datetime(2021, 1, 20)
    inside = tables["transactions"].where(
        (F.col("transaction_at") >= F.lit(day).cast("timestamp_ntz")) & (F.col("transaction_at") < F.lit(day + timedelta(days=9)).cast("timestamp_ntz")))
    assert inside.count() == sum(day <= f["transaction_at"] < day + timedelta(days=9) for f in FACTS)


def test_months_begin_on_their_first_day(tables):
    found = metrics.metrics_by(tables["transactions"], ["transaction_count"], [metrics.month("transaction_at").alias("m")]).collect()
    assert {r["m"]: r["transaction_count"] for r in found} == Counter(date(f["transaction_at"].year, f["transaction_at"].month, 1) for f in FACTS)


def test_a_card_is_reached_by_card_and_owner_but_judged_by_card_alone(tables):
    joined = joins.enrich(tables["transactions"], tables["cards"].withColumn("known", F.lit(1)), "transaction_card", ["known"])
    assert joined.count() == len(FACTS)
    matched = [f for f in FACTS if f["card_id"] in OWNERS and f["client_id"] is not None and OWNERS[f["card_id"]] == f["client_id"]]
    assert joined.where("known = 1").count() == len(matched)
    foreign = [f for f in FACTS if f["card_id"] in OWNERS and OWNERS[f["card_id"]] != f["client_id"]]
    assert joins.owner_mismatches(tables["transactions"], tables["cards"]).agg(F.sum("fact_rows")).first()[0] == len(foreign)


def test_reference_counters(tables):
    row = quality.relationship_report(*[tables[t] for t in TABLES]).first().asDict()
    assert row == {
        "transactions_without_users": sum(f["client_id"] not in INCOMES for f in FACTS),
        "transactions_without_cards": sum(f["card_id"] not in OWNERS for f in FACTS),
        "transaction_card_owner_mismatches": sum(f["card_id"] in OWNERS and OWNERS[f["card_id"]] != f["client_id"] for f in FACTS),
        "transactions_without_mcc_descriptions": sum(f["mcc"] not in NAMES for f in FACTS),
        "cards_without_users": sum(o not in INCOMES for o in OWNERS.values())}


def test_unknown_groups_are_kept_by_a_left_path_and_dropped_by_an_inner_one(tables):
    totals = Counter()
    for f in FACTS:
        totals[NAMES.get(f["mcc"])] += f["amount"] or 0
    for how in ("left", "inner"):
        found = joins.related_totals(tables["transactions"], tables["mcc_codes"], ["mcc"], [F.col("description")], {"total": F.col("amount")}, how)
        assert {r["description"]: r["total"] for r in found.collect()} == {k: v for k, v in totals.items() if k or how == "left"}


def test_a_customer_counts_once_however_active(tables):
    active = {f["client_id"] for f in FACTS} & set(INCOMES)
    incomes = [INCOMES[u] for u in active if INCOMES[u] is not None]
    found = joins.with_activity(tables["users"], tables["transactions"], "client_id").agg(metrics.average(F.col("yearly_income"))).first()[0]
    assert found == float(Fraction(sum(incomes)) / len(incomes))


def test_labels_count_each_row_once(tables):
    found = {r["label"]: (r["distinct_rows"], r["occurrences"]) for r in quality.label_counts(tables["transactions"], "transaction_id", "errors").collect()}
    split = [(f["transaction_id"], label) for f in FACTS if f["errors"] for label in f["errors"].split(",")]
    assert found == {x: (len({i for i, label in split if label == x}), sum(label == x for _, label in split)) for x in "AB"}


# ---- conversions: what a token may look like, by kind

READABLE = {
    "bigint": (r"-?\d{1,18}", int), "integer": (r"-?\d{1,9}", int), "digits": (r"\d{1,4}", int),
    "double": (r"-?\d{1,6}\.\d{1,4}", float), "flag": (r"YES|NO|yes|No", lambda t: t.lower() == "yes"),
    "month": (r"(?:0[1-9]|1[0-2])/(?:19|20)\d\d", lambda t: date(int(t[3:]), int(t[:2]), 1))}


def sample(pattern: str, rng: random.Random) -> str:
    """A text that matches one of the simple patterns above."""
    options = {
        r"-?\d{1,18}": lambda: str(rng.randrange(-10**18 + 1, 10**18)), r"-?\d{1,9}": lambda: str(rng.randrange(-10**9 + 1, 10**9)),
        r"\d{1,4}": lambda: str(rng.randrange(10**4)), r"-?\d{1,6}\.\d{1,4}": lambda: f"{rng.uniform(-1e6, 1e6):.{rng.randrange(1, 5)}f}",
        r"YES|NO|yes|No": lambda: rng.choice(["YES", "NO", "yes", "No"]),
        r"(?:0[1-9]|1[0-2])/(?:19|20)\d\d": lambda: f"{rng.randrange(1, 13):02}/{rng.randrange(1900, 2100)}"}
    text = options[pattern]()
    assert re.fullmatch(pattern, text)
    return text


@pytest.mark.parametrize("kind", list(READABLE))
def test_readable_tokens(spark, kind):
    rng, (pattern, value) = random.Random(kind), READABLE[kind]
    written = [sample(pattern, rng) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(written)), "i int, v string").coalesce(1)
    assert [r[0] for r in df.orderBy("i").select(cv.strict(F.col("v"), kind, "v")).collect()] == [value(t) for t in written]


def test_money_with_sign_and_groups(spark):
    rng = random.Random(4)
    cents = [rng.randrange(-10**9, 10**9) for _ in range(60)]
    written = [f"${'-' if c < 0 else ''}{abs(c) // 100:{',' if i % 2 else ''}}.{abs(c) % 100:02}" for i, c in enumerate(cents)]
    df = spark.createDataFrame(list(enumerate(written)), "i int, v string").coalesce(1)
    assert [r[0] for r in df.orderBy("i").select(cv.strict(F.col("v"), "money", "v")).collect()] == [Decimal(c) / 100 for c in cents]


BROKEN = {
    "bigint": ("2.5", "9" * 20, "1e3", "seven"), "integer": ("2.5", "x1"), "digits": ("-4", "+4", "4.0"), "money": ("$3$", "$7,7", "$0.001", "three", "3.00\n"),
    "flag": ("PERHAPS", "1"), "month": ("00/1999", "13/1999", "1999-01"), "double": ("east", "3d", "0x1"), "timestamp": ("tomorrow", "2020-13-01 00:00:00")}


@pytest.mark.parametrize("kind,token", [(k, t) for k, tokens in BROKEN.items() for t in tokens])
def test_unreadable_tokens_stop_and_stay_hidden(spark, kind, token):
    df = spark.createDataFrame([(token,)], "v string")
    with pytest.raises(Exception) as failure:
        df.select(cv.strict(F.col("v"), kind, "the_column")).collect()
    shown = str(failure.value).split("JVM stacktrace")[0]
    assert "the_column" in shown and (len(token) < 3 or token.strip() not in shown)


def test_blanks_are_null_in_every_kind(spark):
    kinds = ["bigint", "integer", "digits", "money", "flag", "timestamp", "month", "double", "text", "postal"]
    df = spark.createDataFrame([("",), (" ",), ("\t ",), (None,)], "v string")
    found = df.where("trim(v) = '' or v is null").select([cv.strict(F.col("v"), k, k).alias(k) for k in kinds]).collect()
    assert len(found) >= 3 and {tuple(r) for r in found} == {(None,) * len(kinds)}


@pytest.mark.parametrize("name", list(TABLES))
def test_views_show_the_contract_and_nothing_else(spark, name):
    table = TABLES[name]
    empty = spark.createDataFrame([], table.text_schema())
    view = access.canonical(cv.convert(empty, table), table)
    assert [(f.name, f.dataType) for f in view.schema] == [(f.name, f.dataType) for f in table.canonical_schema()]
    assert not set(table.restricted) & set(view.columns)


# ---- signatures

def test_signatures_ignore_order_and_see_everything_else(spark):
    rng = random.Random(6)
    rows = [tuple(rng.choice([None, "", "a", "b", "ab", "N", "V1:a"]) for _ in range(3)) + (i,) for i in range(40)]
    schema = "p string, q string, r string, i int"

    def sign(given):
        return spark.createDataFrame(given, schema).transform(quality.content_signature).first().signature

    kept = sign(rows)
    assert sign(random.Random(7).sample(rows, len(rows))) == kept
    for _ in range(12):
        at, column = rng.randrange(len(rows)), rng.randrange(3)
        changed = list(rows[at])
        changed[column] = "other" if changed[column] != "other" else None
        assert sign([*rows[:at], tuple(changed), *rows[at + 1:]]) != kept
    shifted = spark.createDataFrame([("ab", "c")], "p string, q string"), spark.createDataFrame([("a", "bc")], "p string, q string")
    assert len({quality.content_signature(df).first().signature for df in shifted}) == 2


# ---- governed selection

def test_selection_by_name(spark):
    catalog = access.GovernedCatalog({"cards": spark.createDataFrame([(i, "x") for i in range(150)], "card_id long, card_brand string")})
    assert catalog.select("main.cards", ["CARD_ID", "cards.card_brand"]).count() == 100
    assert catalog.select("MAIN.cards", ["card_id"], 4).columns == ["card_id"]
    refused = [("cards", "card_id", None), ("raw.cards", "card_id", None), ("x.main.cards", "card_id", None), ("main.cards", "cvv", None),
               ("main.cards", "cards.CARD_ID", None), ("main.cards", "*", None), ("main.cards", "card_id", 0), ("main.cards", "card_id", 101)]
    for name, column, limit in refused:
        with pytest.raises(access.AccessDenied):
            catalog.select(name, [column], limit)
    with pytest.raises(access.AccessDenied):
        access.call("PARSE_URL", F.lit("x"))
