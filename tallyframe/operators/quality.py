"""Data-quality reports: types, keys, nulls, signatures, references, profiles and their comparison.

Every report is aggregate-only rows ``(table_name, check_name, column_name, value)``, so
reports can be stored, compared and published without exposing source values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.contract import TABLES, Table
from tallyframe.operators import joins

REPORT_KEY = ["table_name", "check_name", "column_name"]
_HEX_DIGITS = 15  # 60 bits, so the number fits a signed 64-bit integer


def unpivot(row: DataFrame, name: str, value: str, columns: list[str] | None = None) -> DataFrame:
    """A one-row aggregate as ``(name, value)`` rows."""
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns or row.columns
    ])))


def type_report(df: DataFrame, declared: T.StructType) -> DataFrame:
    """Declared against actual columns in order, with the number of filled rows of each."""
    filled = null_counts(df).select("column_name", (F.col("row_count") - F.col("null_count")).alias("filled_rows"))
    width = max(len(declared), len(df.schema))
    expected = [(f.name, f.dataType.simpleString()) for f in declared] + [(None, None)] * (width - len(declared))
    actual = [(f.name, f.dataType.simpleString()) for f in df.schema] + [(None, None)] * (width - len(df.schema))
    rows = [(i + 1, e[0], e[1], a[0], a[1], e == a) for i, (e, a) in enumerate(zip(expected, actual))]
    layout = df.sparkSession.createDataFrame(
        rows, "position long, declared_name string, declared_type string, column_name string, actual_type string, matches boolean")
    return layout.join(filled, "column_name", "left")


def require_types(df: DataFrame, declared: T.StructType, name: str) -> None:
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in declared]:
        raise ValueError(f"Type mismatch in {name}")


def key_checks(df: DataFrame, key: list[str]) -> DataFrame:
    """``(row_count, distinct_keys, null_keys)`` in one scan; distinct keys combine map-side first."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    value = F.col(key[0]) if len(key) == 1 else F.struct(*key)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(F.when(~missing, value)).alias("distinct_keys"),
        F.count_if(missing).alias("null_keys"),
    )


def _cell(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.lit("V"), F.length(text).cast("string"), F.lit(":"), text), F.lit("N"))


def row_hash(columns: list[Column]) -> Column:
    """60-bit hash of a row; lengths are part of the text, so shifting cell borders changes it."""
    digest = F.md5(F.concat(*[_cell(c) for c in columns]).cast("binary"))
    return F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("long")


def content_signature(df: DataFrame, columns: list[Column] | None = None) -> DataFrame:
    """Order-independent signature. Pairs of equal rows cancel out, so read it next to ``key_checks``."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.bit_xor(row_hash(columns or [F.col(c) for c in df.columns])), F.lit(0)).alias("signature"),
    )


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, null_count, row_count)`` for all columns from one scan."""
    columns = columns or df.columns
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count"), F.col("_rows").alias("row_count"))
        for c in columns
    ])))


def relationship_report(transactions: DataFrame, cards: DataFrame, users: DataFrame, mcc_codes: DataFrame) -> DataFrame:
    """One row of reference counters; every one must be zero in a clean snapshot.

    Transactions are counted per (card, client) and per category before any join, so the joins
    see one row per combination however many rows it has; each dimension key must be unique. A card
    without an owner is known, and owned by nobody.
    """
    return relationship_counts(
        transactions.groupBy("client_id", "card_id").agg(F.count(F.lit(1)).alias("n")),
        transactions.groupBy("mcc").agg(F.count(F.lit(1)).alias("n")), cards, users, mcc_codes)


def relationship_counts(per_pair: DataFrame, per_mcc: DataFrame, cards: DataFrame, users: DataFrame, mcc_codes: DataFrame) -> DataFrame:
    """The reference counters from how many transactions (``n``) each pair of client and card, and each category, has."""
    owners = cards.select("card_id", F.col("client_id").alias("owner_id"), F.lit(True).alias("known_card"))
    known = users.select("client_id", F.lit(True).alias("known_user"))
    by_pair = per_pair.join(owners, "card_id", "left").join(known, "client_id", "left").agg(
        _sum_where(F.col("known_user").isNull()).alias("transactions_without_users"),
        _sum_where(F.col("known_card").isNull()).alias("transactions_without_cards"),
        _sum_where(F.col("known_card").isNotNull() & ~F.col("client_id").eqNullSafe(F.col("owner_id")))
        .alias("transaction_card_owner_mismatches"),
    )
    by_mcc = joins.orphans(per_mcc, mcc_codes, "mcc").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("transactions_without_mcc_descriptions"))
    per_owner = cards.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    by_card = joins.orphans(per_owner, users, "client_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("cards_without_users"))
    return _side_by_side(by_pair, by_mcc, by_card)


def _sum_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _side_by_side(*single_rows: DataFrame) -> DataFrame:
    """One-row aggregates placed in one row: stacked with gaps, then the only value of each column taken."""
    names = [c for df in single_rows for c in df.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), single_rows)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def _profile(time: Column, amount: Column, errors: Column) -> dict[str, Column]:
    money = "decimal(38,2)"
    return {
        "first_timestamp": F.min(time),
        "last_timestamp": F.max(time),
        "net_amount": F.sum(amount).cast(money),
        "positive_amount_total": F.sum(F.when(amount > 0, amount)).cast(money),
        "negative_amount_magnitude": F.sum(F.when(amount < 0, -amount)).cast(money),
        "negative_count": F.count_if(amount < 0),
        "zero_count": F.count_if(amount == 0),
        "error_count": F.count_if(errors.isNotNull()),
    }


def transaction_profile(transactions: DataFrame) -> DataFrame:
    """Time span, totals and sign/error counts of the fact table in one scan."""
    profile = _profile(F.col("transaction_at"), F.col("amount"), F.col("errors"))
    return transactions.agg(*[value.alias(name) for name, value in profile.items()])


def coverage_profile(df: DataFrame, key: str, time: str, amount: str, errors: str) -> DataFrame:
    """Row and key counts with the ranges of time and amount.

    Keys are counted apart from the rest: next to a distinct count of a nearly unique key, every
    other aggregate would cross the shuffle once per key.
    """
    ranges = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(time).alias("first_at"), F.max(time).alias("last_at"),
        F.min(amount).alias("min_amount"), F.max(amount).alias("max_amount"),
        F.count_if(F.col(amount) < 0).alias("negative_count"), F.count_if(F.col(amount) == 0).alias("zero_count"),
        F.count_if(F.col(amount) > 0).alias("positive_count"), F.count_if(F.col(errors).isNotNull()).alias("error_count"),
    )
    return _side_by_side(ranges, df.agg(F.count_distinct(key).alias("distinct_ids")))


def frequencies(df: DataFrame, columns: list[str], *, drop_null: bool = False) -> DataFrame:
    if drop_null:
        df = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count"))


def reported_against_actual(
    parents: DataFrame, children: DataFrame, key: str, reported: str, subset: Column,
) -> DataFrame:
    """How many parents report another child count than all children, or than a subset of them."""
    actual = children.groupBy(key).agg(
        F.count(F.lit(1)).alias("all_children"), F.count_if(subset).alias("subset_children"))
    joined = parents.select(key, reported).join(actual, key, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("parents"),
        F.count_if(F.col(reported) != F.coalesce("all_children", F.lit(0))).alias("differs_from_all"),
        F.count_if(F.col(reported) != F.coalesce("subset_children", F.lit(0))).alias("differs_from_subset"),
    )


def key_lengths(df: DataFrame, key: str) -> DataFrame:
    """Distinct key lengths, as rows."""
    return df.groupBy(F.length(key).cast("long").alias("key_length")).agg(F.count(F.lit(1)).alias("keys"))


def label_counts(df: DataFrame, key: str, labels: str, separator: str = ",") -> DataFrame:
    """Rows and distinct keys per label of a multi-label text column."""
    exploded = df.where(F.col(labels).isNotNull()).select(
        key, F.explode(F.split(labels, separator)).alias("label"))
    # per (label, key) first: spreads a dominant label over all tasks before the final count
    per_key = exploded.groupBy(F.trim("label").alias("label"), key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("label").agg(
        F.count(F.lit(1)).alias("distinct_rows"), F.sum("n").alias("occurrences"))


def compare_reports(expected: DataFrame, actual: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Entries that differ between two stored reports, including entries only one of them has."""
    key = key or REPORT_KEY
    condition = reduce(lambda a, b: a & b, [F.col(f"e.{k}").eqNullSafe(F.col(f"a.{k}")) for k in key])
    joined = expected.alias("e").join(actual.alias("a"), condition, "full_outer")
    return joined.where(~F.col("e.value").eqNullSafe(F.col("a.value"))).select(
        *[F.coalesce(f"e.{k}", f"a.{k}").alias(k) for k in key],
        F.col("e.value").alias("expected"), F.col("a.value").alias("actual"),
    )


def as_report(row: DataFrame, table: str, check: str | None = None) -> DataFrame:
    """A one-row aggregate as report rows; the aggregate's names become checks (or columns of one check)."""
    text = row.select([F.col(c).cast("string").alias(c) for c in row.columns])
    rows = unpivot(text, "name", "value")
    return rows.select(
        F.lit(table).alias("table_name"),
        (F.lit(check) if check else F.col("name")).alias("check_name"),
        (F.col("name") if check else F.lit("")).alias("column_name"), "value",
    )


def table_checks(table: Table) -> dict[tuple[str, str], Column]:
    """Counts, signature, null counts and, for the facts, the profile, by (check, column); all merge over parts of a table."""
    checks = {
        ("row_count", ""): F.count(F.lit(1)),
        ("null_keys", ""): F.count_if(F.col(table.key).isNull()),
        ("signature", ""): F.coalesce(F.bit_xor(row_hash([F.col(c) for c in table.raw_names])), F.lit(0)),
        **{("null_count", c.canonical): F.count_if(F.col(c.raw).isNull()) for c in table.exposed},
    }
    if table.name == "transactions":
        raw = {c.canonical: F.col(c.raw) for c in table.exposed}
        checks |= {(name, ""): value for name, value in
                   _profile(raw["transaction_at"], raw["amount"], raw["errors"]).items()}
    return checks


def check_rows(counted: DataFrame, table: Table) -> DataFrame:
    """Report rows from one row that has the checks of a table as c0, c1, ... in their order."""
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(table.source).alias("table_name"), F.lit(check).alias("check_name"),
                 F.lit(column).alias("column_name"), F.col(f"c{i}").cast("string").alias("value"))
        for i, (check, column) in enumerate(table_checks(table))])))


def _table_report(df: DataFrame, table: Table) -> DataFrame:
    """The checks from one scan and distinct keys from another, which reads and shuffles nothing but keys."""
    rows = check_rows(df.agg(*[value.alias(f"c{i}") for i, value in enumerate(table_checks(table).values())]), table)
    return rows.unionByName(as_report(df.agg(F.count_distinct(table.key).alias("distinct_keys")), table.source))


def quality_report(sources: dict[str, DataFrame], canonical: dict[str, DataFrame]) -> DataFrame:
    """The full report of a prepared snapshot: counts, keys, signatures, nulls, references, profile."""
    parts = [_table_report(df, TABLES[name]) for name, df in sources.items()]
    parts.append(as_report(relationship_report(*[canonical[t] for t in TABLES]), "relationships"))
    return reduce(DataFrame.unionByName, parts)


def report_failures(report: DataFrame) -> DataFrame:
    """Report entries that make a snapshot unusable: repeated or missing keys, broken references."""
    keys = (
        report.where(F.col("check_name").isin("row_count", "distinct_keys", "null_keys"))
        .groupBy("table_name")
        .agg(*[F.max(F.when(F.col("check_name") == c, F.col("value").cast("long"))).alias(c)
               for c in ("row_count", "distinct_keys", "null_keys")])
        .where((F.col("row_count") != F.col("distinct_keys")) | (F.col("null_keys") > 0))
        .select("table_name", F.lit("Duplicate or missing keys").alias("failure"))
    )
    references = (
        report.where((F.col("table_name") == "relationships") & (F.col("value").try_cast("long") > 0))
        .select(F.col("check_name").alias("table_name"), F.lit("Broken reference or foreign card").alias("failure"))
    )
    return keys.unionByName(references)


def require_clean(report: DataFrame) -> None:
    failure = report_failures(report).take(1)
    if failure:
        raise ValueError(f"{failure[0].failure}: {failure[0].table_name}")
