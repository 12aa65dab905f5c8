"""Validation and profiling queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallyframe.contract import CARDS as CARD_TABLE, TABLES, TRANSACTIONS as TRANSACTION_TABLE, USERS as USER_TABLE
from tallyframe.functions.convert import convert
from tallyframe.operators import increments, quality, warehouse
from tallyframe.plans import star
from tallyframe.plans.raw import cards_source, transactions_source, users_source
from tallyframe.plans.registry import query
from tallyframe.plans.star import CARD_TX, CARDS, MCC, TX, USERS, sql
from tallyframe.session import compiled_in_parts, fresh_path


def _cell(text: str) -> str:
    return f"coalesce('V' || length({text}) || ':' || ({text}), 'N')"


def _signature_sql(cells: list[str]) -> str:
    row = " || ".join(_cell(c) for c in cells)
    return f"coalesce(bit_xor(cast('0x' || substr(md5({row}), 1, 15) as bigint)), 0)"


_USER_TYPES = [(c.raw, c.spark_type.simpleString()) for c in USER_TABLE.columns]


@query("validate_types", "select * from (values " + ", ".join(
    f"({i + 1}::bigint, '{n}', '{t}', '{n}', '{t}', true)" for i, (n, t) in enumerate(_USER_TYPES))
    + ") v(position, declared_name, declared_type, column_name, actual_type, matches), "
      "(select cast(count(*) as bigint) as filled_rows from customer)")
def validate_types(spark, folder):
    typed = convert(users_source(spark, folder), USER_TABLE)
    return quality.type_report(typed, USER_TABLE.source_schema())


_KEYS_SQL = """
    select '{name}' as table_name, cast(count(*) as bigint) as row_count,
           cast(count(distinct {key}) as bigint) as distinct_keys, cast(count(*) filter (where {null}) as bigint) as null_keys
    from {table}"""


@query("validate_keys", " union all ".join([
    _KEYS_SQL.format(name="orders", key="o_orderkey", null="o_orderkey is null", table="orders"),
    _KEYS_SQL.format(name="lineitem", key="(l_orderkey, l_linenumber)",
                     null="l_orderkey is null or l_linenumber is null", table="lineitem"),
    _KEYS_SQL.format(name="missing", key="nullif(o_orderpriority, '5-LOW')", null="o_orderpriority = '5-LOW'", table="orders")]))
def validate_keys(spark, folder):
    orders, lines = star.table(spark, folder, "orders"), star.table(spark, folder, "lineitem")
    gaps = orders.select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("code"))

    def checked(name, df, key):
        return quality.key_checks(df, key).select(F.lit(name).alias("table_name"), "*")

    return (
        checked("orders", orders, ["o_orderkey"])
        .unionByName(checked("lineitem", lines, ["l_orderkey", "l_linenumber"]))
        .unionByName(checked("missing", gaps, ["code"]))
    )


@query("validate_signature", sql(CARD_TX) + f"""
    select cast(count(*) as bigint) as row_count, {_signature_sql([
        "cast(transaction_id as varchar)", "strftime(transaction_at, '%Y-%m-%d %H:%M:%S')", "cast(client_id as varchar)",
        "cast(amount as varchar)", "errors", "merchant_city"])} as signature from ctx""")
def validate_signature(spark, folder):
    return quality.content_signature(star.card_transactions(spark, folder))


@query("validate_null_counts", sql(TX) + " union all ".join(
    f"select '{c}' as column_name, cast(count(*) filter (where {c} is null) as bigint) as null_count, "
    "cast(count(*) as bigint) as row_count from tx"
    for c in ("card_id", "client_id", "transaction_at", "amount", "transaction_method", "merchant_id", "mcc", "errors")))
def validate_null_counts(spark, folder):
    return quality.null_counts(star.transactions(spark, folder))


_KNOWN_USERS = "segment <> 'MACHINERY'"
_OWNERS = "case when card_brand = 'P' then client_id + 1 when card_id % 9 = 0 then null else client_id end"
_KNOWN_CARDS = "card_type <> '5-LOW'"


@query("validate_relationships", sql(TX, CARDS, USERS, MCC, f"""
    u as (select * from users where {_KNOWN_USERS})""", f"""
    c as (select card_id, {_OWNERS} as client_id from cards where {_KNOWN_CARDS})""") + """
    select cast(count(*) filter (where u.client_id is null) as bigint) as transactions_without_users,
           cast(count(*) filter (where c.card_id is null) as bigint) as transactions_without_cards,
           cast(count(*) filter (where c.card_id is not null and t.client_id is distinct from c.client_id) as bigint)
               as transaction_card_owner_mismatches,
           cast(count(*) filter (where m.mcc is null) as bigint) as transactions_without_mcc_descriptions,
           (select cast(count(*) as bigint) from c c2 left join u u2 on c2.client_id = u2.client_id
            where u2.client_id is null) as cards_without_users
    from tx t left join u on t.client_id = u.client_id left join c on t.card_id = c.card_id left join mcc m on t.mcc = m.mcc""")
def validate_relationships(spark, folder):
    """The dimensions are thinned and shifted on purpose, so every counter has something to find."""
    users = star.users(spark, folder).where(_KNOWN_USERS)
    cards = star.cards(spark, folder).where(_KNOWN_CARDS).select("card_id", F.expr(_OWNERS).alias("client_id"))
    return quality.relationship_report(star.transactions(spark, folder), cards, users, star.mcc_codes(spark, folder))


_PROFILE_SQL = """
    select strftime(min(transaction_at), '%Y-%m-%d %H:%M:%S') as first_timestamp,
           strftime(max(transaction_at), '%Y-%m-%d %H:%M:%S') as last_timestamp,
           cast(sum(amount) as decimal(38,2)) as net_amount,
           cast(sum(amount) filter (where amount > 0) as decimal(38,2)) as positive_amount_total,
           cast(sum(-amount) filter (where amount < 0) as decimal(38,2)) as negative_amount_magnitude,
           cast(count(*) filter (where amount < 0) as bigint) as negative_count,
           cast(count(*) filter (where amount = 0) as bigint) as zero_count,
           cast(count(*) filter (where errors is not null) as bigint) as error_count from tx"""


@query("profile_transactions", sql(TX) + _PROFILE_SQL)
def profile_transactions(spark, folder):
    profile = quality.transaction_profile(star.transactions(spark, folder, client=False))
    return profile.withColumns({
        c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_timestamp", "last_timestamp")})


@query("validate_row_counts", """
    select n.table_name, n.row_count as approved, c.actual from (
        select 'orders' as table_name, cast(count(distinct o_orderkey) as bigint) as row_count from orders
        union all select 'lineitem', cast(count(distinct (l_orderkey, l_linenumber)) as bigint) from lineitem
        union all select 'customer', cast(count(distinct c_custkey) as bigint) from customer) n
    join (select 'orders' as table_name, cast(count(*) as bigint) as actual from orders
          union all select 'lineitem', count(*) from lineitem union all select 'customer', count(*) from customer) c
      on n.table_name = c.table_name where n.row_count is distinct from c.actual""")
def validate_row_counts(spark, folder):
    """Approved counts here are the distinct keys; only a table with repeated keys differs."""
    keys = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "customer": ["c_custkey"]}
    counted = [quality.key_checks(star.table(spark, folder, name), key).withColumn("table_name", F.lit(name)) for name, key in keys.items()]
    rows = reduce(DataFrame.unionByName, counted)
    approved = rows.select("table_name", F.col("distinct_keys").alias("row_count"))
    report = rows.select("table_name", F.lit("row_count").alias("check_name"), F.lit("").alias("column_name"), F.col("row_count").cast("string").alias("value"))
    return warehouse.row_count_differences(approved, report).select("table_name", F.col("row_count").alias("approved"), "actual")


def _frequency(name: str, relation: str, table: str, columns: list[str], frame, drop_null: bool = False) -> None:
    listed = ", ".join(columns)
    condition = f" where {columns[0]} is not null" if drop_null else ""

    @query(name, f"{relation}select {listed}, cast(count(*) as bigint) as row_count from {table}{condition} group by {listed}")
    def run(spark, folder):
        return quality.frequencies(frame(spark, folder), columns, drop_null=drop_null)


def _facts(spark, folder):
    return star.transactions(spark, folder, client=False)


_frequency("profile_method_counts", sql(TX), "tx", ["transaction_method"], _facts)
_frequency("profile_error_counts", sql(TX), "tx", ["errors"], _facts, drop_null=True)
_frequency("profile_brand_type", sql(CARDS), "cards", ["card_brand", "card_type"], star.cards)
_frequency("profile_segment_counts", sql(USERS), "users", ["segment"], star.users)


@query("profile_coverage", sql(CARD_TX) + """
    select cast(count(*) as bigint) as row_count, cast(count(distinct transaction_id) as bigint) as distinct_ids,
           strftime(min(transaction_at), '%Y-%m-%d %H:%M:%S') as first_at,
           strftime(max(transaction_at), '%Y-%m-%d %H:%M:%S') as last_at,
           min(amount) as min_amount, max(amount) as max_amount,
           cast(count(*) filter (where amount < 0) as bigint) as negative_count,
           cast(count(*) filter (where amount = 0) as bigint) as zero_count,
           cast(count(*) filter (where amount > 0) as bigint) as positive_count,
           cast(count(*) filter (where errors is not null) as bigint) as error_count from ctx""")
def profile_coverage(spark, folder):
    profile = quality.coverage_profile(
        star.card_transactions(spark, folder), "transaction_id", "transaction_at", "amount", "errors")
    return profile.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_at", "last_at")})


@query("profile_reported_counts", """
    with actual as (select o_custkey, count(*) as all_children, count(*) filter (where o_orderstatus = 'F') as subset_children
                    from orders group by 1)
    select cast(count(*) as bigint) as parents,
           cast(count(*) filter (where c_custkey % 10 + 5 <> coalesce(all_children, 0)) as bigint) as differs_from_all,
           cast(count(*) filter (where c_custkey % 10 + 5 <> coalesce(subset_children, 0)) as bigint) as differs_from_subset
    from customer left join actual on c_custkey = o_custkey""")
def profile_reported_counts(spark, folder):
    parents = star.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("client_id"), (F.col("c_custkey") % 10 + 5).alias("reported"))
    children = star.table(spark, folder, "orders").select(F.col("o_custkey").alias("client_id"), "o_orderstatus")
    return quality.reported_against_actual(parents, children, "client_id", "reported", F.col("o_orderstatus") == "F")


@query("profile_key_lengths", sql(TX) + """
    select cast(length(mcc) as bigint) as key_length, cast(count(*) as bigint) as keys from tx group by 1""")
def profile_key_lengths(spark, folder):
    return quality.key_lengths(_facts(spark, folder), "mcc")


@query("error_label_counts", sql(CARD_TX) + """
    select trim(label) as label, cast(count(distinct transaction_id) as bigint) as distinct_rows,
           cast(count(*) as bigint) as occurrences
    from (select transaction_id, unnest(string_split(errors, ',')) as label from ctx where errors is not null) group by 1""")
def error_label_counts(spark, folder):
    return quality.label_counts(star.card_transactions(spark, folder), "transaction_id", "errors")


def _card_report(cards, table: str):
    nulls = cards.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cards.columns])
    counts = cards.agg(F.count(F.lit(1)).alias("row_count"), F.sum("credit_limit").alias("credit_limits"))
    return quality.as_report(nulls, table, "null_count").unionByName(quality.as_report(counts, table))


_DIFF_SQL = sql(CARDS, """
    new as (select card_id, client_id, nullif(card_type, '5-LOW') as card_type, card_brand, credit_limit, account_open
            from cards where card_brand <> 'P')""", """
    old_report as (
        select 'null_count' as check_name, 'card_type' as column_name, count(*) filter (where card_type is null) as value from cards
        union all select 'row_count', '', count(*) from cards""" + """)""", """
    new_report as (
        select 'null_count' as check_name, 'card_type' as column_name, count(*) filter (where card_type is null) as value from new
        union all select 'row_count', '', count(*) from new)""") + """
    select 'cards' as table_name, o.check_name, o.column_name, cast(o.value as varchar) as expected, cast(n.value as varchar) as actual
    from old_report o full join new_report n on o.check_name = n.check_name and o.column_name = n.column_name
    where o.value is distinct from n.value
    union all
    select 'cards', 'credit_limits', '', cast((select sum(credit_limit) from cards) as varchar),
           cast((select sum(credit_limit) from new) as varchar)"""


@query("profile_diff", _DIFF_SQL)
def profile_diff(spark, folder):
    """Stored profile of all cards against a refresh that lost a brand and some types."""
    old = star.cards(spark, folder)
    new = old.where("card_brand <> 'P'").withColumn("card_type", F.nullif("card_type", F.lit("5-LOW")))
    return quality.compare_reports(_card_report(old, "cards"), _card_report(new, "cards"))


@query("manifest_compare", _DIFF_SQL.replace("card_brand <> 'P'", "card_brand <> 'F'"))
def manifest_compare(spark, folder):
    """Preparation evidence against what is staged now."""
    evidence = _card_report(star.cards(spark, folder), "cards")
    staged = star.cards(spark, folder).where("card_brand <> 'F'").withColumn(
        "card_type", F.nullif("card_type", F.lit("5-LOW")))
    return quality.compare_reports(evidence, _card_report(staged, "cards"))


_CARD_TYPES = [(c.raw, c.spark_type.simpleString()) for c in CARD_TABLE.columns]


@query("validate_source_types", "select v.*, cast((case when column_name = 'has_chip' then chips else n end) as bigint) as filled_rows "
       "from (values " + ", ".join(
           f"({i + 1}::bigint, '{n}', '{t}', '{n}', '{t}', true)" for i, (n, t) in enumerate(_CARD_TYPES))
       + ") v(position, declared_name, declared_type, column_name, actual_type, matches), "
         "(select count(*) as n, count(*) filter (where o_orderstatus <> 'P') as chips from orders)")
def validate_source_types(spark, folder):
    """Layout of the whole typed card source, private columns included."""
    typed = convert(cards_source(spark, folder), CARD_TABLE)
    return quality.type_report(typed, CARD_TABLE.source_schema())


_AMOUNT_SQL = "cast(o_totalprice as decimal(18,2))"
_REFRESHED = {
    ("row_count", ""): "count(*)", ("null_keys", ""): "count(*) filter (where o_orderkey is null)", ("distinct_keys", ""): "count(distinct o_orderkey)",
    **{("null_count", c.canonical): {"merchant_state": "count(*)", "errors": "count(*) filter (where o_orderstatus <> 'F')"}.get(c.canonical, "count(*) filter (where false)")
       for c in TRANSACTION_TABLE.exposed},
    ("first_timestamp", ""): "strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S')", ("last_timestamp", ""): "strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S')",
    ("net_amount", ""): f"cast(sum({_AMOUNT_SQL}) as decimal(38,2))",
    ("positive_amount_total", ""): f"cast(sum({_AMOUNT_SQL}) filter (where {_AMOUNT_SQL} > 0) as decimal(38,2))",
    ("negative_amount_magnitude", ""): f"cast(sum(-{_AMOUNT_SQL}) filter (where {_AMOUNT_SQL} < 0) as decimal(38,2))",
    ("negative_count", ""): f"count(*) filter (where {_AMOUNT_SQL} < 0)", ("zero_count", ""): f"count(*) filter (where {_AMOUNT_SQL} = 0)",
    ("error_count", ""): "count(*) filter (where o_orderstatus = 'F')"}


@query("report_incremental", " union all ".join(
    f"select 'transactions_data' as table_name, '{check}' as check_name, '{column}' as column_name, cast({value} as varchar) as value from orders"
    for (check, column), value in _REFRESHED.items()) + """
    union all select 'relationships', 'cards_without_users', '', '0'
    union all select 'relationships', 'transaction_card_owner_mismatches', '', '0'""")
def report_incremental(spark, folder):
    """A file comes, one changes and one is emptied; the second report reads these three only."""
    root = fresh_path(spark, "snapshot")
    facts = convert(transactions_source(spark, folder), TRANSACTION_TABLE)
    wrong = facts.withColumns({"amount": -F.col("amount"), "client_id": F.lit(None).cast("long")})
    folders = {name: f"{root}/{name}" for name in TABLES}

    def put(part: str, rows: DataFrame) -> None:
        with compiled_in_parts(spark):
            rows.write.mode("overwrite").parquet(f"{folders['transactions']}/{part}")

    with compiled_in_parts(spark):
        convert(cards_source(spark, folder), CARD_TABLE).write.parquet(folders["cards"])
        convert(users_source(spark, folder), USER_TABLE).write.parquet(folders["users"])
    facts.select("mcc", F.lit("some category").alias("description")).distinct().write.parquet(folders["mcc_codes"])
    for part, rows in (("p0", facts.where("id % 4 = 0")), ("p1", facts.where("id % 4 = 1")), ("p2", wrong.where("id % 4 = 2")), ("p4", facts.where("id % 4 = 0"))):
        put(part, rows)
    store = increments.ReportStore(spark, fresh_path(spark, "report-states"))
    store.refresh(folders)
    for part, rows in (("p2", facts.where("id % 4 = 2")), ("p3", facts.where("id % 4 = 3")), ("p4", facts.limit(0))):
        put(part, rows)
    report, _ = store.refresh(folders)
    shown = (F.col("table_name") == "transactions_data") & (F.col("check_name") != "signature")
    return report.where(shown | F.col("check_name").isin("cards_without_users", "transaction_card_owner_mismatches"))
