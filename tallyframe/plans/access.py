"""Projection, governed access and join-path queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallyframe.contract import CARDS as CARD_TABLE, TRANSACTIONS
from tallyframe.functions.convert import convert
from tallyframe.operators import access, joins
from tallyframe.plans import star
from tallyframe.plans.raw import cards_source, transactions_source
from tallyframe.plans.registry import query
from tallyframe.plans.star import CARDS, MCC, TX, USERS, sql


@query("canonical_view", """
    select o_orderkey as transaction_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as transaction_at,
           o_custkey as client_id, o_orderkey as card_id, cast(o_totalprice as decimal(18,2)) as amount,
           o_orderpriority as transaction_method, o_custkey as merchant_id, o_orderstatus as merchant_city,
           cast(null as varchar) as merchant_state, lpad(cast(o_orderkey % 90000 as varchar), 5, '0') as merchant_postal_code,
           lpad(cast(o_custkey % 120 as varchar), 4, '0') as mcc,
           case when o_orderstatus = 'F' then 'Bad PIN' end as errors
    from orders""")
def canonical_view(spark, folder):
    view = access.canonical(convert(transactions_source(spark, folder), TRANSACTIONS), TRANSACTIONS)
    return view.withColumn("transaction_at", F.date_format("transaction_at", "yyyy-MM-dd HH:mm:ss"))


@query("restricted_columns_absent", """
    select column_name, private_source_values, exposed from (
        select 'card_number' as column_name, cast(count(*) as bigint) as private_source_values, false as exposed from orders
        union all select 'expires', count(*), false from orders
        union all select 'cvv', count(*), false from orders)""")
def restricted_columns_absent(spark, folder):
    source = cards_source(spark, folder)
    shown = access.canonical(source, CARD_TABLE).columns
    counts = source.agg(*[F.count(c).alias(c) for c in CARD_TABLE.restricted])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("private_source_values"), F.lit(c in shown).alias("exposed"))
        for c in CARD_TABLE.restricted])))


def _catalog(spark, folder) -> access.GovernedCatalog:
    return access.GovernedCatalog({
        "transactions": star.transactions(spark, folder), "cards": star.cards(spark, folder),
        "users": star.users(spark, folder), "mcc_codes": star.mcc_codes(spark, folder)})


@query("governed_select", sql(TX) + """
    select client_id, mcc, cast(sum(amount) as decimal(38,2)) as total from tx group by 1, 2""")
def governed_select(spark, folder):
    totals = _catalog(spark, folder).total("main.transactions", ["client_id", "transactions.mcc"], {"total": ("sum", "amount")})
    return totals.withColumn("total", F.col("total").cast("decimal(38,2)"))


_REQUESTS = (
    ("main.cards", "card_brand", 5), ("cards", "card_brand", 5), ("source.cards", "card_brand", 5), ("other.main.cards", "card_brand", 5),
    ("main.cards", "cvv", 5), ("main.cards", "cards.CARD_BRAND", 5), ("main.cards", "cards.card_brand", 5), ("main.cards", "*", 5),
    ("main.cards", "card_brand", 0), ("main.cards", "card_brand", 101), ("main.payments", "amount", 5), ("MAIN.users", "SEGMENT", 100),
)


@query("governed_refusals", """
    select r.relation, r.column_name, cast(r.row_limit as bigint) as row_limit, r.refused,
           case when r.refused then cast(0 as bigint) else least(r.row_limit, case when lower(r.relation) = 'main.users' then u.n else o.n end) end as row_count
    from (values ('main.cards', 'card_brand', 5, false), ('cards', 'card_brand', 5, true), ('source.cards', 'card_brand', 5, true),
        ('other.main.cards', 'card_brand', 5, true), ('main.cards', 'cvv', 5, true), ('main.cards', 'cards.CARD_BRAND', 5, true),
        ('main.cards', 'cards.card_brand', 5, false), ('main.cards', '*', 5, true), ('main.cards', 'card_brand', 0, true),
        ('main.cards', 'card_brand', 101, true), ('main.payments', 'amount', 5, true), ('MAIN.users', 'SEGMENT', 100, false)
    ) as r(relation, column_name, row_limit, refused), (select count(*) as n from orders) o, (select count(*) as n from customer) u""")
def governed_refusals(spark, folder):
    """Requests inside and outside the allowlists, and how many rows each got."""
    catalog, rows = _catalog(spark, folder), []
    for relation, column, limit in _REQUESTS:
        given = [F.lit(relation).alias("relation"), F.lit(column).alias("column_name"), F.lit(limit).cast("long").alias("row_limit")]
        try:
            shown = catalog.select(relation, [column], limit)
            rows.append(shown.agg(*given, F.lit(False).alias("refused"), F.count(F.lit(1)).alias("row_count")))
        except access.AccessDenied:
            rows.append(spark.range(1).select(*given, F.lit(True).alias("refused"), F.lit(0).cast("long").alias("row_count")))
    return reduce(DataFrame.unionByName, rows)


@query("bounded_result", sql(CARDS) + """
    select card_id, credit_limit from cards order by credit_limit desc, card_id limit 100""")
def bounded_result(spark, folder):
    ordered = star.cards(spark, folder).select("card_id", "credit_limit").orderBy(F.desc("credit_limit"), "card_id")
    return access.bounded(ordered)


@query("join_tx_user", sql(TX, USERS) + """
    select u.segment, cast(count(*) as bigint) as n, cast(sum(t.amount) as decimal(38,2)) as net_amount
    from tx t left join users u on t.client_id = u.client_id group by 1""")
def join_tx_user(spark, folder):
    totals = joins.related_totals(
        star.transactions(spark, folder), star.users(spark, folder).select("client_id", "segment"), ["client_id"],
        [F.col("segment")], {"n": F.lit(1), "net_amount": F.col("amount")})
    return totals.withColumn("net_amount", F.col("net_amount").cast("decimal(38,2)"))


@query("join_tx_card", sql(TX, CARDS) + """
    select c.card_type, c.card_brand, cast(count(*) as bigint) as n, cast(sum(t.amount) as decimal(38,2)) as net_amount
    from tx t left join cards c on t.card_id = c.card_id and t.client_id = c.client_id group by 1, 2""")
def join_tx_card(spark, folder):
    cards = star.cards(spark, folder).select("card_id", "client_id", "card_type", "card_brand")
    totals = joins.related_totals(
        star.transactions(spark, folder), cards, ["card_id", "client_id"],
        [F.col("card_type"), F.col("card_brand")], {"n": F.lit(1), "net_amount": F.col("amount")})
    return totals.withColumn("net_amount", F.col("net_amount").cast("decimal(38,2)"))


@query("join_card_user", sql(CARDS, USERS) + """
    select c.card_id, c.client_id, u.segment, u.yearly_income from cards c left join users u on c.client_id = u.client_id""")
def join_card_user(spark, folder):
    return joins.enrich(star.cards(spark, folder), star.users(spark, folder), "card_customer",
                        ["segment", "yearly_income"]).select("card_id", "client_id", "segment", "yearly_income")


@query("join_tx_mcc", sql(TX, MCC) + """
    select t.card_id, t.mcc, m.description, t.amount from tx t left join mcc m on t.mcc = m.mcc""")
def join_tx_mcc(spark, folder):
    facts = star.transactions(spark, folder, client=False)
    return joins.enrich(facts, star.mcc_codes(spark, folder), "transaction_category", ["description"]).select(
        "card_id", "mcc", "description", "amount")


@query("join_star_inner", sql(TX, CARDS, USERS, MCC) + """
    select m.description, u.segment, cast(sum(t.amount) as decimal(38,2)) as total
    from tx t join cards c on t.card_id = c.card_id and t.client_id = c.client_id
    join users u on t.client_id = u.client_id join mcc m on t.mcc = m.mcc group by 1, 2""")
def join_star_inner(spark, folder):
    """Rows hardly share card, client and code, so the joins on card and client, which sort and merge, see them as they
    are; a hot key is split by adaptive execution. What is left are segments, so rows are combined by code before its join."""
    joined = joins.enrich(star.transactions(spark, folder), star.cards(spark, folder), "transaction_card", [], "inner")
    joined = joins.enrich(joined, star.users(spark, folder), "transaction_customer", ["segment"], "inner")
    totals = joined.groupBy("mcc", "segment").agg(F.sum("amount").alias("amount"))
    described = joins.enrich(totals, star.mcc_codes(spark, folder), "transaction_category", ["description"], "inner")
    return described.groupBy("description", "segment").agg(F.sum("amount").cast("decimal(38,2)").alias("total"))


@query("join_mcc_inner", sql(TX, MCC) + """
    select m.description, cast(sum(t.amount) as decimal(38,2)) as total
    from tx t join mcc m on t.mcc = m.mcc group by 1 order by total desc, description limit 10""")
def join_mcc_inner(spark, folder):
    totals = joins.related_totals(
        star.transactions(spark, folder, client=False), star.mcc_codes(spark, folder), ["mcc"], [F.col("description")],
        {"total": F.col("amount")}, "inner")
    cast = totals.withColumn("total", F.col("total").cast("decimal(38,2)"))
    return access.bounded(cast.orderBy(F.desc("total"), "description"), 10)


@query("join_exists_semi", sql(TX, USERS) + """
    select client_id, segment from users u where exists (
        select 1 from tx t where t.client_id = u.client_id and t.errors is not null and t.amount > 0)""")
def join_exists_semi(spark, folder):
    activity = star.transactions(spark, folder).where("errors is not null and amount > 0")
    return joins.with_activity(star.users(spark, folder), activity, "client_id").select("client_id", "segment")


@query("join_orphans_anti", sql(CARDS, USERS) + """
    select c.card_id, c.client_id from cards c
    where not exists (select 1 from users u where u.client_id = c.client_id and u.segment <> 'MACHINERY')""")
def join_orphans_anti(spark, folder):
    known = star.users(spark, folder).where("segment <> 'MACHINERY'")
    return joins.orphans(star.cards(spark, folder), known, "client_id").select("card_id", "client_id")


_MOVED = "case when card_brand = 'P' then client_id + 1 else client_id end"


@query("join_owner_mismatch", sql(TX, CARDS) + f"""
    select t.card_id, t.client_id, c.client_id as owner_id, cast(count(*) as bigint) as fact_rows
    from tx t join (select card_id, {_MOVED} as client_id from cards) c on t.card_id = c.card_id
    where t.client_id is distinct from c.client_id group by 1, 2, 3""")
def join_owner_mismatch(spark, folder):
    moved = star.cards(spark, folder).select("card_id", F.expr(_MOVED).alias("client_id"))
    return joins.owner_mismatches(star.transactions(spark, folder), moved)


@query("join_fanout_guard", sql(TX, CARDS, """
    agg as (select client_id, count(*) as matches from cards group by 1),
    joined as (select t.client_id, c.card_id from tx t left join cards c on t.client_id = c.client_id)""") + """
    select (select cast(count(*) as bigint) from tx) as fact_rows, (select cast(count(*) as bigint) from joined) as joined_rows,
           (select cast(count(*) as bigint) from agg where matches > 1 and client_id in (select client_id from tx)) as multiplied_keys
    """)
def join_fanout_guard(spark, folder):
    """The tempting join on the customer alone multiplies facts; the report shows by how much."""
    return joins.fanout(star.transactions(spark, folder), star.cards(spark, folder), ["client_id"]).select(
        *[F.col(c).cast("long").alias(c) for c in ("fact_rows", "joined_rows", "multiplied_keys")])
