"""Conversion queries: typed columns are rendered as source text and read back strictly."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.contract import CARDS, TRANSACTIONS, USERS
from tallyframe.functions import convert as cv
from tallyframe.operators.documents import corpus_words
from tallyframe.plans import star
from tallyframe.plans.raw import cards_source, transactions_source, users_source
from tallyframe.plans.registry import query


def _orders(spark, folder):
    return star.table(spark, folder, "orders")


def _blank_where(condition: str, text: F.Column) -> F.Column:
    """Some rows hold blanks only, as missing source values do."""
    return F.when(F.expr(condition), F.lit("   ")).otherwise(text)


@query("conv_text", """
    select o_orderkey, case when o_orderstatus = 'P' then null else o_orderpriority end as value from orders""")
def conv_text(spark, folder):
    text = _blank_where("o_orderstatus = 'P'", F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")))
    return _orders(spark, folder).select("o_orderkey", cv.strict(text, "text", "value").alias("value"))


@query("conv_int", """
    select o_orderkey, case when o_orderstatus = 'P' then null else 5 - o_custkey end as value from orders""")
def conv_int(spark, folder):
    text = _blank_where("o_orderstatus = 'P'", F.concat(F.lit(" "), (F.lit(5) - F.col("o_custkey")).cast("string")))
    return _orders(spark, folder).select("o_orderkey", cv.strict(text, "bigint", "value").alias("value"))


@query("conv_money", """
    select o_orderkey, cast(case when o_orderstatus = 'P' then null when o_orderstatus = 'F' then -o_totalprice
           else o_totalprice end as decimal(18,2)) as value from orders""")
def conv_money(spark, folder):
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    grouped = F.concat(F.lit("$"), F.format_number(amount, 2))
    negative = F.concat(F.lit("$-"), amount.cast("string"))
    text = _blank_where("o_orderstatus = 'P'", F.when(F.col("o_orderstatus") == "F", negative).otherwise(grouped))
    return _orders(spark, folder).select("o_orderkey", cv.strict(text, "money", "value").alias("value"))


@query("conv_bool", """
    select o_orderkey, case o_orderstatus when 'F' then true when 'O' then false end as value from orders""")
def conv_bool(spark, folder):
    text = F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "NO ").otherwise("  ")
    return _orders(spark, folder).select("o_orderkey", cv.strict(text, "flag", "value").alias("value"))


@query("conv_timestamp", """
    select event_id, case when event_type = 'view' then null
           else strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') end as value from events""")
def conv_timestamp(spark, folder):
    text = _blank_where("event_type = 'view'", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    value = cv.strict(text, "timestamp", "value")
    return star.table(spark, folder, "events").select(
        "event_id", F.date_format(value, "yyyy-MM-dd HH:mm:ss").alias("value"))


@query("conv_month", """
    select o_orderkey, case when o_orderstatus = 'P' then null
           else cast(date_trunc('month', o_orderdate) as date) end as value from orders""")
def conv_month(spark, folder):
    text = _blank_where("o_orderstatus = 'P'", F.date_format("o_orderdate", "MM/yyyy"))
    return _orders(spark, folder).select("o_orderkey", cv.strict(text, "month", "value").alias("value"))


@query("conv_postal", """
    select o_orderkey, case o_orderstatus when 'P' then null when 'F' then 'AB ' || o_custkey
           else lpad(cast(o_orderkey % 90000 as varchar), 5, '0') end as value from orders""")
def conv_postal(spark, folder):
    digits = F.concat((F.col("o_orderkey") % 90000).cast("string"), F.lit(".0"))
    other = F.concat(F.lit(" AB "), F.col("o_custkey").cast("string"))
    text = _blank_where("o_orderstatus = 'P'", F.when(F.col("o_orderstatus") == "F", other).otherwise(digits))
    return _orders(spark, folder).select("o_orderkey", cv.strict(text, "postal", "value").alias("value"))


@query("conv_double", """
    select o_orderkey, case when o_orderstatus = 'P' then null else o_totalprice end as value from orders""")
def conv_double(spark, folder):
    text = _blank_where("o_orderstatus = 'P'", F.col("o_totalprice").cast("string"))
    return _orders(spark, folder).select("o_orderkey", cv.strict(text, "double", "value").alias("value"))


@query("conv_code", """
    select p_partkey, lpad(cast(p_partkey % 1000 as varchar), 4, '0') as value from part""")
def conv_code(spark, folder):
    text = F.lpad((F.col("p_partkey") % 1000).cast("string"), 4, "0")
    return star.table(spark, folder, "part").select("p_partkey", cv.strict(text, "verbatim", "value").alias("value"))


@query("conv_uint", "select c_custkey, cast(c_custkey % 12 + 1 as integer) as value from customer")
def conv_uint(spark, folder):
    text = F.lpad((F.col("c_custkey") % 12 + 1).cast("string"), 2, "0")
    return star.table(spark, folder, "customer").select("c_custkey", cv.strict(text, "digits", "value").alias("value"))


@query("conv_tables", """
    select 'transactions' as table_name, cast(count(*) as bigint) as row_count,
           cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as money from orders
    union all
    select 'cards', count(*), cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) from orders
    union all
    select 'users', count(*), cast(sum(cast(c_acctbal as decimal(18,2))) as decimal(38,2)) from customer""")
def conv_tables(spark, folder):
    """Whole contract tables through every declared conversion."""
    def total(table, source, money):
        typed = cv.convert(source, table)
        # every column is consumed, so a failing conversion cannot be pruned away
        consumed = typed.select(F.col(money), F.hash(*typed.columns).alias("h"))
        return consumed.agg(
            F.lit(table.name).alias("table_name"), F.count("h").alias("row_count"),
            F.sum(money).cast("decimal(38,2)").alias("money"))

    return (
        total(TRANSACTIONS, transactions_source(spark, folder), "amount")
        .unionByName(total(CARDS, cards_source(spark, folder), "credit_limit"))
        .unionByName(total(USERS, users_source(spark, folder), "yearly_income"))
    )


@query("conv_rejects", """
    select 'amount' as column_name, cast(count(*) filter (where o_orderstatus <> 'O') as bigint) as bad_rows from orders
    union all select 'client_id', count(*) filter (where o_orderpriority = '1-URGENT') from orders
    union all select 'has_chip', count(*) filter (where o_orderstatus = 'F') from orders
    union all select 'opened', count(*) filter (where o_orderpriority = '5-LOW') from orders
    union all select 'latitude', count(*) filter (where o_orderstatus = 'O') from orders
    union all select 'city', 0""")
def conv_rejects(spark, folder):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    raw = _orders(spark, folder).select(
        F.when(status == "F", "$1.005").when(status == "P", "$1,2").otherwise("$1,234.50").alias("amount"),
        F.when(priority == "1-URGENT", "1.6").when(priority == "2-HIGH", "  ").otherwise("17").alias("client_id"),
        F.when(status == "F", "MAYBE").otherwise("no").alias("has_chip"),
        F.when(priority == "5-LOW", "13/2002").otherwise("09/2002").alias("opened"),
        F.when(status == "O", "broken").otherwise("-117.76").alias("latitude"),
        F.col("o_orderpriority").alias("city"),
    )
    return cv.reject_report(raw, {
        "amount": "money", "client_id": "bigint", "has_chip": "flag", "opened": "month", "latitude": "double", "city": "text"})


@query("split_entities", """
    with parts as (
        select doc_id, unnest(string_split(source || ' ; ' || lang || ';;  ; ' || source || '2;', ';')) as part from documents)
    select doc_id, trim(part) as entity from parts where trim(part) <> ''""")
def split_entities(spark, folder):
    text = F.concat_ws("", "source", F.lit(" ; "), "lang", F.lit(";;  ; "), "source", F.lit("2;"))
    return star.table(spark, folder, "documents").select("doc_id", F.explode(cv.split_entities(text)).alias("entity"))


@query("doc_embedding_text", r"""
    select doc_id, md5(source || chr(10) || chr(10) || regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) as digest
    from documents""")
def doc_embedding_text(spark, folder):
    text = cv.embedding_text(F.col("source"), F.col("text"))
    return star.table(spark, folder, "documents").select("doc_id", F.md5(text.cast("binary")).alias("digest"))


@query("doc_word_count", r"""
    select cast(count(*) as bigint) as documents,
           cast(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) as bigint) as words from documents""")
def doc_word_count(spark, folder):
    return corpus_words(star.table(spark, folder, "documents"), "text")
