"""A card-transaction star derived from the given order tables, in Spark and in SQL.

Line items play the transactions, orders the cards, customers the users and parts the
categories. Part of the codes have no category row on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _signed_amount() -> F.Column:
    return (
        F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice"))
        .when((F.col("l_linenumber") == 7) & (F.col("l_tax") == 0), F.lit(0.0))
        .otherwise(F.col("l_extendedprice")).cast("decimal(18,2)")
    )


def _mcc(key: F.Column) -> F.Column:
    return F.lpad(key.cast("string"), 9, "0")


def transactions(spark: SparkSession, folder: str, *, client: bool = True) -> DataFrame:
    """The fact rows. Without ``client`` the order table is not read: the path to it is
    many-to-one and keeps every fact row, so nothing else depends on it."""
    lines = table(spark, folder, "lineitem")
    if client:
        orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
        lines = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left")
    errors = (
        F.when(F.col("l_quantity") == 1, "Bad PIN").when(F.col("l_quantity") == 2, "Bad PIN,Insufficient Balance")
        .when(F.col("l_quantity") == 3, "Technical Glitch")
    )
    return lines.select(
        F.col("l_orderkey").alias("card_id"), *([F.col("o_custkey").alias("client_id")] if client else []),
        F.col("l_shipdate").alias("transaction_at"), _signed_amount().alias("amount"),
        F.when(F.col("l_linestatus") == "O", "Online Transaction").otherwise("Chip Transaction").alias("transaction_method"),
        F.col("l_suppkey").alias("merchant_id"), _mcc(F.col("l_partkey")).alias("mcc"), errors.alias("errors"),
    )


def mcc_codes(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").where(F.col("p_partkey") % 12 != 0)
    return part.select(_mcc(F.col("p_partkey")).alias("mcc"), F.col("p_name").alias("description"))


def cards(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("card_id"), F.col("o_custkey").alias("client_id"),
        F.col("o_orderpriority").alias("card_type"), F.col("o_orderstatus").alias("card_brand"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("credit_limit"), F.col("o_orderdate").alias("account_open"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("client_id"), F.col("c_acctbal").cast("decimal(18,2)").alias("yearly_income"),
        F.col("c_mktsegment").alias("segment"),
    )


def card_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Facts with a unique id: one per order, paid by its customer."""
    orders = table(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_orderdate").alias("transaction_at"),
        F.col("o_custkey").alias("client_id"),
        F.when(F.col("o_orderstatus") == "P", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
        .cast("decimal(18,2)").alias("amount"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Bad PIN")
        .when(F.col("o_orderpriority") == "2-HIGH", "Bad PIN,Insufficient Balance")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Technical Glitch").alias("errors"),
        F.when(F.col("o_orderstatus") == "O", "ONLINE").otherwise(F.col("o_orderpriority")).alias("merchant_city"),
    )


# Questions a caller might ask, one per event.
def questions(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    text = (
        F.when(kind == "purchase", F.concat(F.lit("Show  spending by merchant category for client "), F.col("user_id").cast("string")))
        .when(kind == "click", F.lit("what is the credit limit of cards?"))
        .when(kind == "view", F.lit("tell me the average"))
        .when(kind == "signup", F.concat(F.lit("Average income of customers, user "), F.col("user_id").cast("string")))
        .otherwise(F.lit("Count recorded error messages per vendor and postal code"))
    )
    return table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", text.alias("question"))


# The same relations as SQL common table expressions.
TX = """
tx as (
  select l.l_orderkey as card_id, o.o_custkey as client_id, l.l_shipdate as transaction_at,
         cast(case when l.l_returnflag = 'R' then -l.l_extendedprice
                   when l.l_linenumber = 7 and l.l_tax = 0 then 0 else l.l_extendedprice end as decimal(18,2)) as amount,
         case l.l_linestatus when 'O' then 'Online Transaction' else 'Chip Transaction' end as transaction_method,
         l.l_suppkey as merchant_id, lpad(cast(l.l_partkey as varchar), 9, '0') as mcc,
         case when l.l_quantity = 1 then 'Bad PIN' when l.l_quantity = 2 then 'Bad PIN,Insufficient Balance'
              when l.l_quantity = 3 then 'Technical Glitch' end as errors
  from lineitem l left join orders o on l.l_orderkey = o.o_orderkey)"""
MCC = """
mcc as (
  select lpad(cast(p_partkey as varchar), 9, '0') as mcc, p_name as description
  from part where p_partkey % 12 <> 0)"""
CARDS = """
cards as (
  select o_orderkey as card_id, o_custkey as client_id, o_orderpriority as card_type, o_orderstatus as card_brand,
         cast(o_totalprice as decimal(18,2)) as credit_limit, o_orderdate as account_open from orders)"""
USERS = """
users as (
  select c_custkey as client_id, cast(c_acctbal as decimal(18,2)) as yearly_income, c_mktsegment as segment from customer)"""
CARD_TX = """
ctx as (
  select o_orderkey as transaction_id, o_orderdate as transaction_at, o_custkey as client_id,
         cast(case when o_orderstatus = 'P' then -o_totalprice else o_totalprice end as decimal(18,2)) as amount,
         case o_orderpriority when '1-URGENT' then 'Bad PIN' when '2-HIGH' then 'Bad PIN,Insufficient Balance'
              when '3-MEDIUM' then 'Technical Glitch' end as errors,
         case o_orderstatus when 'O' then 'ONLINE' else o_orderpriority end as merchant_city from orders)"""
QUESTIONS = """
questions as (
  select event_id, user_id, ts, event_type,
         case event_type when 'purchase' then 'Show  spending by merchant category for client ' || user_id
              when 'click' then 'what is the credit limit of cards?' when 'view' then 'tell me the average'
              when 'signup' then 'Average income of customers, user ' || user_id
              else 'Count recorded error messages per vendor and postal code' end as question
  from events)"""


def sql(*parts: str) -> str:
    """``with``-clause from the relations above."""
    return "with " + ",".join(parts) + "\n"
