"""Text renderings of the given tables in the contract's raw layout, for the conversion queries.

The order table supplies the transactions and the cards: typed values become the kind of text
a source file holds, with blanks, currency signs, grouping commas and padded spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyframe.contract import CARDS, TRANSACTIONS, USERS
from tallyframe.plans import star


def _text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _money(column: str) -> Column:
    return F.concat(F.lit("$"), F.col(column).cast("decimal(18,2)").cast("string"))


def transactions_source(spark: SparkSession, folder: str) -> DataFrame:
    orders = star.table(spark, folder, "orders")
    key = F.col("o_orderkey")
    values = {
        "id": _text(key), "date": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "client_id": _text("o_custkey"),
        "card_id": _text(key), "amount": _money("o_totalprice"), "use_chip": F.col("o_orderpriority"),
        "merchant_id": _text("o_custkey"), "merchant_city": F.col("o_orderstatus"), "merchant_state": F.lit("  "),
        "zip": F.concat(_text(key % 90000), F.lit(".0")), "mcc": F.lpad(_text(F.col("o_custkey") % 120), 4, "0"),
        "errors": F.when(F.col("o_orderstatus") == "F", "Bad PIN").otherwise(" "),
    }
    return orders.select([values[c].alias(c) for c in TRANSACTIONS.raw_names])


def cards_source(spark: SparkSession, folder: str) -> DataFrame:
    orders = star.table(spark, folder, "orders")
    key = F.col("o_orderkey")
    month = F.date_format("o_orderdate", "MM/yyyy")
    values = {
        "id": _text(key), "client_id": _text("o_custkey"), "card_brand": F.col("o_orderstatus"),
        "card_type": F.col("o_orderpriority"), "card_number": F.lpad(_text(key), 16, "0"), "expires": month,
        "cvv": F.lpad(_text(key % 1000), 3, "0"),
        "has_chip": F.when(F.col("o_orderstatus") == "F", "YES").when(F.col("o_orderstatus") == "O", "no").otherwise("  "),
        "num_cards_issued": _text(key % 3 + 1), "credit_limit": _money("o_totalprice"), "acct_open_date": month,
        "year_pin_last_changed": _text(F.year("o_orderdate")), "card_on_dark_web": F.lit("No"),
    }
    return orders.select([values[c].alias(c) for c in CARDS.raw_names])


def users_source(spark: SparkSession, folder: str) -> DataFrame:
    customer = star.table(spark, folder, "customer")
    key = F.col("c_custkey")
    values = {
        "id": _text(key), "current_age": _text(key % 60 + 20), "retirement_age": F.lit("65"),
        "birth_year": _text(F.lit(2000) - key % 60), "birth_month": F.lpad(_text(key % 12 + 1), 2, "0"),
        "gender": F.when(key % 2 == 0, "Female").otherwise("Male"), "address": F.col("c_name"),
        "latitude": _text((key % 90).cast("double")), "longitude": _text(-(key % 180).cast("double")),
        "per_capita_income": _money("c_acctbal"), "yearly_income": _money("c_acctbal"), "total_debt": F.lit("$0"),
        "credit_score": _text(key % 300 + 500), "num_credit_cards": F.lit("1"),
    }
    return customer.select([values[c].alias(c) for c in USERS.raw_names])
