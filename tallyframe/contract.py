"""The data contract: tables, columns, keys, join paths, metrics and vocabulary.

Values in this file are fixed: they define which columns exist, what they are called and
which of them may be shown. A column without a canonical name is private.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

#: conversion kind -> stored type
KINDS: dict[str, T.DataType] = {
    "bigint": T.LongType(),
    "integer": T.IntegerType(),
    "digits": T.IntegerType(),
    "money": MONEY,
    "flag": T.BooleanType(),
    "timestamp": T.TimestampNTZType(),
    "month": T.DateType(),
    "text": T.StringType(),
    "postal": T.StringType(),
    "double": T.DoubleType(),
    "verbatim": T.StringType(),
}


@dataclass(frozen=True)
class Column:
    raw: str
    canonical: str | None
    kind: str
    sensitivity: str

    @property
    def exposed(self) -> bool:
        return self.canonical is not None

    @property
    def spark_type(self) -> T.DataType:
        return KINDS[self.kind]


@dataclass(frozen=True)
class Table:
    name: str
    source: str
    key: str
    columns: tuple[Column, ...]
    synonyms: tuple[str, ...]
    file_format: str = "csv"

    @property
    def raw_names(self) -> list[str]:
        return [c.raw for c in self.columns]

    @property
    def exposed(self) -> list[Column]:
        return [c for c in self.columns if c.exposed]

    @property
    def restricted(self) -> list[str]:
        return [c.raw for c in self.columns if not c.exposed]

    def text_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.raw, T.StringType()) for c in self.columns])

    def source_schema(self) -> T.StructType:
        return T.StructType([
            T.StructField(c.raw, c.spark_type, True,
                          {"sensitivity": c.sensitivity, "canonical_name": c.canonical or "", "exposed": c.exposed})
            for c in self.columns
        ])

    def canonical_schema(self) -> T.StructType:
        return T.StructType([
            T.StructField(c.canonical, c.spark_type, True, {"sensitivity": c.sensitivity}) for c in self.exposed
        ])


@dataclass(frozen=True)
class Relationship:
    name: str
    left: str
    right: str
    keys: tuple[str, ...]
    how: str = "left"


def _columns(*rows: tuple[str, str | None, str, str]) -> tuple[Column, ...]:
    return tuple(Column(*row) for row in rows)


TRANSACTIONS = Table(
    "transactions", "transactions_data", "id",
    _columns(
        ("id", "transaction_id", "bigint", "pseudonymous_identifier"),
        ("date", "transaction_at", "timestamp", "transaction_detail"),
        ("client_id", "client_id", "bigint", "pseudonymous_identifier"),
        ("card_id", "card_id", "bigint", "pseudonymous_identifier"),
        ("amount", "amount", "money", "financial"),
        ("use_chip", "transaction_method", "text", "operational"),
        ("merchant_id", "merchant_id", "bigint", "pseudonymous_identifier"),
        ("merchant_city", "merchant_city", "text", "merchant_location"),
        ("merchant_state", "merchant_state", "text", "merchant_location"),
        ("zip", "merchant_postal_code", "postal", "merchant_location"),
        ("mcc", "mcc", "text", "category"),
        ("errors", "errors", "text", "operational"),
    ),
    ("transactions", "payments", "card transactions", "transaction records"),
)

CARDS = Table(
    "cards", "cards_data", "id",
    _columns(
        ("id", "card_id", "bigint", "pseudonymous_identifier"),
        ("client_id", "client_id", "bigint", "pseudonymous_identifier"),
        ("card_brand", "card_brand", "text", "category"),
        ("card_type", "card_type", "text", "category"),
        ("card_number", None, "text", "restricted_payment_credential"),
        ("expires", None, "month", "restricted_payment_credential"),
        ("cvv", None, "text", "restricted_payment_credential"),
        ("has_chip", "has_chip", "flag", "operational"),
        ("num_cards_issued", "num_cards_issued", "integer", "financial"),
        ("credit_limit", "credit_limit", "money", "financial"),
        ("acct_open_date", "account_open_month", "month", "financial"),
        ("year_pin_last_changed", "year_pin_last_changed", "integer", "operational"),
        ("card_on_dark_web", "card_on_dark_web", "flag", "financial"),
    ),
    ("cards", "card inventory", "credit cards", "debit cards"),
)

USERS = Table(
    "users", "users_data", "id",
    _columns(
        ("id", "client_id", "bigint", "pseudonymous_identifier"),
        ("current_age", "current_age", "integer", "demographic"),
        ("retirement_age", "retirement_age", "integer", "demographic"),
        ("birth_year", "birth_year", "integer", "demographic"),
        ("birth_month", None, "digits", "personal_detail"),
        ("gender", "gender", "text", "demographic"),
        ("address", None, "text", "direct_personal_identifier"),
        ("latitude", None, "double", "precise_personal_location"),
        ("longitude", None, "double", "precise_personal_location"),
        ("per_capita_income", "per_capita_income", "money", "financial"),
        ("yearly_income", "yearly_income", "money", "financial"),
        ("total_debt", "total_debt", "money", "financial"),
        ("credit_score", "credit_score", "integer", "financial"),
        ("num_credit_cards", "num_credit_cards", "integer", "financial"),
    ),
    ("users", "customers", "clients", "cardholders"),
)

MCC_CODES = Table(
    "mcc_codes", "mcc_codes", "mcc",
    _columns(
        ("mcc", "mcc", "verbatim", "public_reference"),
        ("description", "description", "verbatim", "public_reference"),
    ),
    ("merchant categories", "merchant category codes", "business categories", "MCC"),
    file_format="json_object",
)

#: declared order matters: it breaks ties between equally scored tables
TABLES: dict[str, Table] = {t.name: t for t in (TRANSACTIONS, CARDS, USERS, MCC_CODES)}

RELATIONSHIPS: dict[str, Relationship] = {
    r.name: r
    for r in (
        Relationship("transaction_customer", "transactions", "users", ("client_id",)),
        Relationship("transaction_card", "transactions", "cards", ("card_id", "client_id")),
        Relationship("card_customer", "cards", "users", ("client_id",)),
        Relationship("transaction_category", "transactions", "mcc_codes", ("mcc",)),
    )
}

# Vocabulary that links a question to tables. Each entry is
# (phrases that trigger it, tables credited once per place the entry points to).
GLOSSARY: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "customer": (("customer", "client", "user", "cardholder"), ("users",)),
    "transaction": (("transaction", "transaction record", "recorded payment"), ("transactions",)),
    "spending": (("spend", "spent", "expenditure", "spending"), ()),
    "purchase": (("purchase", "sale"), ()),
    "refund": (("refund", "reversal", "credit back"), ()),
    "error": (("recorded error", "error message", "transaction error"), ("transactions",)),
    "successful_transaction": (("successful", "settled", "approved", "completed"), ()),
    "transaction_method": (("channel", "payment method", "chip", "swipe", "online"), ("transactions",)),
    "merchant_category": (
        ("MCC", "business category", "merchant category", "merchant industry"),
        ("mcc_codes", "transactions", "mcc_codes"),
    ),
    "merchant": (("merchant", "vendor", "retailer"), ("transactions",)),
    "merchant_location": (("merchant city", "merchant state", "merchant ZIP", "postal code"), ("transactions",)),
    "income": (("income", "annual income", "yearly earnings"), ("users",)),
    "debt": (("debt", "total debt"), ("users",)),
    "card_count": (("number of cards", "cards held"), ()),
    "credit_cards": (("credit card", "credit cards"), ()),
    "debit_cards": (("debit card", "debit cards"), ()),
}

# Words that raise the transactions score on their own.
AMOUNT_WORDS = ("spending", "spend", "amount", "transaction", "payment")

# Metric labels in declared order; all are measured on transactions.
METRIC_LABELS: dict[str, str] = {
    "transaction_count": "Recorded transaction count",
    "positive_amount_total": "Total positive recorded amounts",
    "negative_amount_magnitude": "Magnitude of negative recorded amounts",
    "net_amount": "Net signed recorded amount",
    "average_positive_amount": "Average positive recorded amount",
    "negative_transaction_count": "Negative-value transaction count",
    "error_recorded_count": "Transactions with recorded errors",
    "error_recorded_rate": "Fraction of transactions with recorded errors",
    "transacting_customer_count": "Customers with at least one recorded transaction",
}

# Label words that say nothing about the subject.
LABEL_STOPWORDS = (
    "with", "least", "than", "that", "have", "average", "total", "count", "fraction", "number",
)

MAX_RESULT_ROWS = 100
