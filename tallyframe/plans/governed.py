"""Governed questions over the four relations: the reviewed analyses, and joins with filters, groups and order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallyframe.operators.governed import (
    All, Arith, Call, Case, Cast, Col, Compare, Extract, Governed, Having, In, IsNull, Join, Lit, Not, Question, Trunc)
from tallyframe.plans import measures, star  # noqa: F401  (the reviewed analyses share the SQL of measures)
from tallyframe.plans.registry import ORACLES, query
from tallyframe.plans.star import CARDS, MCC, TX, USERS, sql


def relations(spark, folder) -> Governed:
    return Governed({
        "transactions": star.transactions(spark, folder), "cards": star.cards(spark, folder),
        "users": star.users(spark, folder), "mcc_codes": star.mcc_codes(spark, folder)})


def _between(column: str, start: datetime, end: datetime) -> All:
    return All((Compare(Col(column), ">=", Lit(start)), Compare(Col(column), "<", Lit(end))))


def _money(value) -> Cast:
    return Cast(value, "decimal(38,2)")


_AMOUNT, _ROWS = Col("t.amount"), Call("COUNT")
_MONTH = Cast(Trunc("month", Col("t.transaction_at")), "date")
_JANUARY = _between("t.transaction_at", datetime(1996, 1, 1), datetime(1996, 2, 1))
_TX = {"relation": "main.transactions", "alias": "t"}
_CATEGORY = Join("transaction_category", "m", "t")
_NET = _money(Call("COALESCE", (Call("SUM", (_AMOUNT,)), Lit(0))))

#: the reviewed analyses, by the name of the query that gives the same rows
REVIEWED: dict[str, Question] = {
    "monthly_net_amount": Question(
        **_TX, select=(("month", _MONTH), ("net_amount", _NET)),
        where=_between("t.transaction_at", datetime(1996, 1, 1), datetime(1997, 1, 1)), order=(("month", False),), limit=100),
    "category_positive_amount": Question(
        **_TX, select=(("mcc", Col("t.mcc")), ("category", Call("COALESCE", (Col("m.description"), Lit("Unknown MCC")))),
                       ("positive_amount_total", _money(Call("SUM", (_AMOUNT,))))),
        joins=(_CATEGORY,), where=Compare(_AMOUNT, ">", Lit(0)), group=(Col("m.description"),),
        order=(("positive_amount_total", True), ("mcc", False)), limit=100),
    "card_type_positive_amount": Question(
        **_TX, select=(("card_type", Call("COALESCE", (Col("c.card_type"), Lit("Unknown card type")))),
                       ("positive_amount_total", _money(Call("SUM", (_AMOUNT,))))),
        joins=(Join("transaction_card", "c", "t"),), where=Compare(_AMOUNT, ">", Lit(0)),
        order=(("positive_amount_total", True), ("card_type", False)), limit=100),
    "customer_net_amount": Question(
        **_TX, select=(("client_id", Col("t.client_id")), ("net_amount", _NET)), order=(("net_amount", True), ("client_id", False)), limit=100),
    "january_error_rate": Question(
        **_TX, select=(
            ("transaction_count", _ROWS), ("error_recorded_count", Call("COUNT", (Col("t.errors"),))),
            ("error_recorded_rate", Arith(Cast(Call("COUNT", (Col("t.errors"),)), "double"), "/", _ROWS))),
        where=_JANUARY),
    "average_income_of_transacting_customers": Question(
        relation="main.users", alias="u", select=(("average_snapshot_yearly_income", Call("AVG", (Col("u.yearly_income"),))),),
        exists=(Having("transaction_customer", "t", "u", _JANUARY),)),
    "count_by_year": Question(
        **_TX, select=(("year", Extract("year", Col("t.transaction_at"))), ("n", _ROWS)), order=(("year", False),), limit=20),
    "avg_limit_by_brand": Question(
        relation="main.cards", alias="c", select=(("card_brand", Col("card_brand")), ("avg_limit", Call("AVG", (Col("credit_limit"),)))),
        order=(("card_brand", False),)),
    "count_filtered": Question(
        relation="main.cards", alias="c", select=(("n", _ROWS),), where=Compare(Col("c.card_brand"), "=", Lit("F"))),
    "category_count_net": Question(
        **_TX, select=(("description", Col("m.description")), ("transaction_count", _ROWS), ("net_amount", _money(Call("SUM", (_AMOUNT,))))),
        joins=(Join("transaction_category", "m", "t", "inner"),), order=(("transaction_count", True), ("description", False)), limit=10),
    "cte_category_count": Question(
        relation=Question(**_TX, select=(("code", Col("t.mcc")), ("n", _ROWS))), alias="x",
        select=(("code", Col("code")), ("n", Col("n"))), order=(("n", True), ("code", False)), limit=5),
}


def _register(name: str, question: Question) -> None:
    @query(f"governed_{name}", ORACLES[name])
    def run(spark, folder):
        return relations(spark, folder).answer(question)


for _name in ("category_positive_amount", "average_income_of_transacting_customers", "cte_category_count"):
    _register(_name, REVIEWED[_name])


_STAR = Question(
    **_TX, joins=(Join("transaction_card", "c", "t", "inner"), Join("card_customer", "u", "c", "inner"), _CATEGORY),
    select=(("segment", Col("u.segment")), ("brand", Call("LOWER", (Col("c.card_brand"),))),
            ("known", Case(((IsNull(Col("m.description")), Lit("no")),), Lit("yes"))),
            ("n", _ROWS), ("codes", Call("COUNT", (Col("t.mcc"),), distinct=True)), ("net_amount", _money(Call("SUM", (_AMOUNT,))))),
    where=All((_between("t.transaction_at", datetime(1994, 1, 1), datetime(1997, 1, 1)), Not(Compare(_AMOUNT, "=", Lit(0))),
               In(Col("c.card_type"), ("1-URGENT", "2-HIGH", "5-LOW")), Compare(Col("u.yearly_income"), ">", Lit(0)))),
    having=Compare(_ROWS, ">=", Lit(2)), order=(("net_amount", True), ("segment", False), ("brand", False), ("known", False)))


@query("governed_star", sql(TX, CARDS, USERS, MCC) + """
    select u.segment, lower(c.card_brand) as brand, case when m.description is null then 'no' else 'yes' end as known,
           cast(count(*) as bigint) as n, cast(count(distinct t.mcc) as bigint) as codes, cast(sum(t.amount) as decimal(38,2)) as net_amount
    from tx t join cards c on t.card_id = c.card_id and t.client_id = c.client_id join users u on c.client_id = u.client_id
    left join mcc m on t.mcc = m.mcc
    where t.transaction_at >= timestamp '1994-01-01' and t.transaction_at < timestamp '1997-01-01' and t.amount <> 0
      and c.card_type in ('1-URGENT', '2-HIGH', '5-LOW') and u.yearly_income > 0
    group by all having count(*) >= 2 order by net_amount desc, segment, brand, known limit 100""")
def governed_star(spark, folder):
    """Three joins, one of them behind another, filters on all sides, groups kept by their size."""
    return relations(spark, folder).answer(_STAR)


_BRANDS = Question(
    relation=Question(
        **_TX, joins=(Join("transaction_card", "c", "t"), Join("transaction_customer", "u", "t")),
        select=(("brand", Col("c.card_brand")), ("segment", Col("u.segment")), ("n", _ROWS), ("total", _money(Call("SUM", (_AMOUNT,)))),
                ("largest", Call("MAX", (_AMOUNT,))), ("average", Call("AVG", (_AMOUNT,)))),
        where=IsNull(Col("t.errors")), having=Compare(_ROWS, ">", Lit(1))),
    alias="g", select=(("brand", Col("g.brand")), ("segments", _ROWS), ("n", Cast(Call("SUM", (Col("g.n"),)), "bigint")), ("total", _money(Call("SUM", (Col("g.total"),)))),
                       ("largest", Cast(Call("MAX", (Col("g.largest"),)), "decimal(18,2)")), ("least_average", Call("MIN", (Col("g.average"),)))),
    order=(("brand", False),))


@query("governed_nested", sql(TX, CARDS, USERS) + """
    select brand, cast(count(*) as bigint) as segments, cast(sum(n) as bigint) as n, cast(sum(total) as decimal(38,2)) as total,
           cast(max(largest) as decimal(18,2)) as largest, min(average) as least_average
    from (select c.card_brand as brand, u.segment, count(*) as n, sum(t.amount) as total, max(t.amount) as largest,
                 cast(sum(t.amount) as double) / nullif(count(t.amount), 0) as average
          from tx t left join cards c on t.card_id = c.card_id and t.client_id = c.client_id left join users u on t.client_id = u.client_id
          where t.errors is null group by 1, 2 having count(*) > 1)
    group by 1 order by 1 limit 100""")
def governed_nested(spark, folder):
    """Totals that are combined before two joins, inside a question over their groups."""
    return relations(spark, folder).answer(_BRANDS).withColumn("least_average", F.col("least_average").cast("double"))
