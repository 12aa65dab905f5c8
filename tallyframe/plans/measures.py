"""Metric, filter and reviewed-analysis queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallyframe.operators import access, joins, metrics
from tallyframe.plans import star
from tallyframe.plans.registry import query
from tallyframe.plans.star import CARD_TX, CARDS, MCC, TX, USERS, sql

_METRIC_SQL = {
    "transaction_count": "cast(count(*) as bigint)",
    "positive_amount_total": "cast(coalesce(sum(case when amount > 0 then amount end), 0) as decimal(38,2))",
    "negative_amount_magnitude": "cast(coalesce(sum(case when amount < 0 then -amount end), 0) as decimal(38,2))",
    "net_amount": "cast(coalesce(sum(amount), 0) as decimal(38,2))",
    "average_positive_amount":
        "cast(sum(case when amount > 0 then amount end) as double) / nullif(count(case when amount > 0 then 1 end), 0)",
    "negative_transaction_count": "cast(count(*) filter (where amount < 0) as bigint)",
    "error_recorded_count": "cast(count(*) filter (where errors is not null) as bigint)",
    "error_recorded_rate":
        "cast(count(*) filter (where errors is not null) as double) / nullif(count(*), 0)",
    "transacting_customer_count": "cast(count(distinct client_id) as bigint)",
}
_YEAR = (datetime(1996, 1, 1), datetime(1997, 1, 1))
_MONTH = (datetime(1996, 1, 1), datetime(1996, 2, 1))
_YEAR_SQL = "transaction_at >= timestamp '1996-01-01' and transaction_at < timestamp '1997-01-01'"
_MONTH_SQL = "transaction_at >= timestamp '1996-01-01' and transaction_at < timestamp '1996-02-01'"


def _between(period: tuple[datetime, datetime]) -> F.Column:
    """Half-open: the end belongs to the next period."""
    start, end = (F.lit(p).cast("timestamp_ntz") for p in period)
    return (F.col("transaction_at") >= start) & (F.col("transaction_at") < end)


def _select(names: list[str]) -> str:
    return ", ".join(f"{_METRIC_SQL[n]} as {n}" for n in names)


def _register_metric(name: str) -> None:
    @query(f"metric_{name}", sql(TX) + f"select {_METRIC_SQL[name]} as {name} from tx")
    def run(spark, folder):
        facts = star.transactions(spark, folder, client=name == "transacting_customer_count")
        return metrics.metrics(facts, [name])


for _name in metrics.METRICS:
    _register_metric(_name)

_ALL = list(metrics.METRICS)


@query("metrics_by_dimension", sql(TX) + f"""
    select cast(date_trunc('month', transaction_at) as date) as month, mcc, transaction_method, {_select(_ALL)}
    from tx group by 1, 2, 3""")
def metrics_by_dimension(spark, folder):
    facts = star.transactions(spark, folder)
    return metrics.metrics_by(
        facts, _ALL, [metrics.month("transaction_at").alias("month"), "mcc", "transaction_method"])


@query("metrics_by_customer", sql(TX) + f"""
    select client_id, year(transaction_at)::bigint as year, {_select(_ALL[:8])} from tx group by 1, 2""")
def metrics_by_customer(spark, folder):
    facts = star.transactions(spark, folder)
    return metrics.metrics_by(
        facts, _ALL[:8], ["client_id", F.year("transaction_at").cast("long").alias("year")])


@query("metric_identity", sql(TX) + f"""
    select *, net_amount = positive_amount_total - negative_amount_magnitude as identity_holds
    from (select {_select(["net_amount", "positive_amount_total", "negative_amount_magnitude"])} from tx)""")
def metric_identity(spark, folder):
    return metrics.identity_holds(star.transactions(spark, folder, client=False))


@query("metrics_empty_population", sql(TX) + f"""
    select {_select(_ALL)} from tx where amount is null or transaction_at < timestamp '1900-01-01'""")
def metrics_empty_population(spark, folder):
    facts = star.transactions(spark, folder).where(
        F.col("amount").isNull() | (F.col("transaction_at") < F.lit(datetime(1900, 1, 1)).cast("timestamp_ntz")))
    return metrics.metrics(facts, _ALL)


@query("filter_half_open", sql(TX) + f"""
    select cast(count(*) as bigint) as row_count, cast(sum(amount) as decimal(38,2)) as net_amount,
           strftime(min(transaction_at), '%Y-%m-%d %H:%M:%S') as first_at,
           strftime(max(transaction_at), '%Y-%m-%d %H:%M:%S') as last_at
    from tx where {_YEAR_SQL}""")
def filter_half_open(spark, folder):
    facts = star.transactions(spark, folder, client=False).where(_between(_YEAR))
    return facts.agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("amount").cast("decimal(38,2)").alias("net_amount"),
        F.date_format(F.min("transaction_at"), "yyyy-MM-dd HH:mm:ss").alias("first_at"),
        F.date_format(F.max("transaction_at"), "yyyy-MM-dd HH:mm:ss").alias("last_at"))


@query("filter_sign", sql(TX) + """
    select case when amount > 0 then 'positive' when amount < 0 then 'negative' else 'zero' end as sign,
           cast(count(*) as bigint) as row_count, cast(sum(amount) as decimal(38,2)) as net_amount from tx group by 1""")
def filter_sign(spark, folder):
    sign = F.when(F.col("amount") > 0, "positive").when(F.col("amount") < 0, "negative").otherwise("zero")
    return star.transactions(spark, folder, client=False).groupBy(sign.alias("sign")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("amount").cast("decimal(38,2)").alias("net_amount"))


@query("filter_error", sql(TX) + """
    select errors is not null as error_recorded, cast(count(*) as bigint) as row_count,
           cast(sum(amount) as decimal(38,2)) as net_amount from tx group by 1""")
def filter_error(spark, folder):
    return star.transactions(spark, folder, client=False).groupBy(
        F.col("errors").isNotNull().alias("error_recorded")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("amount").cast("decimal(38,2)").alias("net_amount"))


@query("filter_category", sql(CARDS) + """
    select card_brand, cast(count(*) as bigint) as row_count, cast(sum(credit_limit) as decimal(38,2)) as credit_limits
    from cards where card_type = '1-URGENT' group by 1""")
def filter_category(spark, folder):
    return star.cards(spark, folder).where(F.col("card_type") == "1-URGENT").groupBy("card_brand").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("credit_limit").cast("decimal(38,2)").alias("credit_limits"))


@query("filter_sentinel", sql(CARD_TX) + """
    select case when merchant_city = 'ONLINE' then 'no place' else merchant_city end as place,
           cast(count(*) as bigint) as row_count from ctx group by 1""")
def filter_sentinel(spark, folder):
    place = F.when(F.col("merchant_city") == "ONLINE", "no place").otherwise(F.col("merchant_city"))
    return star.card_transactions(spark, folder).groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("row_count"))


@query("monthly_net_amount", sql(TX) + f"""
    select cast(date_trunc('month', transaction_at) as date) as month, {_METRIC_SQL["net_amount"]} as net_amount
    from tx where {_YEAR_SQL} group by 1 order by 1 limit 100""")
def monthly_net_amount(spark, folder):
    facts = star.transactions(spark, folder, client=False).where(_between(_YEAR))
    monthly = metrics.metrics_by(facts, ["net_amount"], [metrics.month("transaction_at").alias("month")])
    return access.bounded(monthly.orderBy(F.asc_nulls_last("month")), 100)


@query("category_positive_amount", sql(TX, MCC) + """
    select t.mcc, coalesce(m.description, 'Unknown MCC') as category,
           cast(sum(t.amount) as decimal(38,2)) as positive_amount_total
    from tx t left join mcc m on t.mcc = m.mcc where t.amount > 0
    group by t.mcc, m.description order by positive_amount_total desc nulls last, t.mcc limit 100""")
def category_positive_amount(spark, folder):
    """Sums per code before the lookup, so the join sees one row per code."""
    facts = star.transactions(spark, folder, client=False).where("amount > 0")
    totals = joins.related_totals(
        facts, star.mcc_codes(spark, folder), ["mcc"], [F.col("mcc"), F.col("description")],
        {"positive_amount_total": F.col("amount")})
    named = totals.select("mcc", F.coalesce("description", F.lit("Unknown MCC")).alias("category"),
                          F.col("positive_amount_total").cast("decimal(38,2)").alias("positive_amount_total"))
    return access.bounded(named.orderBy(F.desc_nulls_last("positive_amount_total"), F.asc_nulls_last("mcc")), 100)


@query("card_type_positive_amount", sql(TX, CARDS) + """
    select coalesce(c.card_type, 'Unknown card type') as card_type,
           cast(sum(t.amount) as decimal(38,2)) as positive_amount_total
    from tx t left join cards c on t.card_id = c.card_id and t.client_id = c.client_id
    where t.amount > 0 group by c.card_type order by positive_amount_total desc nulls last, 1 limit 100""")
def card_type_positive_amount(spark, folder):
    facts = star.transactions(spark, folder).where("amount > 0")
    totals = joins.related_totals(
        facts, star.cards(spark, folder).select("card_id", "client_id", "card_type"), ["card_id", "client_id"],
        [F.col("card_type")], {"positive_amount_total": F.col("amount")})
    named = totals.select(F.coalesce("card_type", F.lit("Unknown card type")).alias("card_type"),
                          F.col("positive_amount_total").cast("decimal(38,2)").alias("positive_amount_total"))
    return access.bounded(named.orderBy(F.desc_nulls_last("positive_amount_total"), "card_type"), 100)


@query("customer_net_amount", sql(TX) + f"""
    select client_id, {_METRIC_SQL["net_amount"]} as net_amount from tx
    group by client_id order by net_amount desc, client_id limit 100""")
def customer_net_amount(spark, folder):
    ranked = metrics.metrics_by(star.transactions(spark, folder), ["net_amount"], ["client_id"])
    return access.bounded(ranked.orderBy(F.desc("net_amount"), F.asc_nulls_last("client_id")), 100)


_ERROR_METRICS = ["transaction_count", "error_recorded_count", "error_recorded_rate"]


@query("january_error_rate", sql(TX) + f"select {_select(_ERROR_METRICS)} from tx where {_MONTH_SQL}")
def january_error_rate(spark, folder):
    facts = star.transactions(spark, folder, client=False).where(_between(_MONTH))
    return metrics.metrics(facts, _ERROR_METRICS)


@query("average_income_of_transacting_customers", sql(TX, USERS) + f"""
    select cast(sum(yearly_income) as double) / nullif(count(yearly_income), 0) as average_snapshot_yearly_income
    from users u where exists (select 1 from tx t where t.client_id = u.client_id and {_MONTH_SQL})""")
def average_income_of_transacting_customers(spark, folder):
    active = star.transactions(spark, folder).where(_between(_MONTH))
    entities = joins.with_activity(star.users(spark, folder), active, "client_id")
    return entities.agg(metrics.average(F.col("yearly_income")).alias("average_snapshot_yearly_income"))


@query("count_by_year", sql(TX) + """
    select cast(extract(year from transaction_at) as bigint) as year, cast(count(*) as bigint) as n
    from tx group by 1 order by 1 limit 20""")
def count_by_year(spark, folder):
    year = F.extract(F.lit("year"), F.col("transaction_at")).cast("long").alias("year")
    counted = star.transactions(spark, folder, client=False).groupBy(year).agg(F.count(F.lit(1)).alias("n"))
    return access.bounded(counted.orderBy(F.asc_nulls_last("year")), 20)


@query("avg_limit_by_brand", sql(CARDS) + """
    select card_brand, cast(sum(credit_limit) as double) / nullif(count(credit_limit), 0) as avg_limit
    from cards group by 1 order by 1 limit 100""")
def avg_limit_by_brand(spark, folder):
    grouped = star.cards(spark, folder).groupBy("card_brand").agg(
        metrics.average(F.col("credit_limit")).alias("avg_limit"))
    return access.bounded(grouped.orderBy(F.asc_nulls_last("card_brand")))


@query("count_filtered", sql(CARDS) + """
    select cast(count(*) as bigint) as n from cards where (card_brand = 'F') = true""")
def count_filtered(spark, folder):
    has_chip = (F.col("card_brand") == "F").alias("has_chip")
    return star.cards(spark, folder).select(has_chip).where("has_chip = true").agg(F.count(F.lit(1)).alias("n"))


@query("category_count_net", sql(TX, MCC) + """
    select m.description, cast(count(*) as bigint) as transaction_count, cast(sum(t.amount) as decimal(38,2)) as net_amount
    from tx t join mcc m on t.mcc = m.mcc group by 1 order by transaction_count desc, description limit 10""")
def category_count_net(spark, folder):
    facts = star.transactions(spark, folder, client=False)
    totals = joins.related_totals(
        facts, star.mcc_codes(spark, folder), ["mcc"], [F.col("description")],
        {"transaction_count": F.lit(1), "net_amount": F.col("amount")}, "inner")
    top = totals.orderBy(F.desc("transaction_count"), "description")
    return access.bounded(top.withColumn("net_amount", F.col("net_amount").cast("decimal(38,2)")), 10)


@query("cte_category_count", sql(TX) + """
    select code, n from (select mcc as code, cast(count(*) as bigint) as n from tx group by mcc)
    order by n desc, code limit 5""")
def cte_category_count(spark, folder):
    counted = star.transactions(spark, folder, client=False).groupBy(F.col("mcc").alias("code")).agg(
        F.count(F.lit(1)).alias("n"))
    return access.bounded(counted.orderBy(F.desc("n"), "code"), 5)


@query("scalar_allowlist", sql(TX) + """
    select lower(transaction_method) as lower_method, upper(coalesce(errors, 'none')) as upper_error,
           cast(date_trunc('quarter', transaction_at) as date) as quarter,
           cast(extract(month from transaction_at) as bigint) as month_number,
           cast(count(*) as bigint) as n, cast(count(distinct mcc) as bigint) as codes,
           cast(max(abs(amount)) as decimal(38,2)) as largest, min(mcc) as first_code,
           cast(sum(floor(amount)) as bigint) as floors, cast(sum(ceil(amount)) as bigint) as ceilings,
           cast(sum(amount) as double) / nullif(count(amount), 0) as average,
           cast(sum(round(amount, 1)) as decimal(38,2)) as rounded,
           cast(sum(case when amount > 0 then 1 else 0 end) as bigint) as positives,
           cast(count(nullif(merchant_id, 1)) as bigint) as other_merchants
    from tx group by 1, 2, 3, 4""")
def scalar_allowlist(spark, folder):
    call = access.call
    amount = F.col("amount")
    facts = star.transactions(spark, folder, client=False)
    return facts.groupBy(
        call("LOWER", F.col("transaction_method")).alias("lower_method"),
        call("UPPER", call("COALESCE", F.col("errors"), F.lit("none"))).alias("upper_error"),
        call("CAST", call("TIMESTAMP_TRUNC", "quarter", F.col("transaction_at")), "date").alias("quarter"),
        call("EXTRACT", "month", F.col("transaction_at")).alias("month_number"),
    ).agg(
        call("COUNT", F.lit(1)).alias("n"), call("COUNT_DISTINCT", F.col("mcc")).alias("codes"),
        call("MAX", call("ABS", amount)).cast("decimal(38,2)").alias("largest"),
        call("MIN", F.col("mcc")).alias("first_code"),
        call("SUM", call("FLOOR", amount)).cast("long").alias("floors"),
        call("SUM", call("CEIL", amount)).cast("long").alias("ceilings"),
        call("AVG", amount).alias("average"),
        call("SUM", call("ROUND", amount, 1)).cast("decimal(38,2)").alias("rounded"),
        call("SUM", call("IF", call("CASE", amount > 0, True).otherwise(False), F.lit(1), F.lit(0))).alias("positives"),
        call("COUNT", call("NULLIF", F.col("merchant_id"), F.lit(1))).alias("other_merchants"),
    )
