"""Conversation, limiter and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.operators import conversation, evaluate, ratelimit
from tallyframe.plans import star
from tallyframe.plans.registry import query
from tallyframe.session import fresh_path

_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"

SESSIONS_SQL = f"""
    with gaps as (
        select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) < 1800000000 then 0 else 1 end as starts
        from events window w as (partition by user_id order by ts)),
    numbered as (select *, sum(starts) over (partition by user_id order by ts) as session_no from gaps),
    sessions as (
        select user_id, cast(session_no as bigint) as session_no, min(ts) as first_at, max(ts) as last_at,
               cast(count(*) as bigint) as n_events from numbered group by 1, 2)"""
SESSION_COLUMNS = f"{_TS.format('first_at')} as started_at, {_TS.format('last_at')} as last_at, n_events"


def shown_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("started_at", "last_at")})


@query("sessionize", SESSIONS_SQL + f"select user_id, session_no, {SESSION_COLUMNS} from sessions")
def sessionize(spark, folder):
    return shown_times(conversation.sessions(star.table(spark, folder, "events"), "user_id", "ts"))


@query("last_turns", """
    select conv_id, turn, role, md5(text) as digest from (
        select *, row_number() over (partition by conv_id order by turn desc) as back from conversations) where back <= 6""")
def last_turns(spark, folder):
    turns = conversation.last_turns(star.table(spark, folder, "conversations"))
    return turns.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("recent_questions", """
    with seen as (
        select *, list({'role': role, 'text': text}) over (
            partition by conv_id order by turn rows between 6 preceding and 1 preceding) as earlier from conversations),
    asked as (
        select *, list_transform(list_filter(coalesce(earlier, []), lambda t: t.role = 'user'), lambda t: md5(t.text)) as questions
        from seen where role = 'user')
    select conv_id, turn, coalesce(array_to_string(questions[-3:], ','), '') as recent, questions[-1] as previous_question
    from asked""")
def recent_questions(spark, folder):
    recent = conversation.recent_questions(star.table(spark, folder, "conversations"))
    digest = F.transform("recent_questions", lambda t: F.md5(t.cast("binary")))
    return recent.select("conv_id", "turn", F.array_join(digest, ",").alias("recent"),
                         F.md5(F.col("previous_question").cast("binary")).alias("previous_question"))


@query("facts_merge", """
    with entries as (
        select user_id, event_id, 'last_' || event_type as filter_key, props as filter_value from events
        union all select user_id, event_id, 'kind', event_type from events
        union all select user_id, event_id, 'open', case when event_type = 'view' then null else 'yes' end from events)
    select user_id, filter_key, filter_value from (
        select *, row_number() over (partition by user_id, filter_key order by event_id desc) as back from entries) where back = 1""")
def facts_merge(spark, folder):
    filters = F.create_map(
        F.concat(F.lit("last_"), "event_type"), F.col("props"), F.lit("kind"), F.col("event_type"),
        F.lit("open"), F.when(F.col("event_type") != "view", "yes"))
    turns = star.table(spark, folder, "events").select("user_id", "event_id", filters.alias("filters"))
    return conversation.merge_filters(turns, "user_id", "event_id", "filters")


# Two accepted calls per caller and day: the decision folds over the caller's calls in order.
LIMIT_CALLS, LIMIT_SECONDS = 2, 86_400


def limiter_sql(caller: str, max_calls: int, seconds: int) -> str:
    return f"""
    with recursive calls as (
        select {caller} as caller, event_id, epoch_us(ts) as at_us,
               row_number() over (partition by {caller} order by ts, event_id) as n from events),
    walk as (
        select caller, event_id, n, at_us, true as accepted, [at_us] as hits from calls where n = 1
        union all
        select c.caller, c.event_id, c.n, c.at_us, len(h.kept) < {max_calls},
               case when len(h.kept) < {max_calls} then list_append(h.kept, c.at_us) else h.kept end
        from (select w.caller, w.n, list_filter(w.hits, lambda t: k.at_us - t < {seconds * 1_000_000}) as kept
              from walk w join calls k on k.caller = w.caller and k.n = w.n + 1) h
        join calls c on c.caller = h.caller and c.n = h.n + 1)"""


@query("rate_limit", limiter_sql("user_id", LIMIT_CALLS, LIMIT_SECONDS) + """
    select caller as user_id, event_id, accepted from walk""")
def rate_limit(spark, folder):
    return ratelimit.limit_calls(
        star.table(spark, folder, "events"), "user_id", "ts", "event_id", max_calls=LIMIT_CALLS, window_seconds=LIMIT_SECONDS)


# ---- evaluation: one case and one result per event

_CASES = """
    cases as (
        select cast(event_id as varchar) as id, event_type, user_id % 5 as u, value > 10 as high from events)"""


def _cases(spark, folder) -> DataFrame:
    user = F.col("user_id") % 5
    events = star.table(spark, folder, "events")
    return events.select(
        F.col("event_id").cast("string").alias("id"), F.lit("proxy").alias("suite"), F.lit("v1").alias("semantic_version"),
        F.lit("g1").alias("graph_version"), F.col("props").alias("question"),
        F.when(F.col("event_type") == "error", "abstain").otherwise("answered").alias("expected_route"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("max_executions"), F.lit(2).alias("max_repairs"),
        F.when(user == 1, F.array(F.lit("guard"), F.lit("plan"))).alias("expected_specialist_path"),
        F.when(user == 2, F.array(F.lit("a"), F.lit("b"))).alias("approved_suggested_questions"),
        F.when(user == 3, F.col("event_type")).alias("expected_result_digest"),
        F.when(user == 3, F.lit("{}")).alias("expected_grounding"),
        F.when(user == 4, F.array(F.create_map(F.lit("source_hash"), F.lit("x")))).alias("expected_citations"),
        F.when(user == 4, F.array(F.lit("zipcode"))).alias("forbidden_citation_metadata"),
    )


def _results(spark, folder) -> DataFrame:
    events = star.table(spark, folder, "events")
    kind, high = F.col("event_type"), F.col("value") > 10
    citation = F.create_map(
        F.lit("source_hash"), F.when(kind == "view", "y").otherwise("x"), F.when(high, "zipcode").otherwise("title"), F.lit("t"))
    path = F.when(kind == "view", F.array(F.lit("guard"))).when(kind != "click", F.array(F.lit("guard"), F.lit("plan")))
    suggested = F.when(high, F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("a")))
    return events.where(kind != "signup").select(
        F.col("event_id").cast("string").alias("id"), F.when(high, "answered").otherwise("abstain").alias("route"),
        F.when(kind == "purchase", 2).alias("executions"), F.when(kind == "click", 3).alias("repairs"),
        F.when(high, "select 1").alias("sql"), path.alias("specialist_path"), suggested.alias("suggested_questions"),
        F.when(high, kind).alias("result_digest"), F.lit("{}").alias("grounding"),
        F.when(kind == "purchase", F.array(citation, citation)).otherwise(F.array(citation)).alias("citations"),
    )


_FAILURES = """,
    judged as (
        select *, event_type = 'signup' as missing, event_type = 'error' as blocked,
               case when event_type = 'signup' then null when high then 'answered' else 'abstain' end as route,
               event_type <> 'signup' and high as has_sql from cases),
    failures as (
        select id, 'unexpected route' as failure from judged
            where route is distinct from case when blocked then 'abstain' else 'answered' end
        union all select id, 'execution budget exceeded' from judged
            where case when event_type = 'purchase' then 2 when has_sql then 1 else 0 end > case when blocked then 0 else 1 end
        union all select id, 'blocked route returned SQL' from judged where blocked and has_sql
        union all select id, 'repair budget exceeded' from judged where event_type = 'click'
        union all select id, 'specialist path was not exposed' from judged where u = 1 and event_type in ('click', 'signup')
        union all select id, 'unexpected specialist path' from judged where u = 1 and event_type = 'view'
        union all select id, 'unapproved suggested questions' from judged where u = 2 and high and not missing
        union all select id, 'more than three suggested questions' from judged where u = 2 and high and not missing
        union all select id, 'result digest did not match' from judged where u = 3 and (missing or not high)
        union all select id, 'grounding did not match' from judged where u = 3 and missing
        union all select id, 'unexpected number of citations' from judged where u = 4 and (missing or event_type = 'purchase')
        union all select id, 'citation metadata did not match' from judged where u = 4 and event_type = 'view'
        union all select id, 'citation exposed forbidden metadata' from judged, (values (1), (2)) as c(n)
            where u = 4 and high and not missing and (n = 1 or event_type = 'purchase'))"""


@query("eval_load", "with" + _CASES + """
    select id, array_to_string(list_filter(
        [case when event_type = 'click' then 'suite' end, case when event_type in ('click', 'view') then 'question' end],
        lambda f: f is not null), ',') as missing from cases where event_type in ('click', 'view')""")
def eval_load(spark, folder):
    """Cases without all required fields, with the names of what is missing."""
    kind = F.col("kind")
    cases = _cases(spark, folder).join(
        star.table(spark, folder, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind")), "id")
    broken = cases.withColumn("suite", F.when(kind != "click", F.col("suite"))).withColumn(
        "question", F.when(~kind.isin("click", "view"), F.col("question"))).drop("kind")
    path = fresh_path(spark, "cases")
    # one JSON list per line of a text file: case files are lists
    broken.select(F.concat(F.lit("["), F.to_json(F.struct("*")), F.lit("]")).alias("value")).write.text(path)
    return evaluate.missing_fields(evaluate.case_rows(spark, path)).select("id", F.array_join("missing", ",").alias("missing"))


@query("eval_cases", "with" + _CASES + _FAILURES + "select id, failure from failures")
def eval_cases(spark, folder):
    return evaluate.failures(_cases(spark, folder), _results(spark, folder))


@query("eval_report", "with" + _CASES + _FAILURES + """
    select (select cast(count(*) as bigint) from cases) as total,
           (select cast(count(*) as bigint) from cases) - cast(count(distinct id) as bigint) as passed,
           cast(count(distinct id) as bigint) as failed, cast(count(*) as bigint) as failures from failures""")
def eval_report(spark, folder):
    return evaluate.report(_cases(spark, folder), _results(spark, folder))


@query("eval_citations", """
    with answers as (
        select event_type, user_id % 3 = 0 as unanswerable, value > 10 as both_cited, value > 20 as correct,
               event_type <> 'error' as routed from events)
    select cast(count(*) filter (where not unanswerable) as bigint) as answerable,
           cast(count(*) filter (where not unanswerable and routed) as bigint) as routed,
           cast(count(*) filter (where not unanswerable and both_cited) as bigint) as all_sources_cited,
           cast(count(*) filter (where not unanswerable and routed and correct) as bigint) as judged_correct,
           cast(count(*) filter (where unanswerable) as bigint) as unanswerable,
           cast(count(*) filter (where unanswerable and event_type = 'view') as bigint) as cited_nothing from answers""")
def eval_citations(spark, folder):
    events = star.table(spark, folder, "events")
    unanswerable = F.col("user_id") % 3 == 0
    kind = F.col("event_type")
    answers = events.select(
        F.when(~unanswerable, F.array(F.lit("a"), F.lit("b"))).alias("expected"),
        F.when(unanswerable & (kind == "view"), F.array().cast("array<string>"))
        .when(F.col("value") > 10, F.array(F.lit("b"), F.lit("c"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("cited"),
        F.when(kind != "error", F.array(F.lit("guard"), F.lit("document_retrieval"))).otherwise(F.array(F.lit("guard")))
        .alias("specialist_path"), (F.col("value") > 20).alias("correct"))
    return evaluate.answer_tallies(answers)
