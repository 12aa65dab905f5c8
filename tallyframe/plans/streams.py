"""Streaming queries: each runs over everything available and returns what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.operators import conversation, vectors
from tallyframe.plans import star
from tallyframe.plans.dialogue import (
    LIMIT_CALLS, LIMIT_SECONDS, SESSION_COLUMNS, SESSIONS_SQL, limiter_sql, shown_times,
)
from tallyframe.plans.registry import query
from tallyframe.plans.retrieval import _COUNTS, _LETTERS, _POINT_ID, _vector_text
from tallyframe.session import fresh_path
from tallyframe.streaming import jobs, versions
from tallyframe.streaming.run import run_available, run_to_end


def stream(spark, folder, name: str) -> DataFrame:
    schema = star.table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _staged(spark, folder, name: str, purpose: str) -> tuple[str, DataFrame]:
    """A copy of a table that a marker row may be added to, and the stream over it."""
    path = fresh_path(spark, purpose)
    rows = star.table(spark, folder, name)
    rows.write.parquet(path)
    return path, spark.readStream.schema(rows.schema).parquet(path)


_MARKER = {"event_id": -1, "user_id": -1, "event_type": "end"}


@query("sessionize_stream", SESSIONS_SQL + f"select user_id, {SESSION_COLUMNS} from sessions")
def sessionize_stream(spark, folder):
    """The same sessions as over the whole table at once."""
    path, events = _staged(spark, folder, "events", "session-events")
    return shown_times(run_to_end(path, jobs.sessions(events, "user_id", "ts"), "ts", _MARKER))


@query("rate_limit_stream", limiter_sql("user_id", LIMIT_CALLS, LIMIT_SECONDS) + """
    select 'user ' || caller as caller, event_id as call_id, accepted from walk""")
def rate_limit_stream(spark, folder):
    """The same decisions as over the whole table at once; callers are texts."""
    path, events = _staged(spark, folder, "events", "limiter-events")
    named = events.withColumn("caller", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    decided = jobs.limit_calls(named, "caller", "ts", "event_id", max_calls=LIMIT_CALLS, window_seconds=LIMIT_SECONDS)
    return run_to_end(path, decided, "ts", _MARKER)


@query("last_turns_stream", """
    select conv_id, turn, role, md5(text) as digest from (
        select *, row_number() over (partition by conv_id order by turn desc) as back from conversations) where back <= 6""")
def last_turns_stream(spark, folder):
    """Turns arrive out of order: odd ones first, then all of them."""
    path = fresh_path(spark, "turns")
    turns = star.table(spark, folder, "conversations")
    turns.where("turn % 2 = 1").write.parquet(path)
    checkpoint, output = fresh_path(spark, "stream-checkpoint"), fresh_path(spark, "stream-output")
    arriving = jobs.last_turns(spark.readStream.schema(turns.schema).parquet(path))
    run_available(arriving, output, checkpoint, advance_watermark=False)
    turns.write.mode("append").parquet(path)
    kept = jobs.newest_turns(run_available(arriving, output, checkpoint, advance_watermark=False))
    return kept.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


# Views are turns; other events update facts, and two days without either end a conversation.
FACTS_TTL = 2 * 86_400
_FACTS_SQL = f"""
    with given as (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events),
    numbered as (select *, sum(case when before is null or epoch_us(ts) - epoch_us(before) >= {FACTS_TTL * 1_000_000} then 1 else 0 end)
        over (partition by user_id order by ts, event_id) as context from given),
    last_context as (select * from numbered qualify context = max(context) over (partition by user_id)),
    entries as (
        select user_id, ts, event_id, 'last_' || event_type as filter_key, md5(props)[1:6] as filter_value from last_context where event_type <> 'view'
        union all select user_id, ts, event_id, 'kind', event_type from last_context where event_type <> 'view'
        union all select user_id, ts, event_id, 'open', case when event_type = 'error' then null else 'yes' end from last_context where event_type <> 'view')
    select user_id, filter_key, filter_value from entries
    qualify row_number() over (partition by user_id, filter_key order by ts desc, event_id desc) = 1"""


def fact_rows(events: DataFrame) -> DataFrame:
    """Events as turns and updates of facts; a forbidden name and a personal value are among them."""
    kind = F.col("event_type")
    given = F.create_map(
        F.concat(F.lit("last_"), kind), F.substring(F.md5(F.col("props").cast("binary")), 1, 6), F.lit("kind"), kind,
        F.lit("open"), F.when(kind != "error", "yes"), F.lit("SQL"), F.col("props"))
    return events.select("user_id", "ts", "event_id", F.when(kind != "view", given).alias("filters"))


@query("facts_current", _FACTS_SQL)
def facts_current(spark, folder):
    return conversation.current_facts(fact_rows(star.table(spark, folder, "events")), "user_id", "ts", "event_id", "filters", FACTS_TTL)


@query("facts_stream", _FACTS_SQL)
def facts_stream(spark, folder):
    """The same facts from three batches in order of time."""
    path, events = fresh_path(spark, "facts"), star.table(spark, folder, "events")
    events.limit(0).write.parquet(path)
    checkpoint, output = fresh_path(spark, "stream-checkpoint"), fresh_path(spark, "stream-output")
    arriving = jobs.facts(fact_rows(spark.readStream.schema(events.schema).parquet(path)), "user_id", "ts", "event_id", "filters", FACTS_TTL)
    day = F.dayofmonth("ts")
    for part in (day <= 10, (day > 10) & (day <= 20), day > 20):
        events.where(part).write.mode("append").parquet(path)
        run_available(arriving, output, checkpoint, advance_watermark=False)
    return jobs.newest_facts(spark.read.schema(arriving.schema).parquet(output), "user_id")


@query("vec_upsert_stream", f"""
    select {_POINT_ID.format('cast(doc_id as varchar)')} as point_id, cast(doc_id as varchar) as doc_id, {_COUNTS} as vector
    from documents""")
def vec_upsert_stream(spark, folder):
    """A first run stores all but the French documents, English ones in an old wording; a second one, in
    several batches, brings the English ones as they are and the French ones. In between the table is compacted."""
    documents = star.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    path, first, second = fresh_path(spark, "vectors"), fresh_path(spark, "documents"), fresh_path(spark, "documents")
    documents.where("lang <> 'fr'").withColumn("text", F.when(F.col("lang") == "en", "outdated").otherwise(F.col("text"))).write.parquet(first)
    documents.where("lang in ('en', 'fr')").repartition(4, "doc_id").write.parquet(second)

    def prepare(batch: DataFrame) -> DataFrame:
        return vectors.points(
            vectors.embed(batch.select("doc_id", "text"), vectors.LetterCountEmbedder(_LETTERS), "text"), "doc_id", len(_LETTERS), ["doc_id"])

    for run, source in enumerate((first, second)):
        arriving = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", 2).parquet(source)
        jobs.upsert_versions(arriving, prepare, path, run=run, checkpoint=fresh_path(spark, "stream-checkpoint"))
        if run == 0:
            versions.VersionedTable(spark, path, prepare(documents).schema).compact()
    return jobs.current_versions(spark, path).select("point_id", "payload.doc_id", _vector_text("vector").alias("vector"))
