"""Conversation state as keyed batch operators.

A conversation or caller may hold a large share of all rows, so none of these sorts a whole
key in one task without first cutting it down: by top-n before the shuffle, by time slots,
or by slices of the turn order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions.text import sanitise_filters

TTL_SECONDS = 1800
MAX_TURNS = 6
MAX_QUESTIONS = 3
_SLICE = 1024


def sessions(events: DataFrame, key: str, time: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """``(key, session_no, started_at, last_at, n_events)``; a gap of the TTL or more starts a new session.

    Events of one key in the same TTL-wide slot always share a session, so the first step is a
    plain map-side-combined aggregate. Only slot rows are ordered, and their number depends on
    the time covered, not on how many events a key has.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    ttl = ttl_seconds * 1_000_000
    slots = events.groupBy(key, F.floor(micros / ttl).alias("_slot")).agg(
        F.min(micros).alias("_first"), F.max(micros).alias("_last"), F.count(F.lit(1)).alias("_n"))
    window = Window.partitionBy(key).orderBy("_slot")
    starts = F.when(F.col("_first") - F.lag("_last").over(window) < ttl, 0).otherwise(1)
    numbered = slots.withColumn("_starts", starts).withColumn(
        "session_no", F.sum("_starts").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session_no").agg(
        F.timestamp_micros(F.min("_first")).cast("timestamp_ntz").alias("started_at"),
        F.timestamp_micros(F.max("_last")).cast("timestamp_ntz").alias("last_at"),
        F.sum("_n").alias("n_events"),
    )


def last_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn", n: int = MAX_TURNS) -> DataFrame:
    """The last ``n`` turns per conversation; Spark applies the cut before the shuffle as well."""
    window = Window.partitionBy(key).orderBy(F.desc(order))
    return turns.withColumn("_back", F.row_number().over(window)).where(F.col("_back") <= n).drop("_back")


def previous_rows(
    df: DataFrame, key: str, order: str, value: Column, n: int, name: str, slice_size: int = _SLICE,
) -> DataFrame:
    """Add ``name``: the values of up to ``n`` preceding rows of the key, oldest first.

    The key's integer order is cut into slices; a row looks back within its slice, and into
    the tails of earlier slices through a small table with one row per slice.
    """
    # wrapped, because a list of bare values would leave out nulls and so look back too far
    sliced = df.withColumn("_slice", F.floor(F.col(order) / slice_size)).withColumn("_value", F.struct(value.alias("v")))
    inside = Window.partitionBy(key, "_slice").orderBy(order)
    near = sliced.withColumn("_near", F.collect_list("_value").over(inside.rowsBetween(-n, -1)))
    back = Window.partitionBy(key, "_slice").orderBy(F.desc(order))
    tails = (
        sliced.select(key, "_slice", order, "_value")
        .withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n)
        .groupBy(key, "_slice")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "_value"))), lambda r: r["_value"]).alias("_tail"))
    )
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(-n, -1)
    halo = tails.select(key, "_slice", F.flatten(F.collect_list("_tail").over(before)).alias("_halo"))
    both = F.concat(F.coalesce("_halo", F.array().cast(near.schema["_near"].dataType)), F.col("_near"))
    recent = F.transform(F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), n), lambda r: r["v"])
    return near.join(halo, [key, "_slice"], "left").withColumn(name, recent).select(*df.columns, name)


def recent_questions(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """For every user turn: the user questions among the six turns before it, at most three, oldest first.

    ``previous_question`` is the most recent of them.
    """
    # only questions are carried along; the texts of other turns are not needed to look back
    question = F.struct((F.col(role) == "user").alias("asked"), F.when(F.col(role) == "user", F.col(text)).alias("text"))
    seen = previous_rows(turns, key, order, question, MAX_TURNS, "_seen")
    asked = F.transform(F.filter("_seen", lambda t: t["asked"]), lambda t: t["text"])
    kept = seen.where(F.col(role) == "user").withColumn("_asked", asked)
    recent = F.slice("_asked", F.greatest(F.size("_asked") - MAX_QUESTIONS + 1, F.lit(1)), MAX_QUESTIONS)
    return kept.withColumn("recent_questions", recent).withColumn(
        "previous_question", F.try_element_at("recent_questions", F.lit(-1))).drop("_seen", "_asked")


def merge_filters(turns: DataFrame, key: str, order: str, filters: str) -> DataFrame:
    """``(key, filter_key, filter_value)`` after all turns: a later turn overrides an earlier one.

    Folding maps in order equals taking, per filter, the value of the last turn that sets it,
    which combines map-side instead of walking a conversation row by row.
    """
    entries = turns.select(key, order, F.explode(filters).alias("filter_key", "filter_value"))
    # wrapped, because max_by skips nothing but a bare NULL value must also be able to win
    last = entries.groupBy(key, "filter_key").agg(F.max_by(F.struct("filter_value"), order).alias("_last"))
    return last.select(key, "filter_key", F.col("_last.filter_value").alias("filter_value"))


def current_facts(rows: DataFrame, key: str, time: str, order: str, filters: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """``(key, filter_key, filter_value)``: the facts of each conversation since it last expired.

    Rows are turns (null filters) and updates of facts; both put the expiry off, which a gap of the TTL reaches.
    The last session is found from slot rows, so no conversation is walked row by row.
    """
    started = sessions(rows, key, time, ttl_seconds).groupBy(key).agg(F.max("started_at").alias("_since"))
    names = {key: "_key"}
    since = started.withColumnsRenamed(names)
    inside = rows.join(since, F.col(key) == F.col("_key")).where(F.col(time).cast("timestamp_ntz") >= F.col("_since"))
    updates = inside.where(F.col(filters).isNotNull()).select(key, F.struct(time, order).alias("_order"), sanitise_filters(F.col(filters)).alias("_filters"))
    return merge_filters(updates, key, "_order", "_filters")
