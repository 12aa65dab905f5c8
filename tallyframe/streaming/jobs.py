"""Streaming twins of the stateful operators.

Each takes a streaming DataFrame and returns one, except the upsert, which writes. A session's state
is three numbers and a conversation's six turns; a limiter keeps the accepted times of one window, and all
calls that the watermark has not passed, which after a pause of the stream is the whole backlog.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyframe.functions.text import redact_turn, sanitise_filters
from tallyframe.operators.conversation import MAX_TURNS, TTL_SECONDS
from tallyframe.operators.ratelimit import MAX_CALLS, WINDOW_SECONDS, decide_all
from tallyframe.streaming.versions import VersionedTable

DELAY_SECONDS = 600


def sessions(events: DataFrame, key: str, time: str, ttl_seconds: int = TTL_SECONDS, delay_seconds: int = DELAY_SECONDS) -> DataFrame:
    """Sessions once the watermark has passed their end; a gap of exactly the TTL splits.

    Spark merges events exactly one gap apart, so the gap is one microsecond short of the TTL.
    """
    gap = f"{ttl_seconds - 1} seconds 999999 microseconds"
    timed = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", f"{delay_seconds} seconds")
    grouped = timed.groupBy(key, F.session_window("_at", gap).alias("_session")).agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count(F.lit(1)).alias("n_events"))
    return grouped.select(
        key, F.col("_first").cast("timestamp_ntz").alias("started_at"),
        F.col("_last").cast("timestamp_ntz").alias("last_at"), "n_events")


#: calls of one caller that are stored and read together
RUN_CALLS = 4096


class _Limiter(StatefulProcessor):
    """Calls wait in sorted runs until the watermark has passed them.

    A run is stored under its first time, so what is over is read in order, each run once, and only runs that
    overlap are held together. A caller has one timer, at the end of the slot of its first waiting call; what the
    watermark has not passed by then is stored again, at most the calls of the time by which it lags.
    """

    def __init__(self, max_calls: int, window: int, slot: int, call_type: str):
        self.max_calls, self.window, self.slot, self.call_type = max_calls, window, slot, call_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getValueState("hits", "at array<long>")
        self.waiting = handle.getMapState("waiting", "first long, number long", f"at array<long>, id array<{self.call_type}>")
        # when the timer rings, and how many runs the caller has had
        self.plan = handle.getValueState("plan", "due long, runs long")

    def _store(self, calls: list[tuple], runs: int) -> int:
        """Put sorted calls away; the number of runs so far."""
        for start in range(0, len(calls), RUN_CALLS):
            at, ids = zip(*calls[start:start + RUN_CALLS])
            self.waiting.updateValue((at[0], runs), (list(at), list(ids)))
            runs += 1
        return runs

    def _wake(self, first: int, due: int, runs: int) -> None:
        """Set the timer for the first waiting call, unless it rings earlier (-1: it is not set)."""
        wake = (first // self.slot + 1) * self.slot // 1000
        if due < 0 or wake < due:
            if due >= 0:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(wake)
            due = wake
        self.plan.update((due, runs))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            calls = sorted(zip(chunk["micros"].astype(object).map(int), chunk["call_id"].astype(object).map(_bare)))
            due, runs = map(int, self.plan.get()) if self.plan.exists() else (-1, 0)
            self._wake(calls[0][0], due, self._store(calls, runs))
        yield _decisions([], [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        keys = sorted((int(first), int(number)) for first, number in self.waiting.keys())
        over = [k for k in keys if k[0] < passed]
        hits = deque(self.hits.get()[0] if self.hits.exists() else [])
        held: list[tuple] = []
        for k, following in zip(over, [*over[1:], (passed, 0)]):
            at, ids = self.waiting.getValue(k)
            self.waiting.removeKey(k)
            for call in zip(map(int, at), ids):
                heapq.heappush(held, call)
            ready = []
            while held and held[0][0] < following[0]:
                ready.append(heapq.heappop(held))
            if ready:
                accepted = decide_all(hits, np.array([at for at, _ in ready]), self.max_calls, self.window)
                yield _decisions([key[0]] * len(ready), [call for _, call in ready], accepted.tolist())
        self.hits.update(([int(h) for h in hits],))
        runs = self._store(sorted(held), int(self.plan.get()[1]))
        left = [k[0] for k in keys[len(over):]] + [call[0] for call in held]
        if left:
            self._wake(min(left), -1, runs)
        else:
            self.plan.update((-1, runs))

    def close(self) -> None:
        pass


def _decisions(callers: list, ids: list, accepted: list[bool]) -> pd.DataFrame:
    # plain objects, whatever the types of callers and calls
    return pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in (("caller", callers), ("call_id", ids), ("accepted", accepted))})


def _bare(value):
    return value.item() if hasattr(value, "item") else value


def limit_calls(
    calls: DataFrame, caller: str, time: str, call_id: str, *,
    max_calls: int = MAX_CALLS, window_seconds: int = WINDOW_SECONDS, delay_seconds: int = DELAY_SECONDS,
) -> DataFrame:
    """``(caller, call_id, accepted)`` in event-time order, as the watermark passes the calls.

    Callers and calls keep their types. A decision comes once the watermark has passed the call's
    slot, which is as long as the watermark lags.
    """
    kinds = [calls.schema[c].dataType.simpleString() for c in (caller, call_id)]
    timed = calls.select(
        F.col(caller).alias("caller"), F.col(call_id).alias("call_id"), F.col(time).cast("timestamp").alias("called_at"),
    ).withWatermark("called_at", f"{delay_seconds} seconds").withColumn("micros", F.unix_micros("called_at"))
    return timed.groupBy("caller").transformWithStateInPandas(
        statefulProcessor=_Limiter(max_calls, window_seconds * 1_000_000, delay_seconds * 1_000_000, kinds[1]),
        outputStructType=f"caller {kinds[0]}, call_id {kinds[1]}, accepted boolean", outputMode="Append", timeMode="EventTime")


class _LastTurns(StatefulProcessor):
    def __init__(self, n: int, ttl_ms: int):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState(
            "kept", "turn array<long>, role array<string>, text array<string>, updates long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *held, updates = self.kept.get() if self.kept.exists() else ([], [], [], 0)
        kept = {t[0]: t for t in zip(*held)}
        for chunk in rows:  # a turn that comes again replaces itself
            kept |= {int(t): (int(t), r, x) for t, r, x in zip(chunk["turn"], chunk["role"], chunk["text"])}
            kept = {t: kept[t] for t in sorted(kept)[-self.n:]}
        turn, role, text = (list(c) for c in zip(*kept.values()))
        self.kept.update((turn, role, text, int(updates) + 1))
        yield pd.DataFrame({"conversation": [key[0]], "update": [int(updates) + 1], "turns": [
            [{"turn": t, "role": r, "text": x} for t, r, x in kept.values()]]})

    def close(self) -> None:
        pass


_TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def last_turns(turns: DataFrame, n: int = MAX_TURNS, ttl_seconds: int = TTL_SECONDS, conversation: str = "conv_id") -> DataFrame:
    """``(conversation, update, turns)``: the last redacted turns of every conversation that changed, and how often it did."""
    redacted = turns.select(F.col(conversation).alias("conversation"), "turn", "role", redact_turn(F.col("text")).alias("text"))
    kind = redacted.schema["conversation"].dataType.simpleString()
    return redacted.groupBy("conversation").transformWithStateInPandas(
        statefulProcessor=_LastTurns(n, ttl_seconds * 1000),
        outputStructType=f"conversation {kind}, update long, turns {_TURNS}", outputMode="Append", timeMode="ProcessingTime")


def newest_turns(output: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """One row per turn of the latest update of every conversation, from everything ``last_turns`` wrote."""
    newest = output.groupBy("conversation").agg(F.max_by("turns", "update").alias("turns"))
    return newest.select(F.col("conversation").alias(conversation), F.inline("turns"))


class _Facts(StatefulProcessor):
    """A conversation's facts and when they expire. Every row puts the end off; one that comes at or after it finds nothing."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        # what nobody writes to for the same time of the clock is dropped as well
        self.kept = handle.getValueState("kept", "names array<string>, held array<string>, expires long, updates long", self.ttl // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, held, expires, updates = self.kept.get() if self.kept.exists() else ([], [], 0, 0)
        facts = dict(zip(names, held))
        arrived = [r for chunk in rows for r in zip(chunk["micros"].astype(object), chunk["position"].astype(object), chunk["names"], chunk["held"])]
        for micros, _, given, values in sorted(arrived, key=lambda r: r[:2]):
            if int(micros) >= expires:
                facts = {}
            facts |= {} if given is None else dict(zip(given, values))
            expires = max(int(expires), int(micros) + self.ttl)
        self.kept.update((list(facts), list(facts.values()), int(expires), int(updates) + 1))
        yield pd.DataFrame({"conversation": [key[0]], "update": [int(updates) + 1], "facts": [[{"filter_key": k, "filter_value": v} for k, v in facts.items()]]})

    def close(self) -> None:
        pass


_FACTS = "array<struct<filter_key:string,filter_value:string>>"


def facts(rows: DataFrame, conversation: str, time: str, order: str, filters: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """``(conversation, update, facts)`` of every conversation that changed.

    A row is a turn (null ``filters``) or an update of facts (a map); either extends the conversation by the TTL from its
    own time. Later values override earlier ones, also by null; a row exactly one TTL after the last
    one starts anew. Rows of one batch go by time and ``order``; across batches a conversation's rows arrive in order.
    """
    given = sanitise_filters(F.col(filters))
    entered = rows.select(F.col(conversation).alias("conversation"), F.unix_micros(F.col(time).cast("timestamp")).alias("micros"), F.col(order).alias("position"),
                          F.map_keys(given).alias("names"), F.map_values(given).alias("held"))
    kind = entered.schema["conversation"].dataType.simpleString()
    return entered.groupBy("conversation").transformWithStateInPandas(
        statefulProcessor=_Facts(ttl_seconds), outputStructType=f"conversation {kind}, update long, facts {_FACTS}", outputMode="Append", timeMode="ProcessingTime")


def newest_facts(output: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """``(conversation, filter_key, filter_value)`` of the latest update, from everything ``facts`` wrote."""
    newest = output.groupBy("conversation").agg(F.max_by("facts", "update").alias("facts"))
    return newest.select(F.col("conversation").alias(conversation), F.inline("facts"))


def upsert_versions(
    documents: DataFrame, prepare: Callable[[DataFrame], DataFrame], path: str, *, run: int, checkpoint: str,
    on_batch: Callable[[int], None] | None = None,
) -> None:
    """Append every micro-batch as a new version; no stored row is rewritten.

    A version is the number of the run and of its batch, so later runs win over earlier ones. A run is
    one stream with one checkpoint: continued after a failure it repeats the interrupted batch in its own
    folder, and neither loses nor doubles rows. A run number that is used again with another checkpoint
    writes beside the first, never over it. ``on_batch`` receives the running number of rows stored by the run.
    """
    spark = documents.sparkSession
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    stored = {}

    def store(batch: DataFrame, number: int) -> None:
        folder = f"{path}/version={run * 1_000_000_000 + number}/writer={writer}"
        prepare(batch).write.mode("overwrite").parquet(folder)
        if on_batch:
            stored[number] = spark.read.parquet(folder).count()
            on_batch(sum(stored.values()))

    query = (
        documents.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def current_versions(spark: SparkSession, path: str, key: str = "point_id") -> DataFrame:
    """The newest version of every key, from the base that the last compaction made and the batches since."""
    schema = spark.read.option("basePath", path).parquet(f"{path}/version=*").schema
    return VersionedTable(spark, path, schema, key).rows()
