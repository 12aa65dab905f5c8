"""Sliding-window limiter over recorded calls.

At most ``max_calls`` accepted calls per caller in any window; rejected calls do not count,
so each decision depends on earlier decisions. Three steps keep that exact without putting
a caller's whole history in one task:

1. Time slots as wide as the window are counted. Where two neighbouring slots together hold
   no more calls than the limit, every call in them is accepted whatever came before.
2. A gap of a full window empties the state, so what remains falls into independent bursts.
3. Remaining calls are range-partitioned by (caller, burst, time), which also splits one huge
   burst over many tasks. Each task decides its range given the state at its start; states are
   passed from range to range until they no longer change.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tallyframe.session import fresh_path

MAX_CALLS = 10
WINDOW_SECONDS = 60


def decide(hits: deque, at: int, max_calls: int, window: int) -> bool:
    """One decision; ``hits`` are the accepted times still inside the window."""
    while hits and at - hits[0] >= window:
        hits.popleft()
    if len(hits) >= max_calls:
        return False
    hits.append(at)
    return True


def decide_all(hits: deque, times: np.ndarray, max_calls: int, window: int) -> np.ndarray:
    """Decisions for calls of one burst in order; refused calls are jumped over, so the work follows the accepted ones."""
    accepted, i = np.zeros(len(times), dtype=bool), 0
    while i < len(times):
        at = int(times[i])
        if decide(hits, at, max_calls, window):
            accepted[i] = True
            i += 1
        else:
            i = max(i + 1, int(np.searchsorted(times, hits[0] + window)))
    return accepted


def _bare(value):
    return value.item() if isinstance(value, np.generic) else value


def _bursts(calls: DataFrame, caller: str, time: str, max_calls: int, window: int) -> DataFrame:
    """Calls with their burst and whether the burst can reach the limit at all."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    slotted = calls.withColumn("_at", at).withColumn("_slot", F.floor(F.col("_at") / window))
    slots = slotted.groupBy(caller, "_slot").agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(caller).orderBy("_slot")
    adjacent = F.lag("_slot").over(order) == F.col("_slot") - 1
    starts = F.when(F.col("_first") - F.lag("_last").over(order) < window, 0).otherwise(1)
    crowded = F.col("_n") + F.coalesce(F.when(adjacent, F.lag("_n").over(order)), F.lit(0)) > max_calls
    marked = slots.withColumn("_starts", starts).withColumn("_crowded", crowded).withColumn(
        "_burst", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    contested = F.max("_crowded").over(Window.partitionBy(caller, "_burst"))
    return slotted.join(
        marked.select(caller, "_slot", "_burst", contested.alias("_contested")), [caller, "_slot"])


def limit_calls(
    calls: DataFrame, caller: str, time: str, call_id: str, *,
    max_calls: int = MAX_CALLS, window_seconds: int = WINDOW_SECONDS, ranges: int | None = None,
) -> DataFrame:
    """``(caller, call_id, accepted)`` for every call, in (time, id) order per caller."""
    spark = calls.sparkSession
    window = window_seconds * 1_000_000
    keyed = calls.select(F.col(caller).alias("_caller"), F.col(call_id).alias("_id"), F.col(time).alias("_time"))
    split = _bursts(keyed, "_caller", "_time", max_calls, window)
    free = split.where(~F.col("_contested")).select("_caller", "_id", F.lit(True).alias("accepted"))

    order = ["_caller", "_burst", "_at", "_id"]
    wide = split.where("_contested").select(*order)
    ranged = wide.repartitionByRange(ranges, *order) if ranges else wide.repartitionByRange(*order)
    path = fresh_path(spark, "limiter")
    ranged.withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
    contested = spark.read.schema(wide.schema.add("_range", T.IntegerType())).parquet(path)
    decided = _settle(contested, order, max_calls, window)
    result = free.unionByName(decided)
    return result.select(F.col("_caller").alias(caller), F.col("_id").alias(call_id), "accepted")


def _walk(max_calls: int, window: int, starts: dict[int, tuple], summary: bool):
    """Decide the rows of each range in order, in Arrow batches; memory holds one state only."""

    def state(part: int, opening: tuple, burst: tuple, hits: deque) -> tuple:
        return part, opening[0], opening[1], burst[0], burst[1], list(hits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = opening = burst = None
        hits: deque = deque()
        ends = []
        for batch in batches:
            accepted = np.zeros(len(batch), dtype=bool)
            keys = batch[["_range", "_caller", "_burst"]]
            times = batch["_at"].to_numpy()
            firsts = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            for start, end in zip(firsts, [*firsts[1:], len(batch)]):
                part, caller, number = (_bare(v) for v in keys.iloc[start])
                if part != current:
                    if current is not None:
                        ends.append(state(current, opening, burst, hits))
                    current, opening = part, (caller, number)
                    burst, held = starts.get(part, (None, ()))
                    hits = deque(held)
                if (caller, number) != burst:
                    burst, hits = (caller, number), deque()
                accepted[start:end] = decide_all(hits, times[start:end], max_calls, window)
            if not summary:
                yield batch[["_caller", "_id"]].assign(accepted=accepted)
        if summary and current is not None:
            ends.append(state(current, opening, burst, hits))
            yield pd.DataFrame(ends, columns=["_range", "open_caller", "open_burst", "end_caller", "end_burst", "hits"])

    return run


def _settle(contested: DataFrame, order: list[str], max_calls: int, window: int) -> DataFrame:
    """Pass end states to the following ranges until nothing changes, then decide every row.

    Only states travel through the driver: one per range, each at most ``max_calls`` numbers.
    A range that opens a burst of its own needs no state, so it is never walked again.
    """
    types = {f.name: f.dataType.simpleString() for f in contested.schema.fields}
    state_schema = (f"_range int, open_caller {types['_caller']}, open_burst long, "
                    f"end_caller {types['_caller']}, end_burst long, hits array<long>")

    def in_order(rows: DataFrame) -> DataFrame:
        # large files are read in pieces; bringing a range together again restores its order
        return rows.repartition("_range").sortWithinPartitions("_range", *order)

    def walk(rows: DataFrame, starts: dict[int, tuple]) -> dict[int, tuple]:
        states = in_order(rows).mapInPandas(_walk(max_calls, window, starts, True), state_schema).collect()
        return {s[0]: ((s[1], s[2]), (s[3], s[4]), tuple(s[5])) for s in states}

    starts: dict[int, tuple] = {}
    states = walk(contested, starts)
    while True:
        arriving = {}
        filled = sorted(states)
        for earlier, later in zip(filled, filled[1:]):
            _, burst, hits = states[earlier]
            if states[later][0] == burst:
                arriving[later] = (burst, hits)
        changed = [part for part in arriving if arriving[part] != starts.get(part)]
        starts = arriving
        if not changed:
            break
        states |= walk(contested.where(F.col("_range").isin(changed)), starts)
    return in_order(contested).mapInPandas(
        _walk(max_calls, window, starts, False), f"_caller {types['_caller']}, _id {types['_id']}, accepted boolean")
