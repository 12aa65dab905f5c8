"""Streams against their batch twins, and what a stream's state costs."""

from __future__ import annotations

import random
import tempfile
from collections import Counter
from datetime import datetime, timedelta

import pandas as pd
import pytest

from tallyframe.operators import conversation, ratelimit
from tallyframe.streaming import jobs
from tallyframe.streaming.run import run_to_end

START = datetime(2024, 1, 1)


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class _Map:
    def __init__(self, counts):
        self.held, self.counts = {}, counts

    def keys(self):
        return iter(list(self.held))

    def getValue(self, key):
        self.counts["calls read"] += len(self.held[key][0])
        return self.held[key]

    def updateValue(self, key, value):
        self.counts["calls written"] += len(value[0])
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]


class _Handle:
    """State of one key, and how many calls are read from and written to it."""

    def __init__(self):
        self.counts, self.timers = Counter(), set()

    def getValueState(self, name, schema):
        return _Value()

    def getMapState(self, name, key, value):
        return _Map(self.counts)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def _drive(batches, max_calls=3, window=60_000_000, slot=600_000_000):
    """Decisions of one caller whose calls (micros, id) come in batches; the watermark lags by one slot."""
    handle = _Handle()
    limiter = jobs._Limiter(max_calls, window, slot, "long")
    limiter.init(handle)
    newest, watermark, out, rings = 0, 0, [], 0

    def ring():
        nonlocal rings
        while due := sorted(t for t in handle.timers if t <= watermark):
            handle.timers.discard(due[0])
            rings += 1
            for frame in limiter.handleExpiredTimer(("c",), _Clock(watermark), _Clock(due[0])):
                out.extend(zip(frame["call_id"], frame["accepted"]))

    for batch in batches:
        batch = [c for c in batch if c[0] // 1000 >= watermark]  # what is later is dropped before it arrives
        if batch:
            list(limiter.handleInputRows(("c",), iter([pd.DataFrame(batch, columns=["micros", "call_id"])]), None))
            newest = max(newest, *(at for at, _ in batch))
        watermark = max(watermark, (newest - slot) // 1000)
        ring()
    watermark = 1 << 50
    ring()
    return dict(out), handle, rings


def _expected(calls, max_calls=3, window=60_000_000):
    hits, out = ratelimit.deque(), {}
    for at, number in sorted(calls):
        out[number] = ratelimit.decide(hits, at, max_calls, window)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_limiter_state_decides_like_the_rule(seed):
    rng = random.Random(seed)
    calls = [(rng.randrange(7_200) * 1_000_000 + rng.randrange(3) * 500_000, i) for i in range(600)]
    calls.sort(key=lambda c: c[0] + rng.randrange(500_000_000))  # out of order within the delay
    batches = [calls[i:i + 40] for i in range(0, len(calls), 40)]
    found, handle, _ = _drive(batches)
    assert found == _expected(calls)
    assert not handle.timers


def test_limiter_work_is_linear_in_a_backlog():
    read, written = {}, {}
    for n in (5_000, 20_000):
        calls = [(i * 5_000_000, i) for i in range(n)]
        found, handle, rings = _drive([calls])
        assert found == _expected(calls)
        read[n], written[n] = handle.counts["calls read"], handle.counts["calls written"]
        assert rings <= 3  # one timer a caller, however many slots wait
        # every call is written once; only those of the delay are stored again
        assert read[n] <= n + 2 * jobs.RUN_CALLS and written[n] <= n + 2 * jobs.RUN_CALLS


def test_limiter_work_is_linear_over_many_batches():
    for n in (2_000, 8_000):
        calls = [(i * 1_000_000, i) for i in range(n)]
        found, handle, _ = _drive([calls[i:i + 10] for i in range(0, n, 10)])
        assert found == _expected(calls)
        assert handle.counts["calls read"] <= 3 * n and handle.counts["calls written"] <= 3 * n


def test_limiter_stream_equals_batch_over_several_batches(spark):
    rng = random.Random(5)
    schema = "caller string, t timestamp_ntz, i long"
    rows = [(f"c{rng.randrange(4)}", START + timedelta(seconds=rng.randrange(4_000)), i) for i in range(800)]
    rows.sort(key=lambda r: r[1])
    folder = tempfile.mkdtemp()
    for k in range(0, 800, 200):
        spark.createDataFrame(rows[k:k + 200], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    decided = run_to_end(folder, jobs.limit_calls(stream, "caller", "t", "i", max_calls=3, window_seconds=60, delay_seconds=5_000), "t", {"caller": "end", "i": -1})
    batch = ratelimit.limit_calls(spark.createDataFrame(rows, schema), "caller", "t", "i", max_calls=3, window_seconds=60)
    assert {(r["call_id"], r["accepted"]) for r in decided.collect()} == {(r["i"], r["accepted"]) for r in batch.collect()}


# ---- facts

class _FactsHandle(_Handle):
    def getValueState(self, name, schema, ttl=None):
        return _Value()


def _fold(rows, ttl):
    """The rule for one conversation: (micros, order, filters or None) in order."""
    facts, expires = {}, 0
    for micros, _, given in sorted(rows, key=lambda r: r[:2]):
        facts = {} if micros >= expires else facts
        facts = facts | (given or {})
        expires = micros + ttl
    return facts


def _facts_after(batches, ttl_seconds):
    keeper = jobs._Facts(ttl_seconds)
    keeper.init(_FactsHandle())
    found = {}
    for batch in batches:
        frame = pd.DataFrame([(m, o, None if f is None else list(f), None if f is None else list(f.values())) for m, o, f in batch], columns=["micros", "position", "names", "held"])
        for out in keeper.handleInputRows(("c",), iter([frame]), None):
            found = {x["filter_key"]: x["filter_value"] for x in out["facts"].iloc[0]}
    return found


def test_facts_expire_exactly_at_the_ttl():
    second = 1_000_000
    at = lambda s, filters=None: (s * second, s, filters)
    kept = _facts_after([[at(0, {"a": "1"})], [at(59)], [at(118)]], 60)
    assert kept == {"a": "1"}  # turns put the end off
    assert _facts_after([[at(0, {"a": "1"})], [at(60)]], 60) == {}
    assert _facts_after([[at(0, {"a": "1"})], [(60 * second - 1, 1, None)]], 60) == {"a": "1"}
    assert _facts_after([[at(0, {"a": "1"}), at(59, {"b": "2"})], [at(118, {"a": None})]], 60) == {"a": None, "b": "2"}  # so do facts


@pytest.mark.parametrize("seed", range(5))
def test_facts_state_folds_like_the_rule(seed):
    rng = random.Random(seed)
    time, rows = 0, []
    for i in range(80):
        time += rng.choice([1, 20, 59, 60, 61, 90]) * 1_000_000
        rows.append((time, i, None if rng.random() < 0.3 else {rng.choice("abc"): rng.choice([None, "x", "y"]) for _ in range(rng.randrange(3))}))
        cut = [rows[i:i + 9] for i in range(0, len(rows), 9)]
        if i % 13 == 0:
            assert _facts_after([rng.sample(b, len(b)) for b in cut], 60) == _fold(rows, 60 * 1_000_000)


def test_facts_in_batch_fold_like_the_rule(spark):
    rng, rows = random.Random(9), []
    for c in range(25):
        time = START
        for i in range(rng.randrange(1, 12)):
            time += timedelta(seconds=rng.choice([1, 59, 60, 61]))
            rows.append((c, time, i, None if rng.random() < 0.4 else {rng.choice("abc"): rng.choice([None, "x", "y"])}))
    frame = spark.createDataFrame(rows, "c int, t timestamp_ntz, i int, f map<string,string>")
    found = {}
    for r in conversation.current_facts(frame, "c", "t", "i", "f", 60).collect():
        found.setdefault(r["c"], {})[r["filter_key"]] = r["filter_value"]
    micros = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    wanted = {c: _fold([(micros(t), i, f) for x, t, i, f in rows if x == c], 60 * 1_000_000) for c in range(25)}
    assert found == {c: f for c, f in wanted.items() if f}
