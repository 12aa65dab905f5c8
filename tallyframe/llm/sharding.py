"""Shards of near-equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of the id, where it was read). Candidate boundaries are probed: every
partition counts its bytes between the probes, the sums show between which probes each splitter
lies, and the next probes refine that interval until the bytes below a probe meet the tolerance.
Only then do rows move, once, to their shard.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.llm.common import map_batches, whole_text
from tallyframe.session import materialise

SHARDS = 24
#: how far the bytes below a splitter may be off, as a share of one shard, for equal texts to stay together
TOLERANCE = 0.02
#: candidate boundaries per splitter and round
PROBES = 64
#: rows of a shard are numbered in pieces of about this many rows
PIECE_ROWS = 100_000

#: an interval with at most this many documents is settled from its documents
LAST_ROWS = 256
#: what rows are ordered by: hashes of the text, of the id, and of where a row was read
ORDER = ("key", "tie", "copy")

_LEAST, _END = -(1 << 63), 1 << 63


@dataclass
class _Span:
    """The keys between which one splitter lies; bytes below the first and below the last of them."""

    goal: int
    below: int
    upto: int
    low: int = _LEAST
    high: int = _END
    rows: int = 1 << 62
    key: int | None = None

    def settle(self, tolerance: float) -> None:
        off, key = min((abs(self.below - self.goal), self.low), (abs(self.upto - self.goal), self.high))
        if off <= tolerance:
            self.key = key

    @property
    def open(self) -> bool:
        return self.key is None and self.high - self.low > 1 and self.rows > LAST_ROWS


def _weigh(rows: DataFrame, column: str, probes: list[int]) -> tuple[list[int], list[int]]:
    """Bytes and rows between neighbouring probes, counted in every partition and added up."""
    edges = np.array(probes, dtype=np.int64)

    def counter():
        def count(batch):
            place = np.searchsorted(edges, np.array(batch[column], dtype=np.int64), side="right")
            size, number = np.zeros(len(edges) + 1, dtype=np.int64), np.bincount(place, minlength=len(edges) + 1)
            np.add.at(size, place, np.array(batch["size"], dtype=np.int64))
            used = np.flatnonzero(number)
            return {"place": used.tolist(), "size": size[used].tolist(), "number": number[used].tolist()}
        return count

    parts = map_batches(rows.select(column, "size"), "place int, size long, number long", counter)
    size, number = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for r in parts.groupBy("place").agg(F.sum("size").alias("size"), F.sum("number").alias("number")).collect():
        size[r["place"]], number[r["place"]] = r["size"], r["number"]
    return size, number


def _refine(spans: list[_Span], rows: DataFrame, column: str, tolerance: float) -> None:
    """Narrow every span until its splitter meets the tolerance or few documents are left in it."""
    for span in spans:
        span.settle(tolerance)
    while open_ := [span for span in spans if span.open]:
        probes = sorted({s.low + (s.high - s.low) * i // (PROBES + 1) for s in open_ for i in range(PROBES + 2)} - {_LEAST, _END})
        size, number = _weigh(rows, column, probes)
        for span in open_:
            first = bisect.bisect_right(probes, span.low) if span.low > _LEAST else 0
            below, low = span.below, span.low
            for i in range(first, len(size)):
                high = probes[i] if i < len(probes) else _END
                if below + size[i] > span.goal or high >= span.high:
                    span.low, span.high, span.below, span.upto, span.rows = low, high, below, below + size[i], number[i]
                    break
                below, low = below + size[i], high
            span.settle(tolerance)


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, ...]]:
    """The first (key, tie, copy) of shards 1, 2, ...; rows: key, tie, copy, size."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    slack = tolerance * total / shards
    return _cut(rows, list(ORDER), [_Span(total * j // shards, 0, total) for j in range(1, shards)], slack)


def _cut(rows: DataFrame, columns: list[str], spans: list[_Span], slack: float) -> list[tuple[int, ...]]:
    """The boundary of each span, by as many columns as it takes.

    A group of equal values that is heavier than the slack is cut by the next column; an interval of
    few rows is settled from its groups, of which there are as few.
    """
    _refine(spans, rows, columns[0], slack)
    rest = (_LEAST,) * (len(columns) - 1)
    out = {id(s): (s.key, *rest) for s in spans if s.key is not None}
    heavy = [s for s in spans if s.key is None and s.rows > LAST_ROWS and len(columns) > 1]
    for group in sorted({s.low for s in heavy}):
        mine = [s for s in heavy if s.low == group]
        inner = _cut(rows.where(F.col(columns[0]) == group), columns[1:], [_Span(s.goal, s.below, s.upto) for s in mine], 0.0)
        out |= {id(s): (group, *place) for s, place in zip(mine, inner)}
    few = [s for s in spans if id(s) not in out]
    if few:
        wanted = F.lit(False)
        for low, high in sorted({(s.low, s.high) for s in few}):
            wanted |= F.col(columns[0]).between(low, high - 1)
        sums = rows.where(wanted).groupBy(*columns).agg(F.sum("size").alias("size")).collect()
        left = sorted((*(r[c] for c in columns), r["size"]) for r in sums)
        out |= {id(s): _nearest(s, left, slack) for s in few}
    return [out[id(s)] for s in spans]


def _nearest(span: _Span, left: list[tuple[int, ...]], slack: float) -> tuple[int, ...]:
    """The boundary nearest the goal, between values of the first column if one of those is near enough."""
    depth = len(left[0]) - 1 if left else 1
    below, places, firsts = span.below, {}, {}
    for *place, size in left[bisect.bisect_left(left, (span.low,)):]:
        if place[0] >= span.high:
            break
        places.setdefault(tuple(place), below)
        firsts.setdefault((place[0], *(_LEAST,) * (depth - 1)), below)
        below += size
    places[(span.high, *(_LEAST,) * (depth - 1))] = below
    if firsts:
        best = min(firsts, key=lambda p: abs(firsts[p] - span.goal))
        if abs(firsts[best] - span.goal) <= slack:
            return best
    return min(places, key=lambda p: abs(places[p] - span.goal))


def shard_by_bytes(documents: DataFrame, shards: int = SHARDS, *, id: str = "doc_id", text: str = "text",
                   tolerance: float = TOLERANCE) -> DataFrame:
    """Every row with size, text_crc32, shard and slot.

    A row weighs the UTF-8 bytes of its text plus 8. Equal texts lie together, and are only parted
    where a shard's share would be missed by more than ``tolerance``, so a group of any size is
    spread. Rows with one text and one id, or none, are told apart by where they were read, so any number of
    them is parted as well; which of them lies where changes nothing else. Null text is empty, an empty table
    gives an empty result, other columns are ignored.
    """
    rows = materialise(documents.select(
        F.col(id).alias("doc_id"), (F.octet_length(whole_text(text)) + 8).cast("long").alias("size"),
        F.crc32(whole_text(text).cast("binary")).alias("text_crc32"),
        F.xxhash64(whole_text(text)).alias("key"), F.xxhash64(F.col(id).cast("string"), F.lit("order")).alias("tie"),
        F.xxhash64(F.monotonically_increasing_id(), F.lit("copy")).alias("copy")), "sizes")
    cuts = splitters(rows, shards, tolerance)

    def locate():
        keys = np.array([min(k, _END - 1) for k, *_ in cuts], dtype=np.int64)

        def find(batch):
            key = np.array(batch["key"], dtype=np.int64)
            low, high = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
            shard = high.copy()
            for i in np.flatnonzero(low < high):  # a cut runs through this text's group
                at = tuple(batch[c][i] for c in ORDER)
                shard[i] = low[i] + sum(cuts[j] <= at for j in range(low[i], high[i]))
            return {**{n: batch[n] for n in ("doc_id", "size", "text_crc32", "tie", "copy")}, "shard": shard.tolist()}
        return find

    kind = rows.schema["doc_id"].dataType.simpleString()
    placed = map_batches(rows, f"doc_id {kind}, size long, text_crc32 long, tie long, copy long, shard int", locate)
    pieces = max(1, rows.count() // (shards * PIECE_ROWS))
    placed = placed.withColumn("piece", F.pmod(F.col("copy"), F.lit(pieces)).cast("int"))
    piece = Window.partitionBy("shard", "piece")
    counts = placed.groupBy("shard", "piece").count()
    starts = counts.select("shard", "piece", (F.sum("count").over(
        Window.partitionBy("shard").orderBy("piece")) - F.col("count")).alias("start"))
    numbered = placed.withColumn("place", F.row_number().over(piece.orderBy("tie", "doc_id", "text_crc32", "copy")) - 1)
    return numbered.join(starts, ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
