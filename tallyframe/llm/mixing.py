"""Mixing sources to target weights: Pareto order sampling.

A source's target is shared out as expected copies per document. Whole copies are certain; what is
left of a document's expectation is its inclusion probability. Documents are ranked by random odds
divided by inclusion odds, and the lowest ranks are taken until the source's words are reached.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.llm.common import ranked, word_count
from tallyframe.session import materialise

WEIGHTS = (5, 2, 1)
#: all targets together, as a share of all words
SHARE = 1.5
#: copies of one document, and of one source's words
MOST_COPIES = 2
#: documents of this many words get their source's share; shorter ones up to 1.25 of it, longer down to 0.8
USUAL_WORDS = 400.0
SEED = 20
_BITS, _STEP = 50, 10
_PARTS = float(1 << 20)
#: equal rows are returned in runs of so many
_RUN = 10_000
#: a rank interval is refined until it holds at most this many documents of a source
LAST_ROWS = 1000


def source_targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size): weights by code point order, null last.

    A target stops at twice its source's words; the excess is shared again by weight until none is above.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    weighed = ranked(sizes, "source", "place").withColumn("weight", cycle[(F.col("place") % len(WEIGHTS)).cast("int")])
    weighed = materialise(weighed, "sources")
    total = weighed.agg(F.sum("source_size")).first()[0]
    budget, cap = SHARE * float(total or 0), F.col("source_size") * float(MOST_COPIES)
    level = float("inf")
    while True:
        capped = F.col("weight") * F.lit(level) > cap if level < float("inf") else F.lit(False)
        held, free = weighed.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        if not free or level == (new := (budget - (held or 0.0)) / free):
            break
        level = new
    level = level if level < float("inf") else 0.0
    return weighed.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def number(id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> Column:
    """A row's random number."""
    return F.xxhash64(F.lit(seed), F.col(id).cast("string"), F.col(text), F.col(source), F.col(source).isNull())


def mix(documents: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, number): how many words of each row the mix takes.

    Null text and empty text have no words: they keep their whole copies, which take nothing. A null source is a
    source of its own; repeated rows (one id, text and source) share their random number, so they lie side by side in
    the ranking and are drawn by their count; an empty table gives an empty result; other columns are ignored. Reruns
    agree, as random numbers are hashes of the rows and sums are of whole numbers.
    """
    rows = materialise(documents.select(
        F.col(id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), number(id, text, source, seed).alias("number"),
        F.greatest(F.lit(0.8), F.least(F.lit(1.25), F.pow(F.lit(USUAL_WORDS) / F.greatest(word_count(text), F.lit(1)), F.lit(0.125)))).alias("liking"),
    ), "mixrows")
    targets = source_targets(rows)
    # whole numbers add up alike in any order
    liked = rows.groupBy("source").agg((F.sum(F.floor(F.col("size") * F.col("liking") * _PARTS).cast("decimal(38,0)")).cast("double") / _PARTS).alias("liked"))
    rates = targets.join(liked, targets["source"].eqNullSafe(liked["source"])).select(
        targets["source"].alias("from"), "source_size", "target", (F.col("target") / F.when(F.col("liked") > 0, F.col("liked"))).alias("rate"))
    expected = F.least(F.lit(float(MOST_COPIES)), F.coalesce(F.col("rate"), F.lit(0.0)) * F.col("liking"))
    unit = (F.pmod(F.col("number"), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    share = F.col("expected") - F.col("whole")
    # v = q / (1 + q) for q = random odds / inclusion odds: a rank between 0 and 1
    odds = (unit / (1 - unit)) * (1 - share) / share
    parted = rows.join(rates, rows["source"].eqNullSafe(rates["from"])).withColumn("expected", expected).withColumn(
        "whole", F.floor("expected")).withColumn("rank", F.when(
            (share > 0) & (F.col("size") > 0), F.least(F.lit((1 << _BITS) - 1), F.floor(odds / (1 + odds) * float(1 << _BITS))))).select(
        "doc_id", "source", "size", "source_size", "target", "number", F.col("whole").cast("long").alias("whole"), F.col("rank").cast("long").alias("rank"))
    parted = materialise(parted, "mixranks")
    # every source starts with all its ranks as one interval
    start = parted.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("left"), F.count("rank").alias("rows"))
    state = materialise(start.select(F.col("source").alias("from"), "left", F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("depth"), "rows"), "mixcuts")
    wide = (F.col("rows") > LAST_ROWS) & (F.col("depth") < _BITS)
    while not state.where(wide).isEmpty():
        state = materialise(state.where(~wide).unionByName(_narrower(parted, state.where(wide))), "mixcuts")

    found = parted.join(state, parted["source"].eqNullSafe(state["from"]), "left").withColumn("digit", F.expr(f"shiftright(rank, {_BITS} - depth)"))
    inside = F.coalesce(F.col("digit") == F.col("prefix"), F.lit(False))
    sure = found.where(~inside).withColumn("extra", F.coalesce((F.col("digit") < F.col("prefix")).cast("long"), F.lit(0)))
    edge = found.where(inside).withColumn("extra", F.lit(0).cast("long"))
    # the ranks at which a source's words run out: at most LAST_ROWS different documents; equal rows are counted
    like = [c for c in edge.columns if c != "extra"]
    counted = edge.groupBy(*like).agg(F.count(F.lit(1)).alias("equal"))
    settled = counted.groupBy("from").applyInPandas(_until_full, ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema.fields), "extra long"]))
    edge = _apart(settled).select(*edge.columns)
    copies = F.col("whole") + F.col("extra")
    return sure.unionByName(edge).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "number")


def _narrower(parted: DataFrame, state: DataFrame) -> DataFrame:
    """The part of every interval in which the words run out; its last part if they suffice."""
    here = parted.join(state.drop("rows"), parted["source"].eqNullSafe(state["from"]) & F.expr(f"shiftright(rank, {_BITS} - depth) = prefix"))
    sums = here.groupBy("from", "depth", F.expr(f"shiftright(rank, {_BITS - _STEP} - depth)").alias("digit")).agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.first("left").alias("left"))
    order = Window.partitionBy("from").orderBy("digit")
    sums = sums.withColumn("upto", F.sum("words").over(order)).withColumn("last", F.lead("digit").over(order).isNull())
    before = F.col("upto") - F.col("words")
    return sums.where((before <= F.col("left")) & ((F.col("upto") > F.col("left")) | F.col("last"))).select(
        "from", (F.col("left") - before).alias("left"), F.col("digit").alias("prefix"), (F.col("depth") + _STEP).alias("depth"), "rows")


def _until_full(rows: pd.DataFrame) -> pd.DataFrame:
    """In rank order, take each document that brings the words nearer to what is left; of equal rows as many as do."""
    rows = rows.sort_values(["rank", "number", "doc_id"], kind="stable")
    left, extra = float(rows["left"].iloc[0]), []
    for size, equal in zip(rows["size"].astype(int), rows["equal"].astype(int)):
        extra.append(min(equal, max(0, math.ceil(left / size - 0.5))))
        left -= size * extra[-1]
    return rows.assign(extra=extra)


def _apart(settled: DataFrame) -> DataFrame:
    """Equal rows one by one again, in runs that any task may take; the first of them have the extra copy."""
    runs = settled.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("equal") - 1) / _RUN))))
    if not settled.where(F.col("equal") > _RUN).isEmpty():
        runs = runs.repartition("from", "number", "run")
    first = F.col("run") * _RUN
    here = F.sequence(first, F.least(F.col("equal"), first + _RUN) - 1)
    return runs.withColumn("place", F.explode(here)).withColumn("extra", (F.col("place") < F.col("extra")).cast("long"))
