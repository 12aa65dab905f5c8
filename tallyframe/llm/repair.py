"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation is a row of turns that must read ``(s?(ua)+)?`` by role initials. Each turn is kept, given
another role or deleted, and empty turns may be inserted; four states (nothing yet, after s, u, a) tell
what may come next. To repair a run of turns, costs from its first state forwards and from its last state
backwards meet in the middle; among the states where they are least together, the one whose edits so far
read least is crossed, and both halves are repaired in the same way, with two vectors of four costs at a time.

A conversation of any length is cut into blocks. A block is summarised by its cost and the order of its
edits from each state to each, which is all that a run of blocks needs to find the crossings between
them, so blocks are repaired like turns, and blocks of blocks like blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.llm.common import map_batches, remainder
from tallyframe.session import materialise

#: what a turn may cost
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: turns of a conversation that are repaired as one piece, and pieces as one
BLOCK_BITS, FAN = 12, 4096
_BLANKS = " \t\n\x0b\x0c\r"
_FAR = 1 << 40
#: states: nothing yet, after a system, a user, an assistant turn; a conversation may end in the first and the last
START, SYSTEM, USER, ASSISTANT = range(4)
_INSERTED = (USER, USER, ASSISTANT, USER)
_ENDS = (0, 2 * INSERT, INSERT, 0)
_ROLES = {USER: "user", ASSISTANT: "assistant"}

Element = tuple[tuple[tuple[int, object] | None, ...], ...]


def _turn(code: int) -> Element:
    """(cost, edits) from each state to each over one turn; code: initial (s, u, a, other), 4 if it must go, 8 if truncated."""
    initial, must_go, extra = code & 3, code & 4, TRUNCATED if code & 8 else 0
    out = []
    for state in range(4):
        found: dict[int, tuple[int, str]] = {}

        def offer(to: int, cost: int, edits: str) -> None:
            found[to] = min(found.get(to, (_FAR, "")), (cost, edits))

        at = state
        for inserted in range(3):
            cost, edits = INSERT * inserted, "I" * inserted
            offer(at, cost + DELETE, edits + "D")
            if not must_go:
                offer(_INSERTED[at], cost + REROLE + extra, edits + "R")
                if (initial == 0 and at == START) or (initial in (1, 2) and _INSERTED[at] == initial + 1):
                    offer(initial + 1, cost + KEEP + extra, edits + "K")
            at = _INSERTED[at]
        out.append(tuple(found.get(to) for to in range(4)))
    return tuple(out)


TURNS = tuple(_turn(code) for code in range(16))


def _forward(costs: tuple[int, ...], ranks: tuple[int, ...], element: Element) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """One element further: what all costs share, the rest of them, and how the edits so far rank."""
    reached = []
    for to in range(4):
        ways = [(costs[p] + element[p][to][0], ranks[p], element[p][to][1]) for p in range(4) if costs[p] < _FAR and element[p][to]]
        reached.append(min(ways) if ways else None)
    order = sorted({way[1:] for way in reached if way})
    least = min((way[0] for way in reached if way), default=0)
    return (least, tuple(way[0] - least if way else _FAR for way in reached),
            tuple(order.index(way[1:]) if way else 0 for way in reached))


def _backward(costs: tuple[int, ...], element: Element) -> tuple[int, ...]:
    """Costs of the states before an element, from those after it, less what all share."""
    back = [min((edge[0] + costs[to] for to, edge in enumerate(edges) if edge and costs[to] < _FAR), default=_FAR) for edges in element]
    least = min(back)
    return tuple(c - least if c < _FAR else _FAR for c in back)


def _only(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else _FAR for s in range(4))


class Desk:
    """Repairs runs of elements; steps from one vector to the next are remembered, as few of them differ."""

    def __init__(self) -> None:
        self._forward, self._backward = lru_cache(maxsize=1 << 16)(_forward), lru_cache(maxsize=1 << 16)(_backward)
        self.repaired = lru_cache(maxsize=1 << 14)(self._repaired)

    def reach(self, elements: list[Element], state: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
        """Costs (and what they share) and ranks of the states after all elements, from one state before them."""
        total, costs, ranks = 0, _only(state), (0, 0, 0, 0)
        for element in elements:
            more, costs, ranks = self._forward(costs, ranks, element)
            total += more
        return total, costs, ranks

    def crossings(self, elements: list[Element], first: int, last: int) -> list[int]:
        """The states after each element but the last, on the cheapest way from first to last whose edits read least."""
        if len(elements) < 2:
            return []
        middle = len(elements) // 2
        _, costs, ranks = self.reach(elements[:middle], first)
        back = _only(last)
        for element in reversed(elements[middle:]):
            back = self._backward(back, element)
        crossed = min((costs[s] + back[s], ranks[s], s) for s in range(4) if costs[s] < _FAR and back[s] < _FAR)[2]
        return [*self.crossings(elements[:middle], first, crossed), crossed, *self.crossings(elements[middle:], crossed, last)]

    def ending(self, elements: list[Element]) -> int:
        """The state in which a whole conversation of these elements ends before turns are added behind it."""
        _, costs, ranks = self.reach(elements, START)
        return min((costs[s] + _ENDS[s], ranks[s], s) for s in range(4) if costs[s] < _FAR)[2]

    def summary(self, elements: list[Element]) -> Element:
        """A run of elements as one: costs and ranks from each state to each."""
        out = []
        for state in range(4):
            total, costs, ranks = self.reach(elements, state)
            out.append(tuple((total + c, r) if c < _FAR else None for c, r in zip(costs, ranks)))
        return tuple(out)

    def _repaired(self, codes: tuple[int, ...], first: int, last: int | None) -> tuple[int, str, tuple[tuple[int, int, str, str | None], ...]]:
        """(cost, edits, steps) of a block; steps: position of the turn, number among its edits, edit, role if it is new.

        Without a last state the block is a whole conversation; with one below zero it is the end of one,
        which ends in the state -1 less ``last`` before turns are added behind it.
        """
        elements = [TURNS[code] for code in codes]
        to = self.ending(elements) if last is None else last if last >= 0 else -1 - last
        states = [first, *self.crossings(elements, first, to), to]
        cost, edits, steps = 0, [], []
        for position, (element, state, after) in enumerate(zip(elements, states, states[1:])):
            price, text = element[state][after]
            cost += price
            edits.append(text)
            for number, edit in enumerate(text):
                state = state if edit == "D" else after if edit == "K" else _INSERTED[state]
                steps.append((position, number, edit, _ROLES[state] if edit in "IR" else None))
        if last is None or last < 0:
            cost, number = cost + _ENDS[to], len(edits[-1])
            while _ENDS[to]:
                to = _INSERTED[to]
                edits.append("I")
                steps.append((len(codes) - 1, number, "I", _ROLES[to]))
                number += 1
        return cost, "".join(edits), tuple(steps)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the crc32 of ``conv_id:turn`` decides; nulls count as one blank."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *[
        F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], key.alias("_key"))
    rows = rows.withColumn("_case", remainder("_key", 20)).where("_case <> 0")
    text = F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_case") == 4, "user").otherwise(F.col("role"))
    copies = F.sequence(F.lit(1), F.when(F.col("_case") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with ``at``, a number that rises along every conversation: by turn (nulls first), role and digest of the text.

    Rows are dealt by ranges, so a conversation of any length spreads over tasks; equal rows are told apart
    by where they were read, so they spread as well.
    """
    keyed = rows.select("conv_id", "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("_read"))
    by = ["conv_id", "turn", "role", "digest", "_read"]
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by)
    return materialise(dealt.drop("_read").withColumn("at", F.monotonically_increasing_id()), "turns")


def judged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, at, initial, fault) of ordered turns; fault: blank, duplicate, truncated or null."""
    solid = F.rtrim(F.col("text"), F.lit(_BLANKS))
    marked = turns.select("conv_id", "turn", "at", "role", "digest", F.left("role", F.lit(1)).alias("initial"), F.right(solid, F.lit(1)).alias("last"))
    again = marked.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(
        F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    met = marked.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    fault = F.when(F.col("last") == "", "blank").when(F.col("at") > F.col("_first"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    return met.select("conv_id", "turn", "at", "initial", fault.alias("fault"))


def blocks(turns: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(conv_id, node, ats, codes): turns of one conversation that are repaired as one piece; node: number of its first turn."""
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.col("initial")), F.lit(0)), F.lit(4)) - 1
    code = F.when(F.col("initial") == "", 3).otherwise(initial) + F.when(F.col("fault").isin("blank", "duplicate"), 4).when(
        F.col("fault") == "truncated", 8).otherwise(0)
    coded = turns.select("conv_id", "at", code.cast("int").alias("code"))
    grouped = coded.groupBy("conv_id", F.expr(f"shiftright(at, {block_bits})").alias("_block")).agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("_rows"))
    return grouped.select("conv_id", F.col("_rows")[0]["at"].alias("node"), F.col("_rows.at").alias("ats"), F.col("_rows.code").alias("codes"))


_TABLE = "array<array<bigint>>"


def _pack(element: Element) -> list[list[int] | None]:
    return [None if edge is None else [int(edge[0]), int(edge[1])] for edges in element for edge in edges]


def _unpack(flat: list) -> Element:
    edges = [None if e is None else tuple(e) for e in flat]
    return tuple(tuple(edges[4 * p:4 * p + 4]) for p in range(4))


def _states(pieces: DataFrame, fan: int) -> DataFrame | None:
    """(node, first, last) of the blocks of conversations that have several; a last block's state is -1 less the one it ends in.

    Blocks are joined ``fan`` at a time into larger ones until a conversation is one; then the states between
    them are found on the way down. Each group holds at most ``fan`` summaries.
    """
    several = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("_conv"))
    spread = materialise(pieces.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi").select("conv_id", "node", "codes"), "pieces")
    if spread.isEmpty():
        return None
    kind = spread.schema["conv_id"].dataType.simpleString()

    def from_turns():
        desk = Desk()
        return lambda b: {"conv_id": b["conv_id"], "node": b["node"], "edges": [_pack(desk.summary([TURNS[c] for c in codes])) for codes in b["codes"]]}

    def from_nodes():
        desk = Desk()
        return lambda b: {"conv_id": b["conv_id"], "node": [m[0]["node"] for m in b["members"]],
                          "edges": [_pack(desk.summary([_unpack(x["edges"]) for x in m])) for m in b["members"]]}

    level = materialise(map_batches(spread, f"conv_id {kind}, node long, edges {_TABLE}", from_turns), "nodes")
    groups = []
    while True:
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy("node")) - 1
        grouped = level.withColumn("_group", F.floor(place / fan)).groupBy("conv_id", "_group").agg(
            F.sort_array(F.collect_list(F.struct("node", "edges"))).alias("members"))
        groups.append(materialise(grouped.select("conv_id", F.col("members")[0]["node"].alias("node"), "members"), "groups"))
        if groups[-1].groupBy("conv_id").count().where("count > 1").isEmpty():
            break
        level = materialise(map_batches(groups[-1].select("conv_id", "members"), f"conv_id {kind}, node long, edges {_TABLE}", from_nodes), "nodes")

    def top():
        desk = Desk()

        def work(b):
            return {"node": b["node"], "first": [START] * len(b["node"]), "last": [-1 - desk.ending([_unpack(x["edges"]) for x in m]) for m in b["members"]]}
        return work

    def down():
        desk = Desk()

        def work(b):
            out = {"node": [], "first": [], "last": []}
            for members, first, last in zip(b["members"], b["first"], b["last"]):
                found = desk.crossings([_unpack(x["edges"]) for x in members], first, last if last >= 0 else -1 - last)
                out["node"] += [x["node"] for x in members]
                out["first"] += [first, *found]
                out["last"] += [*found, last]
            return out
        return work

    known = map_batches(groups[-1].select("node", "members"), "node long, first int, last int", top)
    for level in reversed(groups):
        known = materialise(map_batches(level.select("node", "members").join(known, "node").drop("node"), "node long, first int, last int", down), "states")
    return known


def edits(pieces: DataFrame, fan: int = FAN) -> DataFrame:
    """(conv_id, node, cost, audit, steps) of every block; steps: at, number, edit and new role in order."""
    states = _states(pieces, fan)
    empty = F.lit(None).cast("int")
    known = pieces.join(states, "node", "left") if states is not None else pieces.select("*", empty.alias("first"), empty.alias("last"))

    def start():
        desk = Desk()

        def work(b):
            out = {"conv_id": b["conv_id"], "node": b["node"], "cost": [], "audit": [], "steps": []}
            for ats, codes, first, last in zip(b["ats"], b["codes"], b["first"], b["last"]):
                cost, audit, steps = desk.repaired(tuple(codes), START if first is None else first, last)
                out["cost"].append(cost)
                out["audit"].append(audit)
                out["steps"].append([{"at": ats[p], "number": n, "edit": e, "new_role": r} for p, n, e, r in steps])
            return out
        return work

    kind = pieces.schema["conv_id"].dataType.simpleString()
    return map_batches(known.select("conv_id", "node", "ats", "codes", "first", "last"),
                       f"conv_id {kind}, node long, cost long, audit string, steps array<struct<at:bigint,number:int,edit:string,new_role:string>>", start)


def repair(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, at, number, edit, role, text): the turns that stay and those inserted, ordered by at and number."""
    steps = found.select("conv_id", F.inline("steps")).where("edit <> 'D'")
    added = steps.where("edit = 'I'").select("conv_id", "at", "number", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    kept = steps.where("edit <> 'I'").drop("conv_id").join(turns.select("conv_id", "at", "role", "text"), "at")
    return kept.select("conv_id", "at", "number", "edit", F.coalesce("new_role", "role").alias("role"), "text").unionByName(added)


def text_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` joined by line breaks, in order.

    SHA-256 reads its bytes in order, so one task reads a conversation's turns; it holds one batch of them at a time.
    """
    kind = turns.schema["conv_id"].dataType
    pieces = turns.select("conv_id", "at", "number", F.concat_ws(":", "role", "text").alias("line"))
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at", "number").select("conv_id", "line")
    ddl = f"conv_id {kind.simpleString()}, repaired_sha256 string"
    schema = to_arrow_schema(dealt.select("conv_id", F.lit("").alias("repaired_sha256")).schema, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, now = None, None
        for batch in batches:
            ids, sums = [], []
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line")):
                if running is None or conv != now:
                    if running is not None:
                        ids.append(now)
                        sums.append(running.hexdigest())
                    running, now = hashlib.sha256(), conv
                else:
                    running.update(b"\n")
                running.update(line.as_py().encode("utf-8", "surrogatepass"))
            if ids:
                yield pa.RecordBatch.from_pydict({"conv_id": ids, "repaired_sha256": sums}, schema=schema)
        if running is not None:
            yield pa.RecordBatch.from_pydict({"conv_id": [now], "repaired_sha256": [running.hexdigest()]}, schema=schema)

    return dealt.mapInArrow(run, ddl)


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def audit(conversations: DataFrame, *, block_bits: int = BLOCK_BITS, fan: int = FAN) -> DataFrame:
    """One row per conversation of the table: faults after the damage, cheapest edits and digest of the repair.

    A null id is one conversation of its own; null turns come first; a null role or text is one blank;
    turns with one number are ordered by role and digest of the text; equal rows are repetitions of one
    another; a conversation that loses every row has zeros, no edits and the digest of nothing; an
    empty table gives an empty result; other columns are ignored.
    """
    turns = ordered(damage(conversations))
    marks = materialise(judged(turns), "marks")
    pieces = materialise(blocks(marks, block_bits), "blocks")
    found = materialise(edits(pieces, fan), "edits")
    sums = text_digests(repair(turns, found))
    counted = marks.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *[_count(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")])
    # pairs inside a block and those between neighbouring blocks
    letters = pieces.select("conv_id", "node", F.transform("codes", lambda c: c.bitwiseAND(F.lit(3))).alias("x"))
    legal = lambda a, b: ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
    broken = lambda x: F.size(F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: (i > 1) & ~legal(F.get(x, i - 2), F.get(x, i - 1))))
    inner = letters.select("conv_id", "node", broken(F.col("x")).alias("inner"), F.get("x", F.lit(0)).alias("head"), F.element_at("x", -1).alias("tail"))
    ends = F.sort_array(F.collect_list(F.struct("node", "head", "tail")))
    between = F.size(F.filter(F.sequence(F.lit(1), F.size("ends")), lambda i: (i > 1) & ~legal(
        F.get(F.col("ends.tail"), i - 2), F.get(F.col("ends.head"), i - 1))))
    pairs = inner.groupBy("conv_id").agg(F.sum("inner").alias("inner"), ends.alias("ends")).select(
        "conv_id", (F.col("inner") + between).cast("long").alias("illegal"))
    joined = found.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("node", "audit"))).alias("parts"))
    joined = joined.select("conv_id", "cost", F.array_join("parts.audit", "").alias("audit"))
    parts = conversations.select("conv_id")
    for part in (counted, pairs, joined, sums):
        parts = parts.unionByName(part, allowMissingColumns=True)
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in longs], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
