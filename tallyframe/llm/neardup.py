"""Near copies by SimHash and a self-join of a binary trie.

Fingerprints are the leaves of a binary trie. The join starts with a node paired with itself and walks
pairs of nodes down together: children of one pair differ in the next bit or not, differing bits add up,
and a pair is dropped when they exceed the budget. All node pairs of a level are handled at once.

On Spark the walk is spread by the bits that must agree: if two of 64 bits may differ, at least one of
three blocks agrees, so three tries, each split at one agreeing block, contain every pair of near leaves.
A block value that too many fingerprints share is split again at three blocks of its other bits, until
the bits left bound the group. Tasks return a spanning forest of what they link instead of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import map_batches
from tallyframe.llm.graph import components
from tallyframe.session import materialise

SHINGLE = 3
BUDGET = 2
SEED = 42
#: fingerprints with one block value that are joined in one task; more are split at further blocks
GROUP = 1 << 15
_ALL = (1 << 64) - 1


def fingerprint(text: str | None) -> int:
    """SimHash of the word shingles, each as often as it occurs; ASCII letters are lowered; no words: zero."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))))
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[part:part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and number, the fingerprint as a signed 64-bit number."""
    rows = documents.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))

    def start():
        def signed(value):
            number = fingerprint(value)
            return number - (1 << 64) if number >> 63 else number
        return lambda batch: {"doc_id": batch["doc_id"], "number": [signed(t) for t in batch["text"]]}

    return map_batches(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, number long", start)


def trie_links(leaves: np.ndarray, starts: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of leaves of one group that differ in at most ``budget`` bits.

    ``leaves`` are distinct and ascending within each group; ``starts`` are the groups' first places. A trie
    node is a range of leaves; a level splits every range at the place where the next bit turns to one.
    """
    ends = np.append(starts[1:], len(leaves))
    several = ends - starts > 1
    a0, a1 = starts[several], ends[several]
    b0, b1, spent = a0, a1, np.zeros(len(a0), dtype=np.int8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(63, -1, -1):
        # pairs of few leaves are compared outright
        size_a, size_b = a1 - a0, b1 - b0
        few = size_a * size_b <= 16
        if few.any():
            x0, y0, width, area = a0[few], b0[few], size_b[few], (size_a * size_b)[few]
            pair = np.repeat(np.arange(len(x0)), area)
            cell = np.arange(len(pair)) - np.repeat(np.cumsum(area) - area, area)
            i, j = x0[pair] + cell // width[pair], y0[pair] + cell % width[pair]
            near = (i < j) & (np.bitwise_count(leaves[i] ^ leaves[j]) <= budget)
            found.append((i[near], j[near]))
            rest = ~few
            a0, a1, b0, b1, spent = a0[rest], a1[rest], b0[rest], b1[rest], spent[rest]
        if not len(a0):
            break
        zeros = np.concatenate(([0], np.cumsum((leaves >> np.uint64(bit)) & np.uint64(1) == 0)))
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        once = a0 != b0
        more = spent < budget
        parts = [(a0, am, b0, bm, spent), (am, a1, bm, b1, spent),
                 tuple(x[more] for x in (a0, am, bm, b1, spent + 1)),
                 tuple(x[more & once] for x in (am, a1, b0, bm, spent + 1))]
        a0, a1, b0, b1, spent = (np.concatenate(x) for x in zip(*parts))
        full = (a1 > a0) & (b1 > b0) & ((a0 != b0) | (a1 - a0 > 1))
        a0, a1, b0, b1, spent = a0[full], a1[full], b0[full], b1[full], spent[full]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each place reaches over the links."""
    least = np.arange(count)
    while len(i):
        low = np.minimum(least[i], least[j])
        before = least.copy()
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        least = least[least]
        if (least == before).all():
            break
    return least


def _blocks(mask: int) -> list[int]:
    """The bits outside a mask, dealt into three blocks."""
    bits = [b for b in range(64) if not mask >> b & 1]
    size = -(-len(bits) // 3)
    return [sum(1 << b for b in bits[i:i + size]) for i in range(0, len(bits), size)]


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _split(rows: DataFrame, masks: list[int]) -> tuple[DataFrame, list[int]]:
    """Every row once for each further agreeing block, with the bits that agree in ``block``."""
    wider = {m: [m | b for b in _blocks(m)] for m in masks}
    if masks == [0]:
        options = F.array(*[F.lit(_signed(m)) for m in wider[0]])
    else:
        options = F.create_map(*[x for m, ms in wider.items() for x in (
            F.lit(_signed(m)), F.array(*[F.lit(_signed(w)) for w in ms]))])[F.col("mask")]
    dealt = rows.select("number", F.explode(options).alias("mask"))
    return dealt.withColumn("block", F.col("number").bitwiseAND(F.col("mask"))), sorted({w for ms in wider.values() for w in ms})


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = np.zeros((3, 0), dtype=np.int64)

    def linked(rows: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
        group = np.zeros(rows.shape[1], dtype=np.int64)
        group[new] = 1
        leaves = rows[2].view(np.uint64)
        order = np.lexsort((leaves, np.cumsum(group)))
        leaves = leaves[order]
        least = forest(len(leaves), *trie_links(leaves, np.concatenate(([0], new)), BUDGET))
        near = np.flatnonzero(least != np.arange(len(leaves)))
        numbers = leaves.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(numbers[near]), pa.array(numbers[least[near]])], names=["a", "b"])

    for batch in batches:
        rows = np.concatenate([kept, np.array([batch.column(n).to_numpy() for n in ("mask", "block", "number")])], axis=1)
        if not rows.shape[1]:
            continue
        last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
        cut = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
        kept = np.ascontiguousarray(rows[:, cut:])
        if cut:
            yield linked(np.ascontiguousarray(rows[:, :cut]))
    if kept.shape[1]:
        yield linked(kept)


def near_links(numbers: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) that connect all distinct numbers within the budget of each other, of (number)."""
    left, masks = numbers.withColumn("mask", F.lit(0).cast("long")), [0]
    links = None
    while True:
        dealt, masks = _split(left, masks)
        dealt = materialise(dealt, "blocks")
        large = dealt.groupBy("mask", "block").count().where(F.col("count") > group).drop("count")
        last = all(64 - m.bit_count() <= 12 for m in masks)
        crowded = not last and not large.isEmpty()
        mine = dealt.join(large, ["mask", "block"], "left_anti") if crowded else dealt
        sorted_ = mine.repartition("mask", "block").sortWithinPartitions("mask", "block")
        found = sorted_.select("mask", "block", "number").mapInArrow(_joined, "a long, b long")
        links = found if links is None else links.unionByName(found)
        if not crowded:
            return links
        left = dealt.join(large, ["mask", "block"], "left_semi").select("number", "mask")


def classes(documents: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Null text, empty text and text without words have fingerprint zero and are linked like any other.
    Rows with equal fingerprints are one leaf, so copies cost nothing, whatever their number; a null id is
    no candidate for component_id; an empty table gives an empty result; other columns are ignored.
    """
    rows = materialise(fingerprints(documents, id=id, text=text), "fingerprints")
    leaves = rows.groupBy("number").agg(F.min("doc_id").alias("least"))
    reach = components(near_links(leaves.select("number")))
    members = leaves.join(reach, leaves["number"] == reach["a"], "left").select("number", "least", F.coalesce("b", "number").alias("root"))
    members = materialise(members, "members")
    roots = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.join(roots, "root").select("number", "component_id")
    return rows.join(named, "number").select(
        "doc_id", F.lower(F.lpad(F.hex("number"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, columns: list[str], *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of near copies: that of the least id, of rows without an id or with one id the least by hash.

    Rows are told apart by all ``columns``, so different texts under one id are judged apart, rows without an
    id are members like any other, and rows that are equal in all columns are one. Null and empty texts and those without words are one
    class. An empty table gives an empty result; other columns are dropped.
    """
    values = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    key = F.concat_ws("-", F.hex(F.xxhash64(*values)), F.hex(F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    keyed = documents.select(*columns, key.alias("_key"))
    named = classes(keyed, id="_key", text=text).select(F.col("doc_id").alias("_key"), "component_id")
    ids = materialise(keyed.groupBy("_key").agg(F.first(id).alias("_id"), F.count(F.lit(1)).alias("_n")), "rowkeys")
    best = named.distinct().join(ids, "_key").groupBy("component_id").agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key", "_n")).alias("best"))
    kept = materialise(best.select("best._key", "best._n"), "kept")
    once = keyed.join(kept.where("_n = 1"), "_key", "left_semi").select(*columns)
    if kept.where("_n > 1").isEmpty():
        return once
    repeated = keyed.join(kept.where("_n > 1"), "_key", "left_semi")
    return once.unionByName(repeated.groupBy("_key").agg(F.first(F.struct(*columns)).alias("_row")).select("_row.*"))
