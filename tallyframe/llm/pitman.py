"""Language model scores: a hierarchical Pitman-Yor model of words after their predecessor.

Every word is a context with a restaurant of its own; their tables are the customers of one shared
parent over a uniform base. Seating is drawn by Gibbs sweeps, and a text is scored by predictive probabilities
averaged over several drawn seatings.

Texts are read once. A batch's occurrences of (context, word) go, packed, to the bucket of the word, or of the context
if only the word is frequent; it counts the training ones and remembers which text had which. A sweep changes all
buckets at once; between sweeps only sums travel. Those of frequent words, a list bounded by their share of all tokens,
are known to every task. Those of rarer contexts go by shards: each bucket sends its tables of the contexts it has to
the shard of the context, and gets their sums back. At the end each bucket returns its part of every text's score.
On disk are the buckets, the last sweep and the job that runs: occurrences are dealt to buckets as they are found, a
sweep's tables go when the next has read them, and a bucket keeps the few tables of a seating that counts, not its mean.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.llm.common import remainder
from tallyframe.llm.seating import discount_of, draw_strength, draw_tables, stirling, strength_parts
from tallyframe.llm.tokens import Hasher, mixed, pack, unpack
from tallyframe.session import materialise, release, shuffles_dropped

PARTS, HELD = 7, 2
#: words with at least this share of the training tokens, and their restaurants, are known to every task, so there are 100,000 at most
WORD_SHARE = 1e-5
#: sweeps before seatings count, and seatings that are averaged
BURN, SAMPLES, SEED = 2, 3, 13
#: tokens of a bucket, on average; bytes of text that are read at once; distinct words held before they are passed on
BUCKET_TOKENS, BATCH_BYTES, HELD_WORDS = 800_000, 4 << 20, 1 << 20
#: buckets' worth of tokens whose rarer contexts share a shard
SHARD_BUCKETS = 16


@dataclass
class Shared:
    """What every task knows: the frequent words by number, which are contexts as well, and the state of their restaurants."""

    words: np.ndarray
    counts: np.ndarray
    total: int
    vocabulary: int
    buckets: int
    #: customers and tables of each context
    customers: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    tables: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    #: customers and tables of each frequent word in the parent; all customers and tables there
    word_customers: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    word_tables: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    parent_customers: int = 0
    parent_tables: int = 0
    strength: float = 1.0
    discount: float = 0.75
    parent_strength: float = 1.0
    parent_discount: float = 0.75

    @property
    def contexts(self) -> np.ndarray:
        return self.words

    @property
    def shards(self) -> int:
        return 1 + self.buckets // SHARD_BUCKETS

    @property
    def base(self) -> float:
        return 1 / (self.vocabulary + 1)

    def parent_probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        spare = (self.parent_strength + self.parent_discount * self.parent_tables) * self.base
        return (customers - self.parent_discount * tables + spare) / (self.parent_strength + self.parent_customers)


def _find(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions of values in a sorted array, -1 for those that are not there."""
    if not len(sorted_):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them all."""
    least, most = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about so many bytes of text."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
        marks = np.cumsum(sizes) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _tally(numbers: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    numbers, times = np.concatenate(numbers), np.concatenate(times)
    order = np.argsort(numbers, kind="stable")
    numbers, times = numbers[order], times[order]
    first = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else np.zeros(0, dtype=np.int64)
    return numbers[first], np.add.reduceat(times, first) if len(first) else times


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n): how often each number occurs among the training tokens."""
    schema = to_arrow_schema(T.StructType.fromDDL("word long, n long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, numbers, times, held = Hasher(), [], [], 0
        for piece in _pieces(batches):
            found, n = np.unique(hasher.words(piece.column("text"))[0], return_counts=True)
            numbers.append(found)
            times.append(n)
            held += len(found)
            if held > HELD_WORDS:
                found, n = _tally(numbers, times)
                numbers, times, held = [found], [n], len(found)
                if held > HELD_WORDS // 2:
                    yield pa.RecordBatch.from_arrays([found.view(np.int64), n], schema=schema)
                    numbers, times, held = [], [], 0
        if held:
            found, n = _tally(numbers, times)
            yield pa.RecordBatch.from_arrays([found.view(np.int64), n], schema=schema)

    return training.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def survey(training: DataFrame) -> Shared:
    """Totals and frequent words; only words with a stated share of all tokens come to the driver."""
    counts = materialise(word_counts(training), "wordcounts")
    total, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = WORD_SHARE * total
    found = {r["word"]: r["n"] for r in counts.where(F.col("n") >= least).collect()} if total else {}
    words = np.array(sorted(np.array(list(found), dtype=np.int64).view(np.uint64)), dtype=np.uint64)
    n = np.array([found[int(w)] for w in words.view(np.int64)], dtype=np.int64)
    return Shared(words, n, int(total), int(vocabulary), int(1 + total // BUCKET_TOKENS))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _singles(word: np.ndarray, before: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows of three columns of numbers from 0, in order, and how often each occurs."""
    wide, high = (max(1, *(int(x.max(initial=0)).bit_length() for x in columns)) for columns in ((word, before), (code,)))
    if 2 * wide + high > 63:  # one text of very many words
        order = np.lexsort((code, before, word))
        word, before, code = word[order], before[order], code[order]
        single = np.flatnonzero(_changes(word, before, code))
        return word[single], before[single], code[single], np.diff(np.r_[single, len(order)])
    key, times = np.unique(((word << wide | before) << high) | code, return_counts=True)
    return key >> (wide + high), key >> high & ((1 << wide) - 1), key & ((1 << high) - 1), times


def occurrences(documents: DataFrame, shared: Shared) -> DataFrame:
    """Packed occurrences per batch and bucket, and one row in bucket -1 per batch for its texts.

    That row has the rows' ids, their number of tokens and what frequent words add to the base score.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    ddl = f"bucket int, batch long, ids array<{kind}>, payload binary"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, number = Hasher(), TaskContext.get().partitionId() << 32
        for piece in _pieces(batches):
            words, rows = hasher.words(piece.column("text"))
            learn = piece.column("learn").to_numpy(zero_copy_only=False).astype(np.int64)
            distinct, word = np.unique(words, return_inverse=True)
            place = _find(shared.words, distinct)
            common = place[word]
            inside, known = np.bincount(rows, minlength=len(learn)), np.bincount(rows[common >= 0], minlength=len(learn))
            logs = np.bincount(rows[common >= 0], np.log10(shared.counts[common[common >= 0]] + 1.0), len(learn))
            out = {"bucket": [-1], "batch": [number], "ids": [piece.column("doc_id").to_pylist()],
                   "payload": [pack(learn.astype(np.int8), inside, known, logs.view(np.int64))]}
            before = np.r_[word[:0], word[-1:], word[:-1]]  # a text begins behind an end
            word, before, code, times = _singles(word, before, rows * 2 + learn[rows])
            del words, rows
            common, context = place[word], place[before]
            # a frequent word is spread by its contexts, and goes with the context if that is rarer
            salt = np.where(common >= 0, context + 2, 0).astype(np.uint64)
            key = distinct[np.where((common >= 0) & (context < 0), before, word)]
            bucket = (mixed(key + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shared.buckets)).astype(np.int32)
            # in a bucket frequent words come first; they go by number, rarer ones by hash
            order = np.argsort(_narrow(bucket * 2 + (common < 0)), kind="stable")
            bucket, word, before, common, context, code, times = (x[order] for x in (bucket, word, before, common, context, code, times))
            fresh = _changes(word, before, bucket)
            edges = np.searchsorted(bucket, np.arange(shared.buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                part = slice(edges[b], edges[b + 1])
                heads = np.flatnonzero(fresh[part]) + part.start
                numbers, hashes = common[heads[common[heads] >= 0]], distinct[word[heads[common[heads] < 0]]]
                known_by = context[heads]
                out["bucket"].append(int(b))
                out["batch"].append(number)
                out["ids"].append(None)
                out["payload"].append(pack(_narrow(np.diff(numbers, prepend=0)), np.diff(hashes, prepend=np.uint64(0)), _narrow(known_by), distinct[before[heads[known_by < 0]]],
                                           _narrow(np.diff(np.r_[heads, part.stop])), _narrow(code[part]), _narrow(times[part])))
            number += 1
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    rows = documents.select("doc_id", "text", (remainder("doc_id", PARTS) != HELD).alias("learn"))
    return rows.mapInArrow(run, ddl)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one key at a time, from batches sorted by it."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


_BUCKET = "bucket int, state binary, texts binary, tables array<struct<id:int,n:bigint,c:bigint>>, words array<struct<id:int,n:bigint>>, rare array<bigint>, sent array<struct<shard:int,payload:binary>>"
_SUMS = "shard int, bucket int, payload binary"


def _sums(number: np.ndarray, names: str, *values: np.ndarray) -> pa.ListArray:
    """One list of structs: each number, as id, with its sums of the values."""
    ids = np.unique(number)
    columns = [np.bincount(number, v, int(ids[-1]) + 1)[ids].astype(np.int64) if len(ids) else np.zeros(0, dtype=np.int64) for v in values]
    structs = pa.StructArray.from_arrays([pa.array(ids.astype(np.int32)), *map(pa.array, columns)], ["id", *names])
    return pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), structs)


def _batch(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    """One row, of which some values are columns already; what it lacks is null."""
    values = [row.get(f.name) for f in schema]
    return pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v, pa.Array) else pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


@dataclass
class Bucket:
    """The pairs of a bucket in order of words: context (from -1 downwards: the rarer ones of this bucket), training
    customers, tables, and per word how many pairs it has, its place among the frequent words and its tables in the parent.
    Of its rarer contexts, which lie in order of their shards, a bucket has the shard and the customers and tables in all
    buckets. ``kept`` are the seatings that count: tables, the words' tables in the parent, and the rarer contexts' tables."""

    context: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    pairs: np.ndarray
    common: np.ndarray
    word_tables: np.ndarray
    shard: np.ndarray
    rare_customers: np.ndarray
    rare_tables: np.ndarray
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def packed(self) -> bytes:
        own = (self.context, self.customers, self.tables, self.pairs, self.common, self.word_tables, self.shard, self.rare_customers, self.rare_tables)
        return pack(*map(_narrow, own), *(_narrow(x) for seating in self.kept for x in seating))

    @classmethod
    def opened(cls, data: bytes) -> Bucket:
        parts = [p.astype(np.int64) for p in unpack(data)]
        return cls(*parts[:9], kept=list(zip(*(parts[i::3] for i in range(9, 12)))))

    def keep(self) -> None:
        """The present seating counts."""
        self.kept.append((self.tables.copy(), self.word_tables.copy(), self.rare_tables))

    def mean(self, shareds: list[Shared]) -> np.ndarray:
        """The probability of every pair's word in its context, averaged over the seatings that count, each with what was shared then."""
        total = np.zeros(len(self.context))
        for shared, (tables, word_tables, rare_tables) in zip(shareds, self.kept, strict=True):
            total = total + replace(self, tables=tables, word_tables=word_tables, rare_tables=rare_tables).predictive(shared)
        return total / len(shareds)

    @property
    def word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.pairs)), self.pairs)

    def word_customers(self) -> np.ndarray:
        """Customers in the parent, which are tables of the contexts; only for rarer words."""
        return np.bincount(self.word, self.tables, len(self.pairs)).astype(np.int64)

    def own_sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over this bucket's pairs of its rarer contexts."""
        low = self.context < 0
        return np.bincount(-1 - self.context[low], values[low], len(self.shard)).astype(np.int64)

    def sent(self, *values: np.ndarray) -> list[dict]:
        """Values of the rarer contexts by shard."""
        shards = np.unique(self.shard)
        edges = np.r_[np.searchsorted(self.shard, shards), len(self.shard)]
        return [{"shard": int(s), "payload": pack(*[v[a:b] for v in values])} for s, a, b in zip(shards, edges, edges[1:])]

    def received(self, payloads: list[bytes]) -> None:
        """Sums over all buckets, in order of shards: tables, the first time after customers."""
        parts = [unpack(p) for p in payloads]
        if parts and len(parts[0]) == 2:
            self.rare_customers = np.concatenate([p[0] for p in parts]).astype(np.int64)
        if parts:
            self.rare_tables = np.concatenate([p[-1] for p in parts]).astype(np.int64)

    def restaurants(self, shared: Shared) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of contexts, to be looked up by their numbers, negative ones from the end."""
        return np.r_[shared.customers, self.rare_customers[::-1]], np.r_[shared.tables, self.rare_tables[::-1]]

    def row(self, number: int, texts: bytes | None, sent: list[dict]) -> dict:
        pair_common = self.common[self.word]
        seated, low = self.customers > 0, self.common < 0
        shown, known = seated & (self.context >= 0), seated & (pair_common >= 0)
        counts = self.word_customers()[low]
        return {"bucket": number, "state": self.packed(), "texts": texts, "sent": sent,
                "tables": _sums(self.context[shown], "nc", self.tables[shown], self.customers[shown]),
                "words": _sums(pair_common[known], "n", self.tables[known]),
                "rare": [int(counts.sum()), int(self.word_tables[low].sum()), int((counts == 1).sum()), int((counts == 2).sum()),
                         int((self.customers[seated] == 1).sum()), int((self.customers[seated] == 2).sum())]}

    def parents(self, shared: Shared) -> np.ndarray:
        """The parent's probability of each word."""
        low = self.common < 0
        at = np.where(low, 0, self.common)
        whole, held = self.word_customers(), self.word_tables
        if len(shared.word_customers):
            whole, held = np.where(low, whole, shared.word_customers[at]), np.where(low, held, shared.word_tables[at])
        return shared.parent_probability(whole, held)

    def predictive(self, shared: Shared) -> np.ndarray:
        """The probability of every pair's word in its context."""
        above = self.parents(shared)[self.word]
        customers, tables = (v[self.context] for v in self.restaurants(shared))
        return (self.customers - shared.discount * self.tables + (shared.strength + shared.discount * tables) * above) / (shared.strength + customers)

    def sweep(self, shared: Shared, ways: tuple[np.ndarray, np.ndarray], rng: np.random.Generator) -> None:
        """New tables in every context, then in the parent."""
        seated = np.flatnonzero(self.customers > 0)
        above = self.parents(shared)[self.word[seated]]
        others = np.maximum(self.restaurants(shared)[1][self.context[seated]] - self.tables[seated], 0)
        self.tables[seated] = draw_tables(self.customers[seated], others, above, shared.strength, shared.discount, ways[0], rng)
        low = np.flatnonzero(self.common < 0)
        counts = self.word_customers()[low]
        self.word_tables[low] = draw_tables(counts, np.maximum(shared.parent_tables - self.word_tables[low], 0), np.full(len(low), shared.base),
                                            shared.parent_strength, shared.parent_discount, ways[1], rng)


def _gather(parts: DataFrame, shared: Shared) -> DataFrame:
    """One row per bucket: its pairs with every customer of a pair at one table, and which text of which batch has which pair.

    The batches' own rows, of bucket -1, come along as they are, so that occurrences need not be kept as well.
    """
    ddl = f"{_BUCKET}, batch long, ids {parts.schema['ids'].dataType.simpleString()}, payload binary"
    arrow = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _grouped(batches, "bucket"):
            if number < 0:
                for row in rows:
                    yield _batch(row, arrow)
                continue
            parts, owners = [], [r["batch"] for r in rows]
            rows.reverse()
            while rows:  # what is unpacked is let go, as a bucket fills a good part of a task's memory
                numbers, steps, context, rarer, length, code, n = unpack(rows.pop()["payload"])
                before = np.empty(len(context), dtype=np.uint64)
                before[context >= 0], before[context < 0] = shared.contexts[context[context >= 0]], rarer
                parts.append((np.r_[shared.words[np.cumsum(numbers, dtype=np.int64)], np.cumsum(steps, dtype=np.uint64)], before, length.astype(np.int32),
                              code.astype(np.int32), n.astype(np.int32), np.full(len(context), len(parts), dtype=np.int32)))
            words, before, length, codes, times, places = (np.concatenate([p[i] for p in parts]) for i in range(6))
            del parts
            # pairs in order, those of a pair by batch, each with its singles, which lie in order of texts
            order = _order(words, before)
            begin = np.r_[0, np.cumsum(length)[:-1]][order]
            words, before, length, places = words[order], before[order], length[order], places[order]
            inner = np.repeat(begin - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(len(codes))
            codes, times, places = codes[inner], times[inner], np.repeat(places, length)
            del inner
            firsts = np.flatnonzero(_changes(words, before))
            heads = np.r_[0, np.cumsum(length)][firsts]
            words, before = words[firsts], before[firsts]
            customers = np.add.reduceat(np.where(codes & 1, times, 0), heads, dtype=np.int64)
            context = _find(shared.contexts, before)
            rarer = np.unique(before[context < 0])
            shard = (mixed(rarer) % np.uint64(shared.shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            place_of = np.empty(len(order), dtype=np.int64)
            place_of[order] = np.arange(len(order))
            context[context < 0] = -1 - place_of[np.searchsorted(rarer, before[context < 0])]
            firsts = np.flatnonzero(_changes(words))
            bucket = Bucket(context, customers, np.minimum(customers, 1), np.diff(np.r_[firsts, len(heads)]), _find(shared.words, words[firsts]),
                            np.zeros(len(firsts), dtype=np.int64), shard[order], *np.zeros((2, len(order)), dtype=np.int64))
            bucket.word_tables = np.where(bucket.common < 0, np.minimum(bucket.word_customers(), 1), 0)
            sent = bucket.sent(rarer[order], bucket.own_sums(customers), bucket.own_sums(bucket.tables))
            texts = pack(np.array(owners, dtype=np.int64), *map(_narrow, (np.diff(np.r_[heads, len(codes)]), places, codes >> 1, times)))
            yield _batch(bucket.row(number, texts, sent), arrow)

    dealt = parts.repartition("bucket", F.when(F.col("bucket") < 0, F.col("batch"))).sortWithinPartitions("bucket", "batch")
    return materialise(dealt.mapInArrow(run, ddl), "buckets")


def _order(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The stable order by word, then by context."""
    (_, first), (found, second) = (np.unique(x, return_inverse=True) for x in (words, before))
    return np.argsort(first * len(found) + second, kind="stable")


def _linked(buckets: DataFrame) -> DataFrame:
    """Per shard which bucket has which of its contexts, in a row of bucket -1, and per bucket their customers and tables."""
    arrow = to_arrow_schema(T.StructType.fromDDL(_SUMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _grouped(batches, "shard"):
            owners, parts = [r["bucket"] for r in rows], [unpack(r.pop("payload")) for r in rows]
            lengths = np.array([len(p[0]) for p in parts], dtype=np.int64)
            ids, customers, tables = (np.concatenate(c) for c in zip(*parts))
            del parts
            found, which = np.unique(ids, return_inverse=True)
            totals = [np.bincount(which, v, len(found)).astype(np.int64) for v in (customers, tables)]
            index = pack(np.array(owners, dtype=np.int32), lengths.astype(np.int32), which.astype(np.int32), totals[0])
            yield pa.RecordBatch.from_pylist([{"shard": shard, "bucket": -1, "payload": index}], schema=arrow)
            for owner, part in zip(owners, np.split(which, np.cumsum(lengths)[:-1])):
                yield pa.RecordBatch.from_pylist([{"shard": shard, "bucket": owner, "payload": pack(*[t[part] for t in totals])}], schema=arrow)

    sent = buckets.select("bucket", F.inline("sent")).repartition("shard").sortWithinPartitions("shard", "bucket")
    return materialise(sent.select("shard", "bucket", "payload").mapInArrow(run, _SUMS), "links")


def _exchanged(buckets: DataFrame, links: DataFrame, shared: Shared, number: int) -> DataFrame:
    """Per bucket the tables of its rarer contexts in all buckets, and per shard, in a row of bucket -1, what they say of the strength."""
    arrow = to_arrow_schema(T.StructType.fromDDL(_SUMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (head, *rows) in _grouped(batches, "shard"):
            owners, lengths, which, customers = unpack(head["payload"])
            if owners.tolist() != [r["bucket"] for r in rows]:
                raise ValueError("A shard lacks a bucket's tables")
            tables = np.bincount(which, np.concatenate([unpack(r["payload"])[0] for r in rows]), len(customers)).astype(np.int64)
            found = strength_parts(shared.strength, shared.discount, customers, tables, np.random.default_rng([SEED, number, shard, 1]))
            yield pa.RecordBatch.from_pylist([{"shard": shard, "bucket": -1, "payload": pack(np.array(found).view(np.int64))}], schema=arrow)
            for owner, part in zip(owners.tolist(), np.split(which, np.cumsum(lengths)[:-1])):
                yield pa.RecordBatch.from_pylist([{"shard": shard, "bucket": owner, "payload": pack(tables[part])}], schema=arrow)

    sent = buckets.select("bucket", F.inline("sent")).unionByName(links.where("bucket < 0"))
    dealt = sent.select("shard", "bucket", "payload").repartition("shard").sortWithinPartitions("shard", "bucket")
    return materialise(dealt.mapInArrow(run, _SUMS), "sums")


def _met(states: DataFrame, sums: DataFrame | None, texts: DataFrame | None = None) -> DataFrame:
    """(shard, bucket, payload): the rows of a bucket together, its texts as shard -2, its state as -1, then the sums by shard."""
    rows = states.where("bucket >= 0").select(F.lit(-1).alias("shard"), "bucket", F.col("state").alias("payload"))
    if texts is not None:
        rows = rows.unionByName(texts.where("bucket >= 0").select(F.lit(-2).alias("shard"), "bucket", F.col("texts").alias("payload")))
    if sums is not None:
        rows = rows.unionByName(sums.where("bucket >= 0"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "shard")


def _swept(buckets: DataFrame, shared: Shared, number: int, counts: bool, sums: DataFrame | None = None) -> DataFrame:
    """Buckets after one more sweep; ``counts``: their seatings before it are kept for the mean."""
    arrow = to_arrow_schema(T.StructType.fromDDL(_BUCKET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = stirling(shared.discount), stirling(shared.parent_discount)
        for number_, (head, *rows) in _grouped(batches, "bucket"):
            bucket = Bucket.opened(head["payload"])
            bucket.received([r["payload"] for r in rows])
            if counts:
                bucket.keep()
            bucket.sweep(shared, ways, np.random.default_rng([SEED, number, number_]))
            yield _batch(bucket.row(number_, None, bucket.sent(bucket.own_sums(bucket.tables))), arrow)

    return materialise(_met(buckets, sums).mapInArrow(run, _BUCKET), "sweep")


def _total(buckets: DataFrame, shared: Shared, direct: np.ndarray, rng: np.random.Generator, first: bool, sums: DataFrame | None = None) -> Shared:
    """The shared state after a sweep: sums over buckets, then tables of the frequent words in the parent."""
    customers, tables = (np.zeros(len(shared.contexts), dtype=np.int64) for _ in range(2))
    whole = direct.copy()
    for r in buckets.select(F.inline("tables")).groupBy("id").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect():
        tables[r["id"]], customers[r["id"]] = r["n"], r["c"]
    for r in buckets.select(F.inline("words")).groupBy("id").agg(F.sum("n").alias("n")).collect():
        whole[r["id"]] += r["n"]
    rare = buckets.agg(*[F.coalesce(F.sum(F.col("rare")[i]), F.lit(0)).alias(str(i)) for i in range(6)]).first()
    if first:
        shared = replace(shared, discount=discount_of(rare[4], rare[5]), parent_discount=discount_of(rare[2], rare[3]), word_tables=np.minimum(whole, 1))
    else:
        others = np.maximum(shared.parent_tables - shared.word_tables, 0)
        drawn = draw_tables(whole, others, np.full(len(whole), shared.base), shared.parent_strength, shared.parent_discount, stirling(shared.parent_discount), rng)
        shown = sums.where("bucket < 0").select("payload").collect() if sums is not None else []  # two numbers a shard
        rarer = [unpack(r["payload"])[0].view(np.float64) for r in shown]
        strength = draw_strength(shared.strength, shared.discount, customers, tables, rng, tuple(math.fsum(r[i] for r in rarer) for i in range(2)))
        above = draw_strength(shared.parent_strength, shared.parent_discount, np.array([shared.parent_customers]), np.array([shared.parent_tables]), rng)
        shared = replace(shared, word_tables=drawn, strength=strength, parent_strength=above)
    return replace(shared, customers=customers, tables=tables, word_customers=whole, parent_customers=int(rare[0] + whole.sum()),
                   parent_tables=int(rare[1] + shared.word_tables.sum()))


def _returned(buckets: DataFrame, states: DataFrame, shareds: list[Shared], sums: DataFrame) -> DataFrame:
    """(bucket, batch, payload): per text what a bucket adds to its base score, known words and score; ``shareds``: what was shared at each seating that counts."""
    ddl = "bucket int, batch long, payload binary"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (told, head, *rows) in _grouped(batches, "bucket"):
            bucket = Bucket.opened(head["payload"])
            bucket.received([r["payload"] for r in rows])
            owners, length, place, text, times = unpack(told["payload"])
            bucket.keep()
            mean = bucket.mean(shareds)
            # all customers of a rarer word are in this bucket
            count = np.bincount(bucket.word, bucket.customers, len(bucket.pairs))[bucket.word]
            rarer = (bucket.common < 0)[bucket.word]
            pair = np.repeat(np.arange(len(length)), length)
            score = times * np.log10(mean)[pair]
            base = np.where(rarer, np.log10(count + 1), 0.0)[pair] * times
            known = np.where(rarer & (count > 0), 1, 0)[pair] * times
            place, text = place.astype(np.int64), text.astype(np.int64)
            order = np.argsort(place * (text.max(initial=0) + 1) + text, kind="stable")
            place, text = place[order], text[order]
            heads = np.flatnonzero(_changes(place, text))
            added = [np.add.reduceat(x[order], heads) for x in (base, known, score)]
            edges = np.searchsorted(place[heads], np.arange(len(owners) + 1))
            out = {"bucket": [], "batch": [], "payload": []}
            for i, owner in enumerate(owners.tolist()):
                part = slice(edges[i], edges[i + 1])
                out["bucket"].append(number)
                out["batch"].append(owner)
                out["payload"].append(pack(_narrow(text[heads][part]), added[0][part].view(np.int64), added[1][part].astype(np.int32), added[2][part].view(np.int64)))
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return _met(states, sums, buckets).mapInArrow(run, ddl)


def _scored(parts: DataFrame, returned: DataFrame, shared: Shared) -> DataFrame:
    """One row per text from its batch's row and what the buckets returned, in the order of buckets."""
    kind = parts.schema["ids"].dataType.elementType.simpleString()
    ddl = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "batch"):
            head, *rest = rows
            learn, inside, known, logs = unpack(head["payload"])
            known, base = known.astype(np.int64), logs.view(np.float64) - inside * np.log10(shared.total + shared.vocabulary + 1.0)
            score = np.zeros(len(learn))
            for row in rest:
                text, more, n, gained = unpack(row["payload"])
                base[text] += more.view(np.float64)
                known[text] += n
                score[text] += gained.view(np.float64)
            yield pa.RecordBatch.from_pydict({"doc_id": head["ids"], "held_out": (learn == 0).tolist(), "n_tokens": inside.tolist(), "n_known": known.tolist(),
                                              "train_tokens": [shared.total] * len(learn), "base_score": base.tolist(), "score": score.tolist()}, schema=schema)

    heads = parts.where("bucket < 0").select("batch", "bucket", "ids", "payload")
    both = heads.unionByName(returned, allowMissingColumns=True)
    return both.repartition("batch").sortWithinPartitions("batch", "bucket").mapInArrow(run, ddl)


def score(documents: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null and empty texts are one end token; a null id counts as empty text in the fold; repeated rows are
    scored and, in training, counted each; without training tokens every word has the base's probability; an
    empty table gives an empty result; other columns are ignored. Words that training lacks share one part of the base.
    """
    rows = documents.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    with shuffles_dropped(documents.sparkSession):
        shared = survey(rows.where(remainder("doc_id", PARTS) != HELD))
        parts = occurrences(rows, shared)
        direct = _direct(parts, shared)
        buckets = states = _gather(parts, shared)
        links = sums = _linked(buckets)
        rng, shareds = np.random.default_rng(SEED), []
        shared = _total(states, shared, direct, rng, True)
        for number in range(BURN + SAMPLES):
            past = [x for x in (states, sums) if x is not buckets and x is not links]
            states = _swept(states, shared, number, number > BURN, sums)
            sums = _exchanged(states, links, shared, number)
            shared = _total(states, shared, direct, rng, False, sums)
            shareds = [*shareds, shared][-SAMPLES:]
            for x in past:  # a sweep reads only the one before it
                release(x)
    return _scored(buckets, _returned(buckets, states, shareds, sums), shared)


def _direct(parts: DataFrame, shared: Shared) -> np.ndarray:
    """How often each frequent word follows no context in training: never, as every word is a context."""
    return np.zeros(len(shared.words), dtype=np.int64)
