"""A stored vector table in clusters, and exact search that skips what cannot be among the best.

Vectors of length one lie as far apart as their cosine tells, so the triangle inequality bounds every score: no
member of a cluster is nearer to a query than the cluster's centre less its radius. A search first reads, for each
query, the nearest clusters that hold enough rows, and with the scores found there only those clusters
that could still hold a better or an equal one. Clusters are folders, so what is skipped is never opened; the
columns that say who may see a row are folders too, and are pruned before any cluster is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.functions.vector import require_size
from tallyframe.operators.vectors import MAX_CELLS, MAX_SENT_BYTES, Best, cut_to_k, few_queries, matrix_of

#: rows of a cluster, on average, while the centres may be sent to every task
BLOCK_ROWS = 50_000
#: rows per centre from which centres are made, and steps in which they settle
SAMPLE, STEPS = 16, 5
#: distances may be off by rounding; nothing within this of the limit is skipped
_SLACK = 1e-6
#: the cluster of vectors without a direction, whose score is zero for every query
_NOWHERE = -1


def _unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which rows have no direction."""
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    none = ~(norms > 0)
    return matrix / np.where(none, 1.0, norms)[:, None], none


def _nearest(units: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row and its distance, a bounded number of cells at a time."""
    block, distance = np.zeros(len(units), dtype=np.int64), np.zeros(len(units))
    squares, step = (centres * centres).sum(axis=1), max(1, MAX_CELLS // max(1, len(centres)))
    for at in range(0, len(units), step):
        part = units[at:at + step]
        block[at:at + step] = np.argmin(squares[None, :] - 2 * (part @ centres.T), axis=1)
        distance[at:at + step] = np.sqrt(((part - centres[block[at:at + step]]) ** 2).sum(axis=1))
    return block, distance


def _centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of a bounded sample: its first rows, moved to the mean of what is nearest to them."""
    centres = sample[:count].copy()
    for _ in range(STEPS if len(sample) > count else 0):
        block, _ = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, block, sample)
        held = np.bincount(block, minlength=len(centres))
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


@dataclass(frozen=True)
class VectorStore:
    """Where a clustered vector table lies: rows by cluster, radii by cluster, and centres."""

    spark: SparkSession
    path: str
    size: int
    #: of the rows, folder columns included; an empty table has no file to tell it
    schema: T.StructType

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def clusters(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/clusters")

    def centres(self) -> np.ndarray:
        found = sorted((r["block"], r["centre"]) for r in self.spark.read.parquet(f"{self.path}/centres").collect())
        return np.array([c for _, c in found]).reshape(len(found), self.size)


def build(catalog: DataFrame, path: str, *, size: int, item_id: str = "item_id", vector: str = "vector",
          folders: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS, max_bytes: int = MAX_SENT_BYTES) -> VectorStore:
    """Store a catalogue in clusters below ``path``, which must not exist; other columns are kept.

    ``folders`` are columns that searches filter on. Centres come from a sample chosen by hash, as many as
    rows ask for but no more than ``max_bytes`` holds, so clusters grow once a catalogue is larger than that.
    """
    spark = catalog.sparkSession
    others = [c for c in catalog.columns if c not in (item_id, vector)]
    rows = catalog.select(F.col(item_id).alias("item_id"), require_size(F.col(vector), size).alias("vector"), *others)
    most = max(1, max_bytes // (8 * size))
    count = min(most, max(1, -(-rows.count() // block_rows)))
    sampled = rows.select("vector", F.xxhash64("item_id", F.lit("centre")).alias("_h")).orderBy("_h").limit(min(most, SAMPLE * count)).toArrow()
    sample, none = _unit(matrix_of(sampled.column("vector"), sampled.num_rows)) if sampled.num_rows else (np.zeros((0, size)), np.zeros(0, dtype=bool))
    centres = _centres(sample[~none], count)
    schema = T.StructType([*rows.schema.fields, T.StructField("block", T.IntegerType()), T.StructField("_distance", T.DoubleType())])
    arrow, sent = to_arrow_schema(schema), spark.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, nowhere = _unit(matrix_of(batch.column("vector"), batch.num_rows)) if batch.num_rows else (np.zeros((0, size)), np.zeros(0, dtype=bool))
            block, distance = _nearest(units, sent.value) if len(sent.value) else (np.zeros(len(units), dtype=np.int64), np.zeros(len(units)))
            block[nowhere], distance[nowhere] = _NOWHERE, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int32()), pa.array(distance)], schema=arrow)

    placed = rows.mapInArrow(run, schema)
    # one file per cluster and folder where it is small; adaptive execution splits a cluster that is not
    placed.hint("rebalance", *folders, "block").write.partitionBy(*folders, "block").parquet(f"{path}/rows")
    store = VectorStore(spark, path, size, schema)
    store.rows().groupBy(*folders, "block").agg(F.max("_distance").alias("radius"), F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/clusters")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "block int, centre array<double>").write.parquet(f"{path}/centres")
    return store


@dataclass
class SearchReport:
    """How many clusters there were to read, and how many were read first and then."""

    clusters: int = 0
    first: int = 0
    second: int = 0

    @property
    def share(self) -> float:
        return (self.first + self.second) / self.clusters if self.clusters else 0.0


@dataclass(frozen=True)
class _Plan:
    """What every task of a search knows: clusters by number, with centre and radius; queries with their limit."""

    blocks: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    ids: list
    matrix: np.ndarray
    units: np.ndarray
    nowhere: np.ndarray

    def least(self, which: np.ndarray) -> np.ndarray:
        """(query, cluster): the least distance any member of these clusters can have."""
        squares = ((self.units * self.units).sum(axis=1)[:, None] + (self.centres[which] ** 2).sum(axis=1)[None, :]
                   - 2 * self.units @ self.centres[which].T)
        out = np.sqrt(np.maximum(squares, 0)) - self.radii[which][None, :]
        out[:, self.blocks[which] == _NOWHERE] = np.sqrt(2)
        out[self.nowhere] = 0.0  # everything has score zero for a query without direction
        return out


def _first_reads(plan: _Plan, rows: np.ndarray, k: int) -> dict[int, np.ndarray]:
    """Position of a cluster -> queries that read it first: each its nearest ones, until they hold ``k`` rows."""
    out: dict[int, list[int]] = {}
    every, step = np.arange(len(plan.blocks)), max(1, MAX_CELLS // max(1, len(plan.blocks)))
    for at in range(0, len(plan.ids), step):
        part = _Plan(plan.blocks, plan.centres, plan.radii, plan.ids[at:at + step], plan.matrix[at:at + step], plan.units[at:at + step], plan.nowhere[at:at + step])
        order = np.argsort(part.least(every), axis=1, kind="stable")
        needed = (np.cumsum(rows[order], axis=1) < k).sum(axis=1) + 1
        for q, (places, n) in enumerate(zip(order, needed)):
            for b in places[:n]:
                out.setdefault(int(b), []).append(at + q)
    return {b: np.array(q) for b, q in out.items()}


def _read(rows: DataFrame, plan: _Plan, k: int, schema: str, first: dict[int, np.ndarray], limits: np.ndarray | None, floors: np.ndarray | None) -> DataFrame:
    """Candidates from the rows' clusters: of the queries that read a cluster first, or else of all others that may need it."""
    layout = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(layout)
    # plain values only: broadcast values are pickled without this package's code
    values = tuple(getattr(plan, f.name) for f in fields(plan))
    sent = rows.sparkSession.sparkContext.broadcast((values, first, limits, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, first, limits, floors = sent.value
        plan = _Plan(*values)
        best, readers = Best(plan.ids, plan.matrix, k), {}
        if floors is not None:
            best.floor = floors.copy()
        place = {int(b): i for i, b in enumerate(plan.blocks)}
        for batch in batches:
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            items, matrix = batch.column("item_id").to_pylist(), matrix_of(batch.column("vector"), batch.num_rows)
            for block in np.unique(blocks):
                at = place[int(block)]
                if at not in readers:
                    mine = first.get(at, np.zeros(0, dtype=np.int64))
                    if limits is not None:
                        may = plan.least(np.array([at]))[:, 0] <= limits
                        may[mine] = False
                        mine = np.flatnonzero(may)
                    readers[at] = mine
                if len(readers[at]):
                    here = np.flatnonzero(blocks == block)
                    best.add([items[i] for i in here], matrix[here], readers[at])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(best.rows(), arrow)], schema=arrow)

    return rows.select("item_id", "vector", "block").mapInArrow(run, layout)


def search(store: VectorStore, queries: DataFrame, k: int, *, where: Column | None = None, threshold: float | None = None,
           query_id: str = "query_id", vector: str = "vector", max_bytes: int = MAX_SENT_BYTES) -> tuple[DataFrame, SearchReport]:
    """``(query_id, item_id, score, rank)`` as ``vectors.top_k`` gives it, and how much was read for it.

    ``where`` filters folder columns and is applied to folders and clusters alike, before anything is ranked. The
    queries are sent to the tasks up to ``max_bytes``; only clusters' numbers and one limit per query pass the driver.
    """
    q, sent = few_queries(queries, query_id, vector, store.size, max_bytes)
    rows, clusters = store.rows(), store.clusters()
    if where is not None:
        rows, clusters = rows.where(where), clusters.where(where)
    known = sorted(map(tuple, clusters.groupBy("block").agg(F.max("radius"), F.sum("rows")).collect()))
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, item_id {rows.schema['item_id'].dataType.simpleString()}, score double"
    report = SearchReport(clusters=len(known))
    ids = sent.column("query_id").to_pylist()
    if not known or not ids:
        return cut_to_k(store.spark.createDataFrame([], schema), k, threshold), report
    centres, blocks = store.centres(), np.array([b for b, _, _ in known])
    matrix = matrix_of(sent.column("vector"), len(ids))
    units, nowhere = _unit(matrix)
    at = np.array([centres[b] if b != _NOWHERE else np.zeros(store.size) for b in blocks]).reshape(len(blocks), store.size)
    plan = _Plan(blocks, at, np.array([r for _, r, _ in known]), ids, matrix, units, nowhere)
    first = _first_reads(plan, np.array([n for *_, n in known]), k)
    report.first = len(first)

    def of(places) -> DataFrame:
        return rows.where(F.col("block").isin([int(blocks[p]) for p in places]))

    found = _read(of(sorted(first)), plan, k, schema, first, None, None)
    ranked = cut_to_k(found, k, None)
    last = {r["query_id"]: r["score"] for r in ranked.where(F.col("rank") == k).collect()}
    floors = np.array([last.get(i, -np.inf) for i in ids])
    limits = np.where(np.isfinite(floors), np.sqrt(np.maximum(2 - 2 * np.clip(floors, -1, 1), 0)), np.inf) + _SLACK
    second = []
    for p in range(len(blocks)):
        may = plan.least(np.array([p]))[:, 0] <= limits
        may[first.get(p, [])] = False
        if may.any():
            second.append(p)
    report.second = len(set(second) - set(first))
    if second:
        found = found.unionByName(_read(of(second), plan, k, schema, first, limits, floors))
    return cut_to_k(found, k, threshold), report
