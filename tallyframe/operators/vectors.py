"""Embedding jobs, idempotent upsert and exact top-k search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.functions.text import point_id
from tallyframe.functions.vector import require_size
from tallyframe.session import materialise

BATCH_SIZE = 16
#: calls whose rows are passed on together
CALLS = 32
MAX_TOP_K = 10
DEFAULT_TOP_K = 5
DEFAULT_THRESHOLD = 0.35
#: queries, ids included, are sent to the tasks only up to this many bytes
MAX_SENT_BYTES = 32 * 1024 * 1024
#: rows of either side that meet in one task
BLOCK_ROWS = 50_000
#: scores a task computes at a time
MAX_CELLS = 2 * 1024 * 1024


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class LetterCountEmbedder:
    """A deterministic local embedder: how often each of some letters occurs."""

    def __init__(self, letters: str = "etaoinsr"):
        self.letters = letters

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(text.count(letter)) for letter in self.letters] for text in texts]


def embed(
    documents: DataFrame, embedder: Embedder | Callable[[], Embedder], text: str, *, batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add ``vector``: one per row, in batches of ``batch_size`` per call.

    A factory may be given instead of an embedder; it then builds one client per task. A
    transient failure of a call is retried once, which is safe because embedding has no effect.
    """
    kept = [f for f in documents.schema.fields if f.name != "vector"]
    schema = T.StructType([*kept, T.StructField("vector", T.ArrayType(T.FloatType()))])
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = embedder if hasattr(embedder, "embed") else embedder()
        for batch in batches:
            for place in range(0, batch.num_rows, CALLS * batch_size):
                rows, vectors = batch.slice(place, CALLS * batch_size), []
                for start in range(0, rows.num_rows, batch_size):
                    # only the texts of one call are Python values, as those of a whole batch may take gigabytes
                    part = rows.column(text).slice(start, batch_size).to_pylist()
                    try:
                        found = client.embed(part)
                    except TimeoutError:
                        found = client.embed(part)
                    if len(found) != len(part):
                        raise ValueError("the embedder must return exactly one vector per text")
                    vectors.extend(np.asarray(v, dtype="float32") for v in found)
                columns = [rows.column(f.name).cast(arrow.field(f.name).type) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(vectors, arrow.field("vector").type)], schema=arrow)

    return documents.mapInArrow(run, schema)


def dimension_violations(vectors: DataFrame, vector: str, size: int) -> DataFrame:
    return vectors.agg(F.count(F.lit(1)).alias("row_count"),
                       F.count_if(F.coalesce(F.size(vector), F.lit(-1)) != size).alias("violations"))


def points(embedded: DataFrame, doc_id: str, size: int, payload: list[str]) -> DataFrame:
    """Rows of a vector table: deterministic id, checked vector, payload."""
    return embedded.select(
        point_id(F.col(doc_id)).alias("point_id"), require_size(F.col("vector"), size).alias("vector"),
        F.struct(*payload).alias("payload"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "point_id") -> DataFrame:
    """The table after replacing every incoming key; the same input twice changes nothing.

    A key that is repeated in ``incoming`` counts once. The incoming rows are stored before they are used
    twice, so whatever made them (an embedder, for instance) runs once.
    """
    others = [c for c in incoming.columns if c != key]
    once = incoming.groupBy(key).agg(F.max_by(F.struct(*others), F.xxhash64(*others)).alias("_row")).select(
        key, *[F.col(f"_row.{c}").alias(c) for c in others])
    stored = materialise(once, "upsert")
    return existing.join(stored.select(key), key, "left_anti").unionByName(stored)


def _sides(queries, catalog, k, size, threshold, names):
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be at least one")
    if threshold is not None and not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be between 0 and 1")
    names = {"query_id": "query_id", "query_vector": "vector", "item_id": "item_id", "item_vector": "vector"} | names
    q = queries.select(F.col(names["query_id"]).alias("query_id"), require_size(F.col(names["query_vector"]), size).alias("vector"))
    c = catalog.select(F.col(names["item_id"]).alias("item_id"), require_size(F.col(names["item_vector"]), size).alias("vector"))
    types = (q.schema["query_id"].dataType.simpleString(), c.schema["item_id"].dataType.simpleString())
    return q, c, f"query_id {types[0]}, item_id {types[1]}, score double"


def cut_to_k(candidates: DataFrame, k: int, threshold: float | None) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    best = candidates.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return best if threshold is None else best.where(F.col("score") >= threshold)


def top_k(
    queries: DataFrame, catalog: DataFrame, k: int, *, size: int, threshold: float | None = None, max_bytes: int = MAX_SENT_BYTES, **names: str,
) -> DataFrame:
    """``(query_id, item_id, score, rank)``: exact best ``k`` by cosine, ties by item id.

    The threshold applies after the cut to ``k``. The queries with their ids are sent to the tasks, and
    the catalogue is read once, unshuffled, each task keeping ``k`` candidates per query. Queries
    beyond ``max_bytes`` are refused; ``top_k_by_blocks`` takes any number. Ids are unique on both
    sides, as ``upsert`` keeps them. ``names`` may rename query_id, query_vector, item_id and item_vector.
    """
    q, c, schema = _sides(queries, catalog, k, size, threshold, names)
    return cut_to_k(_scan(_sent(q, size, max_bytes), c, k, schema), k, threshold)


def _sent(queries: DataFrame, size: int, max_bytes: int) -> pa.Table:
    # no more rows than could fit are fetched before the bytes are looked at
    sent = queries.limit(max_bytes // (4 * size) + 1).toArrow()
    if sent.nbytes > max_bytes or sent.num_rows > max_bytes // (4 * size):
        raise ValueError(f"The queries take more than {max_bytes} bytes; use top_k_by_blocks")
    return sent


def few_queries(queries: DataFrame, query_id: str, vector: str, size: int, max_bytes: int) -> tuple[DataFrame, pa.Table]:
    """Queries as (query_id, vector), and the same fetched to be sent to the tasks; refused beyond ``max_bytes``."""
    q = queries.select(F.col(query_id).alias("query_id"), require_size(F.col(vector), size).alias("vector"))
    return q, _sent(q, size, max_bytes)


def top_k_by_blocks(
    queries: DataFrame, catalog: DataFrame, k: int, *, size: int, block_rows: int = BLOCK_ROWS,
    threshold: float | None = None, **names: str,
) -> DataFrame:
    """As ``top_k`` for any number of queries: both sides are cut into blocks of about ``block_rows`` that meet pairwise.

    A task holds one block of either side, and only ``k`` candidates per query and block survive. Every
    row is sent once per opposite block, so choose blocks as large as a task can hold.
    """
    q, c, schema = _sides(queries, catalog, k, size, threshold, names)
    query_blocks, item_blocks = (max(1, -(-side.count() // block_rows)) for side in (q, c))
    return cut_to_k(_by_blocks(q, c, k, schema, query_blocks, item_blocks), k, threshold)


def matrix_of(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(rows, len(flat) // rows) if rows else np.zeros((0, 0))


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix * matrix).sum(axis=1))


def _directions(matrix: np.ndarray) -> np.ndarray:
    """The same directions, whole numbers without their common divisor, so that multiples of a vector become one vector."""
    whole = (np.abs(matrix) < 2.0**53).all(axis=1) & (matrix == np.trunc(matrix)).all(axis=1)
    divisor = np.ones(len(matrix))
    divisor[whole] = np.maximum(np.gcd.reduce(matrix[whole].astype("int64"), axis=1), 1)
    return matrix / divisor[:, None]


class Best:
    """The best ``k`` items per query over any number of item batches."""

    def __init__(self, ids: list, matrix: np.ndarray, k: int):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.norms = _norms(matrix)
        self.floor = np.full(len(ids), -np.inf)
        self.kept: list[list[tuple]] = [[] for _ in ids]

    def add(self, items: list, matrix: np.ndarray, which: np.ndarray | None = None) -> None:
        """Items for all queries or those at some places; scores are made for a bounded number of cells at a time."""
        which = np.arange(len(self.ids)) if which is None else which
        step = max(1, MAX_CELLS // max(1, len(which)))
        for start in range(0, len(items), step):
            self._add(items[start:start + step], matrix[start:start + step], which)

    def _add(self, items: list, matrix: np.ndarray, which: np.ndarray) -> None:
        norms = _norms(matrix)
        with np.errstate(divide="ignore", invalid="ignore"):
            rough = (self.matrix[which] @ matrix.T) / self.norms[which, None] / norms[None, :]
        rough = np.where(np.isfinite(rough), rough, 0.0)
        count = len(items)
        if count > self.k:
            cut = np.partition(rough, count - self.k, axis=1)[:, count - self.k]
        else:
            cut = np.full(len(which), -np.inf)
        # the product is used to preselect only; scores below are summed the same way for every row, from vectors
        # without a common divisor, so equal vectors and multiples always get equal scores wherever they are stored
        cut = np.maximum(cut, self.floor[which]) - 1e-9
        for place in np.flatnonzero((rough >= cut[:, None]).any(axis=1)):
            i, chosen = which[place], np.flatnonzero(rough[place] >= cut[place])
            near = _directions(matrix[chosen])
            scale = self.norms[i] * _norms(near)
            dots = (near * self.matrix[i]).sum(axis=1)
            scores = np.divide(dots, scale, out=np.zeros(len(chosen)), where=scale != 0.0)
            merged = self.kept[i] + [(-s, items[j]) for s, j in zip(scores.tolist(), chosen)]
            merged.sort()
            self.kept[i] = merged[:self.k]
            if len(self.kept[i]) == self.k:
                self.floor[i] = max(self.floor[i], -self.kept[i][-1][0])

    def rows(self) -> tuple[list, list, list]:
        flat = [(q, item, -s) for q, kept in zip(self.ids, self.kept) for s, item in kept]
        return tuple(list(c) for c in zip(*flat)) if flat else ([], [], [])


def _scan(queries: pa.Table, catalog: DataFrame, k: int, schema: str) -> DataFrame:
    """One pass over the catalogue; the queries (checked to be few) travel with the task."""
    ids = queries.column("query_id").to_pylist()
    matrix = matrix_of(queries.column("vector"), len(ids))
    sent = catalog.sparkSession.sparkContext.broadcast((ids, matrix))
    layout = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*sent.value, k)
        for batch in batches:
            if batch.num_rows and best.ids:
                best.add(batch.column("item_id").to_pylist(), matrix_of(batch.column("vector"), batch.num_rows))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(best.rows(), arrow)], schema=arrow)

    return catalog.mapInArrow(run, layout)


def _by_blocks(queries: DataFrame, catalog: DataFrame, k: int, schema: str, query_blocks: int, item_blocks: int) -> DataFrame:
    """Blocks of both sides meet pairwise; each pair is one bounded group."""
    q = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks))).withColumn(
        "_c", F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1)).cast("array<bigint>")))
    c = catalog.withColumn("_c", F.pmod(F.xxhash64("item_id"), F.lit(item_blocks))).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<bigint>")))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        best = Best(left["query_id"].tolist(), np.stack(left["vector"]).astype("float64"), k)
        best.add(right["item_id"].tolist(), np.stack(right["vector"]).astype("float64"))
        return pd.DataFrame(dict(zip(("query_id", "item_id", "score"), best.rows())))

    return q.groupBy("_q", "_c").cogroup(c.groupBy("_q", "_c")).applyInPandas(run, schema)


def search(queries: DataFrame, catalog: DataFrame, *, size: int, k: int = DEFAULT_TOP_K, **names) -> DataFrame:
    """Document search: like ``top_k`` with ``k`` capped at ten."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive integer")
    return top_k(queries, catalog, min(k, MAX_TOP_K), size=size, **names)


def merge_rankings(rankings: list[DataFrame], by: str = "query_id", item: str = "item_id", cap: int = MAX_TOP_K) -> DataFrame:
    """``(query_id, item_id, merged_rank)``: ranked lists taken in turns, first list first, no repeats.

    An item's place is its earliest (rank, list) pair, so one grouped minimum merges the lists.
    """
    tagged = [r.select(by, item, "rank", F.lit(i).alias("_list")) for i, r in enumerate(rankings)]
    rows = tagged[0]
    for other in tagged[1:]:
        rows = rows.unionByName(other)
    places = rows.groupBy(by, item).agg(F.min(F.struct("rank", "_list")).alias("_place"))
    window = Window.partitionBy(by).orderBy("_place")
    return places.withColumn("merged_rank", F.row_number().over(window)).where(
        F.col("merged_rank") <= cap).select(by, item, "merged_rank")


def recall_by_query(retrieved: DataFrame, expected: DataFrame, by: str = "query_id", item: str = "item_id") -> DataFrame:
    """``(query_id, expected, found)`` for every query that expects something."""
    hits = retrieved.select(by, item).distinct().withColumn("_hit", F.lit(1))
    joined = expected.select(by, item).distinct().join(hits, [by, item], "left")
    return joined.groupBy(by).agg(F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("found"))


def _shares(per_query: DataFrame, *by: str) -> DataFrame:
    return per_query.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"),
        (F.count_if(F.col("found") == F.col("expected")).cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0)))
        .alias("all_sources_found"),
        (F.sum("found").cast("double") / F.nullif(F.sum("expected"), F.lit(0))).alias("source_recall"),
    )


def recall(retrieved: DataFrame, expected: DataFrame, by: str = "query_id", item: str = "item_id") -> DataFrame:
    """Share of queries with every source found, and pooled source recall; NULL without queries."""
    return _shares(recall_by_query(retrieved, expected, by, item))


def recall_at(ranked: DataFrame, expected: DataFrame, ks: list[int], by: str = "query_id", item: str = "item_id") -> DataFrame:
    """``recall`` after the first ``k`` ranks, one row per ``k``: each expected item's rank is looked up once."""
    ranks = ranked.groupBy(by, item).agg(F.min("rank").alias("rank"))
    joined = expected.select(by, item).distinct().join(ranks, [by, item], "left").withColumn(
        "k", F.explode(F.array(*[F.lit(k).cast("long") for k in ks])))
    return _shares(joined.groupBy(by, "k").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("rank") <= F.col("k")).alias("found")), "k")


def misses(retrieved: DataFrame, expected: DataFrame, by: str = "query_id", item: str = "item_id") -> DataFrame:
    """Expected items that were not retrieved."""
    return expected.select(by, item).distinct().join(retrieved.select(by, item), [by, item], "left_anti")
