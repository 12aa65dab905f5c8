"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Boosting goes round the features in turn; each turn fits one shallow tree on
one feature's bins to what is still unexplained and adds a small part of it to that feature's lookup table.
Then the pairs of features whose joint bins explain most of the rest get tables of their own, trained the
same way. A text's score is a sum of looked-up bins.

Training runs on a bounded table of feature numbers of labelled documents; scoring runs over all texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import map_batches, remainder
from tallyframe.llm.learning import labelled_sample
from tallyframe.llm.textstats import measure
from tallyframe.session import materialise

#: labelled documents that are learnt from at most
TRAINING_ROWS = 20_000
PARTS, HELD = 4, 2
THRESHOLD = 0.7
BINS, GRID = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 6
RATE = 0.1
LEAST_LEAF = 10.0

FEATURES = ("length", "letters", "symbols", "repeated", "lines", "variety", "capitals", "marks", "shouts", "digits", "top", "twice", "breaks")


def features(text: str | None) -> list[float]:
    m = measure(text)
    words = max(m["n_words"], 1)
    return [
        math.log1p(m["n_words"]), m["word_chars"] / words, m["n_symbols"] / words, m["n_repeat_words"] / words,
        m["n_dup_lines"] / max(m["n_lines"], 1), math.log(m["n_distinct"] + 1) / math.log(words + 2), m["n_upper"] / words,
        m["n_marks"] / words, m["n_shout"] / words, m["n_digits"] / words, m["n_top"] / words, m["n_twice"] / words, m["n_lines"] / words,
    ]


@dataclass
class AdditiveModel:
    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], rows[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[i], rows[:, i], side="right"), np.searchsorted(self.coarse[j], rows[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def _best_cut(gradient: np.ndarray, curvature: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of consecutive bins in two, and the first bin behind it."""
    g, h = np.cumsum(gradient)[:-1], np.cumsum(curvature)[:-1]
    total_g, total_h = gradient.sum(), curvature.sum()
    if not len(g):
        return 0.0, 0
    gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g * total_g / (total_h + 1)
    gain[(h < LEAST_LEAF / 4) | (total_h - h < LEAST_LEAF / 4)] = 0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(gradient: np.ndarray, curvature: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values per bin of a tree on one feature."""
    gain, cut = _best_cut(gradient, curvature)
    if depth and gain > 1e-9:
        return np.concatenate([_tree(gradient[:cut], curvature[:cut], depth - 1), _tree(gradient[cut:], curvature[cut:], depth - 1)])
    return np.full(len(gradient), -gradient.sum() / (curvature.sum() + 1))


def _pair_tree(gradient: np.ndarray, curvature: np.ndarray) -> tuple[np.ndarray, float]:
    """Values per cell of a tree that cuts one feature and then, on either side, the other; and its gain."""
    best: tuple[float, np.ndarray] = (-1.0, np.zeros_like(gradient))
    for turned in (False, True):
        g, h = (gradient.T, curvature.T) if turned else (gradient, curvature)
        for cut in range(1, len(g)):
            values, gain = np.zeros_like(g), 0.0
            for side in (slice(0, cut), slice(cut, None)):
                sg, sh = g[side].sum(axis=0), h[side].sum(axis=0)
                one, at = _best_cut(sg, sh)
                for part in (slice(0, at), slice(at, None)):
                    total_g, total_h = sg[part].sum(), sh[part].sum()
                    values[side, part] = -total_g / (total_h + 1)
                    gain += total_g * total_g / (total_h + 1)
            if gain > best[0]:
                best = gain, values.T if turned else values
    return best[1], best[0] - gradient.sum() ** 2 / (curvature.sum() + 1)


def fit(rows: np.ndarray, truth: np.ndarray) -> AdditiveModel:
    rate = (truth.sum() + 1) / (len(truth) + 2)
    count = rows.shape[1]
    edges, coarse = ([_edges(rows[:, j], b) if len(rows) else np.zeros(0) for j in range(count)] for b in (BINS, GRID))
    bins = [np.searchsorted(edges[j], rows[:, j], side="right") for j in range(count)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(rows), math.log(rate / (1 - rate)))
    start = math.log(rate / (1 - rate))

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return p - truth, p * (1 - p)

    for _ in range(ROUNDS if len(rows) else 0):
        for j in range(count):
            gradient, curvature = slopes()
            size = len(tables[j])
            step = RATE * _tree(np.bincount(bins[j], gradient, size), np.bincount(bins[j], curvature, size))
            tables[j] += step
            total += step[bins[j]]

    cells = [np.searchsorted(coarse[j], rows[:, j], side="right") for j in range(count)]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(cells[i] * shape[1] + cells[j], values, shape[0] * shape[1]).reshape(shape)

    pairs: list[tuple[int, int]] = []
    if len(rows):
        gradient, curvature = slopes()
        gains = [(_pair_tree(grid(i, j, gradient), grid(i, j, curvature))[1], i, j) for i in range(count) for j in range(i)]
        pairs = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:PAIRS] if gain > 1e-6]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(pairs):
            gradient, curvature = slopes()
            step = RATE * _pair_tree(grid(i, j, gradient), grid(i, j, curvature))[0]
            pair_tables[k] += step
            total += step[cells[i], cells[j]]
    return AdditiveModel(start, edges, tables, coarse, pairs, pair_tables)


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> AdditiveModel:
    """A model of quality, learnt from at most about ``rows`` labelled documents outside the held-out fold."""
    sample = labelled_sample(documents, labels, remainder("doc_id", PARTS) != HELD, rows, "quality")

    def start():
        return lambda batch: {"y": batch["y"], "x": [features(t) for t in batch["text"]]}

    found = materialise(map_batches(sample.select("text", F.col("y").cast("double").alias("y")), "y double, x array<double>", start), "quality").collect()
    # rows in a stated order, so that sums agree between runs
    table = np.array(sorted([r["y"], *r["x"]] for r in found)).reshape(-1, 1 + len(FEATURES))
    return fit(table[:, 1:], table[:, 0])


def score(documents: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null text is scored as empty; repeated rows get the same score; an empty table gives an empty result;
    without labels every score is one half; other columns are ignored.
    """
    rows = documents.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    model = train(rows, labels)
    out = rows.select("doc_id", "text", (remainder("doc_id", PARTS) == HELD).alias("held_out"))

    def start():
        def work(batch):
            scores = model.score(np.array([features(t) for t in batch["text"]])).tolist()
            return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}
        return work

    return map_batches(out, f"doc_id {out.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int", start)
