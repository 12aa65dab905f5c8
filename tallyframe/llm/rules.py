"""Quality rules: plain limits, then robust multivariate outliers per language and source.

Counts of a text become a vector of eight transformed statistics. For every cell of documents with one
language and source a minimum-covariance-determinant estimate is made: starting from medians and
absolute deviations, concentration steps re-estimate mean and covariance from the share of rows that
lie nearest, then one step weighs the inner rows. A text is rejected when its squared Mahalanobis
distance is beyond a far quantile of the chi-square distribution.

Each concentration step is one grouped aggregation: moments are summed per cell and distance band,
so a step moves a few rows per cell and no cell is gathered in a task. Cells with few rows use the
estimate of their whole language, or of the whole table where the language has few rows too.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm.common import map_batches
from tallyframe.llm.textstats import measure
from tallyframe.session import materialise

LEAST_WORDS = 50
MOST_REPEATED = 50
#: a cell with fewer rows uses the estimate of its language or of all rows
LEAST_ROWS = 100
#: share of a cell's rows that a concentration step keeps; odd rows up to nearly the other half do not enter it
CORE = 0.5
STEPS = 4
#: probability that a normal vector would be rejected
TAIL = 1e-9
#: statistics and the least spread each is given, so that equal texts do not make a cell infinitely narrow
STATISTICS = {"symbols": 0.35, "repeats": 0.2, "lines": 0.2, "variety": 0.015, "marks": 0.3, "length": 0.1, "capitals": 0.12, "top": 0.3}

#: estimates of at most this many cells (about 400 bytes each) are sent to all tasks; more are joined by cell
SENT_CELLS = 20_000

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_top", "n_marks")
_N = len(STATISTICS)
_PAIRS = [(i, j) for i in range(_N) for j in range(i + 1)]
_BANDS = 160
#: quantiles from which a cell's first medians and absolute deviations are taken
_QUANTILES = [(k + 0.5) / 32 for k in range(32)]


def counted(documents: DataFrame, text: str = "text") -> DataFrame:
    """The counts of every text beside the other columns; the text itself is left behind."""
    kept = [f for f in documents.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} long" for c in _COUNTS)])

    def start():
        def work(batch):
            counts = [measure(t) for t in batch[text]]
            return {**{f.name: batch[f.name] for f in kept}, **{c: [m[c] for m in counts] for c in _COUNTS}}
        return work

    return map_batches(documents, schema, start)


def _statistics() -> dict[str, Column]:
    c = F.col
    words = F.greatest(c("n_words"), F.lit(1)).cast("double")
    return {
        "symbols": F.log1p(100 * c("n_symbols") / (words + 20)),
        "repeats": F.sqrt(c("n_repeat_words") / words),
        "lines": F.sqrt(c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))),
        "variety": F.log(c("n_distinct") + F.lit(1.0)) / F.log(words + 2),
        "marks": F.log((c("n_marks") + 3) / (words + 20)),
        "length": F.log((c("word_chars") + 100) / (words + 20)),
        "capitals": F.sqrt(c("n_upper") / words),
        "top": F.log((c("n_top") + 1) / (words + 20)),
    }


def chi_square_below(x: float, degrees: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(degrees // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(below: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, degrees) < below else (low, middle)
    return high


def _triangle(mean: np.ndarray, covariance: np.ndarray) -> dict[str, float]:
    """Mean and the lower triangle that turns differences into independent units."""
    floor = np.diag(np.square(list(STATISTICS.values())))
    inverse = np.linalg.inv(np.linalg.cholesky(covariance + floor))
    return {**{f"m{i}": mean[i] for i in range(_N)}, **{f"w{i}_{j}": inverse[i, j] for i, j in _PAIRS}}


_ESTIMATE = ["cell string", *(f"m{i} double" for i in range(_N)), *(f"w{i}_{j} double" for i, j in _PAIRS)]


def _distance(rows: DataFrame, estimates: DataFrame, sent: bool | None) -> DataFrame:
    """Rows with ``distance``, the squared Mahalanobis distance to their cell's estimate.

    Sent estimates leave the rows where they are, so that a cell with many rows stays spread over the tasks.
    Estimates of languages and the whole table, which most rows may feed, are always sent;
    ``sent`` None joins all by cell.
    """
    if sent is False:
        wide = F.col("cell") >= "2"
        return _distance(rows.where(~wide), estimates.where(~wide), None).unionByName(_distance(rows.where(wide), estimates.where(wide), True))
    gap = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(_N)]
    square = F.lit(0.0)
    for i in range(_N):
        unit = F.lit(0.0)
        for j in range(i + 1):
            unit = unit + F.col(f"w{i}_{j}") * gap[j]
        square = square + unit * unit
    joined = rows.join(F.broadcast(estimates) if sent else estimates, "cell", "left").withColumn("distance", square)
    return joined.drop(*(c.split()[0] for c in _ESTIMATE[1:]))


def _moments(rows: DataFrame) -> DataFrame:
    """Moments per cell and band of distances; a band is an eighth of a power of two."""
    band = F.least(F.lit(_BANDS - 1), F.greatest(F.lit(0), F.floor(F.log2(F.col("distance") + 1e-9) * 8) + 80)).cast("int")
    sums = [F.sum(F.col(f"x{i}")).alias(f"s{i}") for i in range(_N)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in _PAIRS]
    return rows.where(F.col("distance").isNotNull()).groupBy("cell", band.alias("band")).agg(F.count(F.lit(1)).alias("rows"), *sums, *products)


def _from_bands(bands: pd.DataFrame, upto: int, correction: float) -> dict[str, float]:
    inner = bands[bands["band"] <= upto]
    n = inner["rows"].sum()
    mean = np.array([inner[f"s{i}"].sum() for i in range(_N)]) / n
    covariance = np.zeros((_N, _N))
    for i, j in _PAIRS:
        covariance[i, j] = covariance[j, i] = inner[f"p{i}_{j}"].sum() / n - mean[i] * mean[j]
    covariance[np.diag_indices(_N)] = np.maximum(np.diag(covariance), 0)
    covariance += 1e-9 * np.eye(_N)
    return _triangle(mean, covariance * correction)


def _concentrate(bands: pd.DataFrame) -> pd.DataFrame:
    """A concentration step: the nearest bands that hold the core share of the rows."""
    bands = bands.sort_values("band")
    seen = bands["rows"].cumsum()
    upto = int(bands["band"][seen >= CORE * bands["rows"].sum()].iloc[0])
    share = float(bands["rows"][bands["band"] <= upto].sum() / bands["rows"].sum())
    inside = chi_square_quantile(min(share, 1 - 1e-6), _N)
    correction = share / max(chi_square_below(inside, _N + 2), 1e-6)  # of a cut normal's covariance
    return pd.DataFrame([{"cell": bands["cell"].iloc[0], **_from_bands(bands, upto, correction)}])


def _reweigh(bands: pd.DataFrame) -> pd.DataFrame:
    """The last step: all rows within the 97.5 % quantile, or the core if that is more."""
    bands = bands.sort_values("band")
    seen = bands["rows"].cumsum()
    core = int(bands["band"][seen >= CORE * bands["rows"].sum()].iloc[0])
    edge = math.floor(math.log2(chi_square_quantile(0.975, _N)) * 8) + 80
    return pd.DataFrame([{"cell": bands["cell"].iloc[0], **_from_bands(bands, max(core, edge), 1.0)}])


def _start(cell: pd.DataFrame) -> pd.DataFrame:
    """Medians and median absolute deviations, which nearly half of the rows being odd does not carry off."""
    row = cell.iloc[0]
    values = np.array([list(row[f"q{i}"]) for i in range(_N)])
    medians = np.median(values, axis=1)
    deviations = np.median(np.abs(values - medians[:, None]), axis=1) / 0.6745
    return pd.DataFrame([{"cell": row["cell"], **_triangle(medians, np.diag(deviations ** 2))}])


def _cells(rows: DataFrame, least: int) -> DataFrame:
    """Which estimate a language and source use (``cell``), and all that their rows are summed for (``feeds``).

    A small cell uses the estimate of all rows of its language, or of all rows where those are few too;
    wider estimates are made only where a small cell uses them.
    """
    pairs = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < least
    languages = pairs.groupBy("lang").agg(F.sum("n").alias("rows"), F.max(small).alias("asked"))
    whole = languages.agg(F.coalesce(F.max(F.col("asked") & (F.col("rows") < least)), F.lit(False)).alias("whole"))
    named = pairs.alias("p").join(languages.alias("l"), F.col("p.lang").eqNullSafe(F.col("l.lang"))).crossJoin(F.broadcast(whole))
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    own, language = F.concat(F.lit("1"), part("p.lang"), F.lit("\x00"), part("p.source")), F.concat(F.lit("2"), part("p.lang"))
    several = F.col("rows") >= least
    return named.select(
        F.col("p.lang").alias("of_lang"), F.col("p.source").alias("of_source"),
        F.when(~small, own).when(several, language).otherwise("3").alias("cell"),
        F.array_compact(F.array(F.when(~small, own), F.when(several & F.col("asked"), language), F.when(F.col("whole"), F.lit("3")))).alias("feeds"))


def judge(documents: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
          keep: list[str] | None = None, least_rows: int = LEAST_ROWS, tail: float = TAIL) -> DataFrame:
    """One row per document: the counts, base_failed, kept, distance, and the columns named in ``keep``.

    Null text counts as empty and fails the base; a null language or source is a value of its own;
    rows that repeat are judged alike; an empty table gives an empty result; other columns are
    ignored. Every row is judged by its language and source, its language or the whole table, the first
    that has ``least_rows``; only where even all rows together are fewer, the base alone decides (distance null).
    """
    rows = counted(documents.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"), *(keep or [])))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.select("*", failed.alias("base_failed"), *(x.alias(f"x{i}") for i, x in enumerate(_statistics().values())))
    rows = materialise(rows, "rules")
    cells = _cells(rows, least_rows)
    rows = rows.join(cells, rows["lang"].eqNullSafe(cells["of_lang"]) & rows["source"].eqNullSafe(cells["of_source"])).drop("of_lang", "of_source")
    rows = materialise(rows, "cells")
    summed = rows.select(F.explode("feeds").alias("cell"), *(f"x{i}" for i in range(_N)))
    sent = cells.select("cell").distinct().count() <= SENT_CELLS

    schema = ", ".join(_ESTIMATE)
    quantiles = summed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *(
        F.percentile_approx(f"x{i}", F.array(*(F.lit(q) for q in _QUANTILES)), 1000).alias(f"q{i}") for i in range(_N)))
    estimates = quantiles.where(F.col("n") >= least_rows).groupBy("cell").applyInPandas(_start, schema)
    for step in range(STEPS + 1):
        estimates = materialise(estimates, "estimates")
        bands = _moments(_distance(summed, estimates, sent))
        estimates = bands.groupBy("cell").applyInPandas(_concentrate if step < STEPS else _reweigh, schema)
    judged = _distance(rows, materialise(estimates, "estimates"), sent)
    far = F.coalesce(F.col("distance") > chi_square_quantile(1 - tail, _N), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "distance", *(keep or []))
