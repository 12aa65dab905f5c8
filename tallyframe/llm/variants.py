"""Spelling variants: words one edit apart, by dense comparison of tiles.

Words lie in blocks that share what an edit leaves alone. Two words of m and m or m + 1 letters are one edit
apart if their common beginning and common end together reach the longer length less one, so either the
first half or the second half of m letters agrees: a word is placed by both. A block that is still large is
halved again, by more of the beginning or more of the end, until it is small or one letter is left open, when
the alphabet bounds it. A block's words stand in a matrix of code points, and tiles of rows are compared
column by column from both sides.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import map_batches
from tallyframe.session import materialise

LEAST_LETTERS, LEAST_COUNT = 7, 2
#: a form occurs at least this many times as often as its variant
RATIO = 10
#: one in so many occurrences loses a letter
DAMAGE = 31
#: words of a block beyond which it is halved again; rows of a tile
BLOCK, TILE = 512, 512

_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS)
_KEY = ["m", "p", "q", "head", "tail", "bound"]


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n): damaged runs of letters of at least seven code points that occur twice or more."""
    def start():
        def work(batch):
            found: Counter[str] = Counter()
            for number, text in zip(batch["doc_id"], batch["text"]):
                if not text:
                    continue
                salt = zlib.crc32(f"{'' if number is None else number}:".encode())
                # bytes lower only the letters A to Z; shorter runs cannot yield a word
                low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                for run, count in Counter(_RUN.findall(low)).items():
                    code = zlib.crc32(run.encode(), salt)
                    if code % DAMAGE == 0:
                        at = code % len(run)
                        run = run[:at] + run[at + 1:]
                    if len(run) >= LEAST_LETTERS:
                        found[run] += count
            return {"word": list(found), "n": list(found.values())}
        return work

    parts = map_batches(documents.select("doc_id", "text"), "word string, n long", start)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _placed(rows: DataFrame, size: str, head: str, tail: str) -> DataFrame:
    """Rows in both halves of their window; ``bound``: a pair counts only if fewer letters agree at the beginning."""
    half = F.expr(f"p + ({size}) div 2")
    first = F.struct(half.alias("p"), F.col("q"), F.expr(f"left(word, p + ({size}) div 2)").alias("head"), F.expr(tail).alias("tail"), F.col("bound"))
    open_ = f"q + ({size}) - ({size}) div 2"
    second = F.struct(F.col("p"), F.expr(open_).alias("q"), F.expr(head).alias("head"), F.expr(f"right(word, {open_})").alias("tail"),
                      F.least("bound", half).alias("bound"))
    return rows.select("m", "word", "n", F.explode(F.array(first, second)).alias("_to")).select("m", "_to.*", "word", "n")


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(m, p, q, bound, words): words of m and m + 1 letters that share p letters at the beginning and q at the end."""
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where(F.col("m") >= LEAST_LETTERS)
    rows = rows.withColumns({"p": F.lit(0), "q": F.lit(0), "bound": F.lit(1 << 30)})
    placed, done = _placed(rows, "m", "''", "''"), None
    while True:
        sizes = placed.groupBy(_KEY).agg(F.count(F.lit(1)).alias("size")).where((F.col("size") > most) & F.expr("m - p - q > 1"))
        large = materialise(sizes.select(_KEY), "blocks")
        some = not large.isEmpty()
        small = placed.join(large, _KEY, "left_anti") if some else placed
        grouped = small.groupBy(_KEY).agg(F.collect_list(F.struct("word", "n")).alias("words")).where(F.size("words") > 1)
        done = grouped if done is None else done.unionByName(grouped)
        if not some:
            return done.select("m", "p", "q", "bound", "words")
        inner = placed.join(large, _KEY, "left_semi")
        placed = materialise(_placed(inner, "m - p - q", "head", "tail"), "halves")


def _matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row each; all letters are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def near(a: np.ndarray, b: np.ndarray, p: int, q: int, bound: int) -> np.ndarray:
    """Which rows of a and b are one edit apart; b is as long as a or one longer, p and q letters are known to agree."""
    m, longer = a.shape[1], b.shape[1]
    shape, window = (len(a), len(b)), m - p - q
    front, back = np.full(shape, p, dtype=np.int16), np.full(shape, q, dtype=np.int16)
    alike, alike_back = np.ones(shape, dtype=bool), np.ones(shape, dtype=bool)
    for j in range(window):
        alike &= a[:, p + j, None] == b[None, :, p + j]
        front += alike
        alike_back &= a[:, m - 1 - q - j, None] == b[None, :, longer - 1 - q - j]
        back += alike_back
    same = alike if m == longer else np.zeros(shape, dtype=bool)
    return (front + back >= longer - 1) & ~same & (front < bound)


def _compare(words: list[tuple[str, int]], m: int, p: int, q: int, bound: int) -> list[tuple[str, int, str, int]]:
    """(word, near words, best of them, its count) of a block; words come in the order in which a form is chosen."""
    short, long_ = [w for w in words if len(w[0]) == m], [w for w in words if len(w[0]) == m + 1]
    counts = {w: [0, None] for w, _ in words}
    n = dict(words)
    for left, right, mirrored in ((short, short, False), (short, long_, True)):
        for i in range(0, len(left), TILE):
            rows = left[i:i + TILE]
            a = _matrix([w for w, _ in rows])
            for j in range(0, len(right), TILE):
                columns = right[j:j + TILE]
                found = near(a, _matrix([w for w, _ in columns]), p, q, bound)
                for grid, mine, others in ((found, rows, columns), *(((found.T, columns, rows),) if mirrored else ())):
                    total = grid.sum(axis=1)
                    for k in np.flatnonzero(total):
                        entry, best = counts[mine[k][0]], others[int(grid[k].argmax())]
                        entry[0] += int(total[k])
                        if entry[1] is None or (-best[1], best[0]) < (-n[entry[1]], entry[1]):
                            entry[1] = best[0]
    return [(w, c, best, n[best]) for w, (c, best) in counts.items() if c]


def neighbours(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have near words; every near pair is met in one block only."""
    def start():
        def work(batch):
            out = {"word": [], "n_near": [], "best": [], "best_n": []}
            for m, p, q, bound, members in zip(*(batch[c] for c in ("m", "p", "q", "bound", "words"))):
                for row in _compare(sorted(((x["word"], x["n"]) for x in members), key=lambda x: (-x[1], x[0])), m, p, q, bound):
                    for column, value in zip(out.values(), row):
                        column.append(value)
            return out
        return work

    met = map_batches(blocks(words, most), "word string, n_near long, best string, best_n long", start)
    best = F.min(F.struct((-F.col("best_n")).alias("least"), "best"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select(
        "word", "n_near", F.col("_b.best").alias("best"), (-F.col("_b.least")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last by steps of doubling length."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        stepped = now.join(onward, F.col("root") == F.col("_from"), "left")
        now = materialise(stepped.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words with their counts."""
    met = words.join(neighbours(words, most), "word", "left")
    is_form = F.col("best_n") >= RATIO * F.col("n")
    met = materialise(met.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"),
                                 F.when(is_form, F.col("best_n")).alias("form_n")), "variants")
    last = roots(met.where("form is not null"))
    return met.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(documents: DataFrame, most: int = BLOCK) -> DataFrame:
    """Words of whole texts with their form, root and number of near words.

    Null and empty texts have no words; a null id counts as empty text where letters are dropped; repeated
    rows count each; the near word of largest count is the form, of equal ones the first in code-point order;
    an empty table gives an empty result; other columns are ignored.
    """
    return group(materialise(word_counts(documents), "words"), most)
