"""Toxicity by a learnt lexicon, Levenshtein automata and context windows.

Words, and word beginnings shared by several words, that occur in toxic training documents far more than
chance allows form the lexicon, a trie. The Levenshtein automaton over that trie runs over every word of
a text: its states are sets of (trie node, edits spent), made when first needed and remembered, and most
words end in the dead state after a few letters. A window around each hit scores whether the term is
quoted or reported rather than meant, and a logistic model turns the hits of a text into its score.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm import neardup
from tallyframe.llm.common import map_batches, remainder
from tallyframe.llm.learning import labelled_sample, logistic
from tallyframe.session import materialise

#: labelled documents that are learnt from at most
TRAINING_ROWS = 12_000
#: a term must be this unlikely (as a negative logarithm) to gather in toxic documents by chance
SURPRISE = 12.0
PURITY = 0.8
#: letters of a term at least; shorter words only count as neighbours
LEAST_LETTERS = 3
#: words that must share a beginning for it to become an entry
SHARING = 3
PARTS = 5
#: letters before and after a hit that are read for its context
WINDOW = 60

_WORD = re.compile(r"\w+")
_QUOTES = '"“”„«»‘’'
_REPORTED = re.compile(r"\b(?:said|says|wrote|writes|quote|quoted|called|word|term|sagte|schrieb|zitat|wort|dijo|escribió|cita|palabra|dit|écrit|mot)\b")
_ADDRESSED = re.compile(r"\b(?:you|your|du|dich|dein|ihr|tu|te|toi|vous|usted|eres)\b")


def _edits(length: int) -> int:
    return 1 if length < 9 else 2


class FuzzyLexicon:
    """A trie of terms and the lazily made automaton of all words within a term's edit distance.

    ``terms`` gives each entry's weight and the edits it tolerates. Entries that end in ``*`` are beginnings:
    any word that starts with one exactly is a hit.
    """

    #: states and words remembered before starting anew
    REMEMBERED = 500_000

    def __init__(self, terms: dict[str, tuple[float, int]]):
        self._children: list[dict[str, int]] = [{}]
        self._ends: list[str | None] = [None]
        self._begins: list[str | None] = [None]
        self._terms = terms
        self._allowed, self._most = [0], [0]
        for term, (_, edits) in sorted(terms.items()):
            node, word = 0, term.rstrip("*")
            self._most[0] = max(self._most[0], edits)
            for letter in word:
                if letter not in self._children[node]:
                    self._children[node][letter] = len(self._children)
                    self._children.append({})
                    self._ends.append(None)
                    self._begins.append(None)
                    self._allowed.append(0)
                    self._most.append(0)
                node = self._children[node][letter]
                self._most[node] = max(self._most[node], edits)
            if term.endswith("*"):
                self._begins[node] = term
            else:
                self._ends[node], self._allowed[node] = term, edits
        self._forget()

    def _forget(self) -> None:
        self._states: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._steps: list[dict[str, int]] = []
        self._accept: list[tuple[str, int] | None] = []
        self._words: dict[str, tuple[str, int] | None] = {}
        self._start = self._state({0: 0})

    def _state(self, places: dict[int, int]) -> int:
        """The number of the state that holds these nodes, after adding what skipping letters of a term reaches."""
        open_ = list(places)
        while open_:
            node = open_.pop()
            spent = places[node] + 1
            for child in self._children[node].values():
                if spent <= self._most[child] and places.get(child, 9) > spent:
                    places[child] = spent
                    open_.append(child)
        key = frozenset(places.items())
        if key not in self._states:
            self._states[key] = len(self._sets)
            self._sets.append(key)
            self._steps.append({})
            exact = [(self._begins[n], 0) for n, e in key if e == 0 and self._begins[n] is not None]
            ends = [(self._ends[n], e) for n, e in key if self._ends[n] is not None and e <= self._allowed[n]]
            self._accept.append(min(exact + ends, key=lambda x: (x[1], -self._terms[x[0]][0], x[0])) if exact or ends else None)
        return self._states[key]

    def _step(self, state: int, letter: str) -> int:
        places: dict[int, int] = {}
        for node, spent in self._sets[state]:
            if self._begins[node] is not None and spent == 0:
                places[node] = 0  # a beginning has been read: whatever follows is a hit
            elif spent < self._most[node]:
                places[node] = min(places.get(node, 9), spent + 1)
            for other, child in self._children[node].items():
                cost = spent + (other != letter)
                if cost <= self._most[child] and cost < places.get(child, 9):
                    places[child] = cost
        found = self._state(places) if places else -1
        self._steps[state][letter] = found
        return found

    def within(self, word: str) -> list[tuple[str, int]]:
        """Every full term that tolerates the edits to this word, and their number."""
        state = self._start
        for letter in word:
            following = self._steps[state].get(letter)
            state = self._step(state, letter) if following is None else following
            if state < 0:
                return []
        return [(self._ends[n], e) for n, e in self._sets[state] if self._ends[n] is not None and e <= self._allowed[n]]

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest entry and its edits, or None."""
        known = self._words.get(word, 0)
        if known != 0:
            return known
        if len(self._words) >= self.REMEMBERED or len(self._sets) >= self.REMEMBERED:
            self._forget()
        state = self._start
        for letter in word:
            following = self._steps[state].get(letter)
            state = self._step(state, letter) if following is None else following
            if state < 0:
                break
        found = self._accept[state] if state >= 0 else None
        self._words[word] = found
        return found


def quotation(text: str, start: int, end: int) -> float:
    """How much the window around a hit looks like quoting or reporting (0 to 1) rather than abuse."""
    before, after = text[max(0, start - WINDOW):start], text[end:end + WINDOW]
    quoted = any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES)
    score = -2.0 + 2.5 * quoted + 1.5 * bool(_REPORTED.search(before)) - 1.5 * bool(_ADDRESSED.search(before + " " + after))
    return 1 / (1 + math.exp(-score))


def hits(lexicon: FuzzyLexicon, text: str | None) -> list[tuple[int, int, str, int, float]]:
    """(start, end, entry, edits, quotation) of every hit in a whole text."""
    lowered = (text or "").lower()
    match = lexicon.match
    bad = {w for w in set(_WORD.findall(lowered)) if match(w) is not None}
    if not bad:
        return []
    return [(*m.span(), *match(m.group()), quotation(lowered, *m.span())) for m in _WORD.finditer(lowered) if m.group() in bad]


FEATURES = 4
#: what a misspelt hit counts
MISSPELT = 0.95


def features(terms: dict[str, tuple[float, int]], lexicon: FuzzyLexicon, text: str | None) -> list[float]:
    found = hits(lexicon, text)
    meant = [(terms[t][0], (1 - q) * (MISSPELT if e else 1.0)) for _, _, t, e, q in found]
    return [1.0, math.log1p(sum(m for _, m in meant)), max((w * m for w, m in meant), default=0.0),
            math.log1p(sum(q > 0.5 for *_, q in found))]


def lexicon_terms(sample: DataFrame) -> dict[str, tuple[float, int]]:
    """Entries with their log-odds and the edits they tolerate, from (text, y) rows.

    Of a class of near copies (whole texts, by their fingerprints) one text of each label counts, so that
    their shared rare words are not taken for evidence. An entry whose neighbours by edits occur in clean documents tolerates no edits, whatever its
    length. Beginnings stand beside the full terms, and each needs evidence without its strongest word. The table of counts stays in Spark; only accepted entries reach the driver, which the bounded sample bounds.
    """
    keyed = sample.select(F.xxhash64("text").alias("key"), "text", "y")
    classes = neardup.classes(keyed.dropDuplicates(["key"]), id="key").select(F.col("doc_id").alias("key"), "component_id")
    once = materialise(keyed.join(classes, "key").groupBy("component_id", "y").agg(F.min_by("text", "key").alias("text")), "once")
    words = once.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("word"))
    counts = materialise(words.groupBy("word").agg(F.sum(F.col("y").cast("long")).alias("toxic"), F.sum(1 - F.col("y")).cast("long").alias("clean")), "words")
    totals = once.agg(F.sum(F.col("y").cast("long")), F.sum(1 - F.col("y").cast("long"))).first()
    if not totals[0] or not totals[1]:
        return {}
    base = totals[0] / (totals[0] + totals[1])
    begins = counts.select(F.explode(F.transform(F.sequence(F.lit(4), F.lit(7)), lambda n: F.when(
        F.char_length("word") > n, F.concat(F.substring("word", F.lit(1), n), F.lit("*"))))).alias("word"), "toxic", "clean").where("word is not null")
    begins = begins.groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > 0).alias("sharing"),
        F.max(F.struct("toxic", "clean")).alias("top")).where(F.col("sharing") >= SHARING)
    def gathers(toxic, clean):
        share = F.try_divide(toxic, toxic + clean)
        surprise = (toxic + clean) * (share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0))
        return (toxic > 0) & (share >= PURITY) & (share > base) & (surprise >= SURPRISE)

    begins = begins.where(gathers(F.col("toxic") - F.col("top.toxic"), F.col("clean") - F.col("top.clean"))).select("word", "toxic", "clean")
    weight = F.log((F.col("toxic") + 0.1) / (F.col("clean") + 0.1) * (1 - base) / base)
    full = counts.where(F.char_length("word") >= LEAST_LETTERS)
    rows = full.unionByName(begins).where(gathers(F.col("toxic"), F.col("clean"))).select(
        "word", weight.alias("weight")).collect()
    terms = {r["word"]: (float(r["weight"]), 0 if r["word"].endswith("*") else _edits(len(r["word"]))) for r in rows}

    def start():
        lexicon = FuzzyLexicon(terms)

        def work(batch):
            found = [(m, t, c) for w, t, c in zip(batch["word"], batch["toxic"], batch["clean"])
                     if (nearest := lexicon.match(w)) and nearest[1] for m in lexicon.within(w)]
            return {"term": [m[0] for m, *_ in found], "toxic": [t for _, t, _ in found], "clean": [c for *_, c in found]}
        return work

    near = map_batches(counts, "term string, toxic long, clean long", start).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strict = {r["term"] for r in near.where(F.col("toxic") < PURITY * (F.col("toxic") + F.col("clean"))).collect()}
    return {t: (w, 0 if t in strict else e) for t, (w, e) in terms.items()}


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> tuple[dict[str, tuple[float, int]], list[float]]:
    """Lexicon and weights, learnt from at most about ``rows`` labelled documents outside the held-out fold."""
    sample = materialise(labelled_sample(documents, labels, remainder("doc_id", PARTS) != 0, rows, "toxic"), "toxic")
    terms = lexicon_terms(sample)
    columns = [f"f{i}" for i in range(FEATURES)]

    def start():
        lexicon = FuzzyLexicon(terms)
        return lambda batch: {"y": batch["y"], **dict(zip(columns, zip(*(features(terms, lexicon, t) for t in batch["text"]))))}

    found = map_batches(sample.select("text", F.col("y").cast("double").alias("y")), "y double, " + ", ".join(f"{c} double" for c in columns), start).collect()
    if not found:
        return terms, [-30.0] + [0.0] * (FEATURES - 1)
    # rows in a stated order, so that sums agree between runs
    table = np.array(sorted(tuple(r) for r in found))
    return terms, logistic(table[:, 1:], table[:, 0]).tolist()


def score(documents: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts have no hits and get the score of such texts; repeated rows get the same score; an
    empty table gives an empty result; without labels every score is next to zero; other columns are
    ignored.
    """
    rows = documents.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    terms, weights = train(rows, labels)
    out = rows.select("doc_id", "text", (remainder("doc_id", PARTS) == 0).alias("held_out"))

    def start():
        lexicon = FuzzyLexicon(terms)

        def one(value):
            f = features(terms, lexicon, value)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * x for w, x in zip(weights, f))))))

        def work(batch):
            scores = [one(t) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}
        return work

    return map_batches(out, f"doc_id {out.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int", start)
