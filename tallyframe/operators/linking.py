"""Linking questions to tables and metrics.

The vocabulary is part of the contract, so scores are plain expressions on the question
column: no join, no shuffle, one pass over the questions whatever their number.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.contract import AMOUNT_WORDS, GLOSSARY, LABEL_STOPWORDS, METRIC_LABELS, TABLES

_METRIC_TABLE = "transactions"


def normalise(question: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(question), r"(?U)\s+", " "))


def label_words(label: str) -> list[str]:
    """Words of a metric label that say something about its subject."""
    return [w for w in re.findall(r"[a-z]+", label.lower()) if len(w) >= 4 and w not in LABEL_STOPWORDS]


def label_matches(label: str, question: Column) -> Column:
    """A distinctive label word starts a word of the (lower-case) question."""
    words = label_words(label)
    if not words:
        return F.lit(False)
    # most questions contain none of the words anywhere and never meet the pattern
    return _any(question, tuple(words)) & question.rlike(rf"(?U)\b(?:{'|'.join(words)})")


def _any(question: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [question.contains(p.lower()) for p in phrases])


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0))


def table_scores(question: Column) -> dict[str, Column]:
    """Score per table in declared order; ``question`` must be normalised."""
    scores = {}
    for name, table in TABLES.items():
        parts = [_points(question.contains(term.lower()), 1) for term in (name.replace("_", " "), *table.synonyms)]
        for phrases, targets in GLOSSARY.values():
            if name in targets:
                parts.append(_points(_any(question, phrases), 2 * targets.count(name)))
        if name == _METRIC_TABLE:
            parts += [_points(label_matches(label, question), 1) for label in METRIC_LABELS.values()]
            parts.append(_points(_any(question, AMOUNT_WORDS), 2))
        scores[name] = reduce(lambda a, b: a + b, parts)
    return scores


def lexicon_scores(questions: DataFrame, text: str = "question") -> DataFrame:
    """The questions with one ``score_<table>`` column per table."""
    normal = questions.withColumn("_normal", normalise(F.col(text)))
    scored = normal.select("*", *[c.alias(f"score_{t}") for t, c in table_scores(F.col("_normal")).items()])
    return scored.drop("_normal")


def link_tables(scored: DataFrame, limit: int = 2, prior: str | None = None) -> DataFrame:
    """Add ``relations``: the best-scored tables, else the previous turn's, else transactions.

    Equal scores keep the declared order. Four tables per row are ranked inside the row.
    """
    if limit < 1:
        raise ValueError("limit must be at least one")
    ranked = F.array(*[
        F.struct((-F.col(f"score_{name}")).alias("order"), F.lit(i).alias("position"), F.lit(f"main.{name}").alias("name"))
        for i, name in enumerate(TABLES)
    ])
    scored_names = F.transform(
        F.slice(F.sort_array(F.filter(ranked, lambda t: t["order"] < 0)), 1, limit), lambda t: t["name"])
    choices = [F.when(F.size(scored_names) > 0, scored_names)]
    if prior:
        declared = F.array(*[F.lit(f"main.{name}") for name in TABLES])
        known = F.slice(F.array_intersect(declared, F.col(prior)), 1, limit)
        choices.append(F.when(F.size(known) > 0, known))
    return scored.withColumn("relations", F.coalesce(*choices, F.array(F.lit(f"main.{_METRIC_TABLE}"))))


def resolve_metric(question: Column) -> Column:
    """Label of the first declared metric whose label matches the question, else NULL."""
    lower = F.lower(question)
    outcome = None
    for label in METRIC_LABELS.values():
        test = label_matches(label, lower)
        outcome = F.when(test, F.lit(label)) if outcome is None else outcome.when(test, F.lit(label))
    return outcome


# The sentences that are proposed.
_FALLBACK_SUGGESTION = "Show recorded transaction count by transaction method."
MAX_SUGGESTIONS = 3
MAX_SUGGESTION_LENGTH = 200


def suggest(question: Column, relations: Column, year: Column) -> Column:
    """Up to three rule-based follow-ups for a question and the tables it used."""
    lower = F.lower(question)
    period = F.coalesce(year, F.lit("the selected period"))
    first = F.get(relations, F.lit(0))
    rules = F.array(
        F.when(first.contains("transaction"),
               F.concat(F.lit("Show monthly recorded transaction count for "), period, F.lit("."))),
        F.when(lower.contains("spend") | lower.contains("amount"),
               F.concat(F.lit("Compare net signed recorded amount with positive recorded amounts for "), period, F.lit("."))),
        F.when(F.array_contains(relations, "main.mcc_codes") | lower.contains("category"),
               F.lit("Break the recorded amounts down by merchant category.")),
    )
    found = F.slice(F.array_compact(rules), 1, MAX_SUGGESTIONS)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(_FALLBACK_SUGGESTION)))
