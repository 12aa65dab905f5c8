"""Personal data by weak supervision.

Plain rules give base spans, which always stay. Broader patterns give further candidates, and six
labelers (format, check digits and ranges, gazetteer, words before, words that speak against it,
borders) vote on each candidate or abstain. Votes and shape of a candidate form a pattern; Spark counts
the patterns over all texts, and expectation-maximisation over these counts estimates how reliable each
labeler is and how probable each pattern is personal data. A logistic span classifier trained on those
probabilities decides. There are at most ``PATTERNS`` patterns, whatever the number of texts, so the counts
and the decisions are small and bounded.

All patterns are scanned in time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import map_batches
from tallyframe.session import materialise

KINDS = ("email", "ip", "card", "phone")
LABELERS = 6
_SHAPES = 12
PATTERNS = len(KINDS) * 3**LABELERS * _SHAPES
#: a candidate becomes a span if the classifier gives it this much
THRESHOLD = 0.8
STEPS = 50

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SPELT_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?(?:\(at\)|\[at\]) ?| at | @ ?|@ )"
    r"[A-Za-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.)[A-Za-z0-9-]{1,63}){1,8}(?![A-Za-z0-9-])")
_LONG_IP = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])")
_CARD_GROUP = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|3[0-9]{3}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])")
_PHONE_GROUP = re.compile(
    r"(?<![0-9A-Za-z.+(-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9A-Za-z])")

#: domains' last labels, calling codes and first digits of cards that are in common use
_ENDINGS = frozenset("com org net edu gov info biz io de fr es uk it nl eu ch at be us ca au".split())
_CALLING = ("1", "33", "34", "44", "49", "39", "31", "41", "43", "32", "61", "7", "81", "86", "91")
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35", "22")
_FOR = {
    "email": re.compile(r"mail|contact|write|kontakt|contacto|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|adresse", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobil|handy|whatsapp|sms", re.I),
}
_AGAINST = re.compile(r"version|isbn|issn|section|chapter|token|password|secret|order|invoice|serial|\bid\b|\bno\.|#", re.I)
_WINDOW = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ so that a long run of letters is read once."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        after = found.end() if found else at + 1
        at = text.find("@", after)


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.split("."))
    digits = _digits(found)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15 if kind == "phone" else True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain rules, by kind and start; code points, end exclusive."""
    spans = [(0, *s) for s in _emails(text)]
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        spans += [(kind, *m.span()) for m in pattern.finditer(text) if _valid(KINDS[kind], m.group())]
    return spans


def _candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    out = [(*s, True) for s in base]
    for kind, pattern in ((0, _SPELT_EMAIL), (1, _LONG_IP), (2, _CARD_GROUP), (3, _PHONE_GROUP)):
        taken = {s[1:] for s in base if s[0] == kind}
        out += [(kind, *m.span(), False) for m in pattern.finditer(text) if m.span() not in taken]
    return out


def _pattern(text: str, kind: int, start: int, end: int, base: bool) -> int:
    """Votes (0 abstains, 1 against, 2 for) and shape as one number."""
    name, found, digits = KINDS[kind], text[start:end], _digits(text[start:end])
    before = text[max(0, start - _WINDOW):start]
    if name == "email":
        ending = re.split(r"[^A-Za-z]+", found)[-1].lower()
        valid, known = bool(re.search(r"[A-Za-z]", found)), ending in _ENDINGS
    elif name == "ip":
        valid = _valid("ip", found) if "." in found else True
        known = not re.match(r"0|127\.|255\.", found)
    elif name == "card":
        valid, known = 13 <= len(digits) <= 19 and luhn(digits), digits.startswith(_ISSUERS)
    else:
        valid, known = 8 <= len(digits) <= 15, found[0] != "+" or digits.startswith(_CALLING)
    sides = text[start - 1:start] + text[end:end + 1]
    glued = any(c.isalnum() or c in "_=/@" for c in sides)
    votes = (2 if base else 0, 2 if valid else 1, 2 if known else 1, 2 if _FOR[name].search(before) else 0,
             1 if _AGAINST.search(before) else 0, 1 if glued else 2)
    code = 0
    for vote in votes:
        code = code * 3 + vote
    marks = sum(not c.isalnum() for c in found)
    shape = min(2, marks // 2) * 4 + min(3, max(0, len(found) - 8) // 4)
    return (kind * 3**LABELERS + code) * _SHAPES + shape


def candidates(documents: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and, as flat lists of (kind, start, end), base spans and other candidates with their patterns."""
    return _with_candidates(documents.select(F.col(id).alias("doc_id"), F.col(text).alias("_text")), ["doc_id"])


def _with_candidates(rows: DataFrame, keep: list[str], mark: str = "") -> DataFrame:
    """The columns to keep, and the candidates of ``_text`` in columns whose names begin with ``mark``."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    names = [mark + n for n in ("base", "others", "patterns")]
    schema = ", ".join([kinds, *(f"{n} array<int>" for n in names)])

    def start():
        def one(value: str | None) -> tuple[list[int], list[int], list[int]]:
            value = value or ""
            base = base_spans(value)
            found = _candidates(value, base)
            return ([x for s in base for x in s], [x for s in found if not s[3] for x in s[:3]],
                    [_pattern(value, *s) for s in sorted(found, key=lambda s: s[3])])

        def work(batch):
            found = [one(t) for t in batch["_text"]]
            return {c: batch[c] for c in keep} | {n: [f[i] for f in found] for i, n in enumerate(names)}
        return work

    return map_batches(rows, schema, start)


def _votes(pattern: int) -> tuple[int, list[int], int]:
    rest, shape = divmod(pattern, _SHAPES)
    votes = []
    for _ in range(LABELERS):
        rest, vote = divmod(rest, 3)
        votes.append(vote)
    return rest, votes[::-1], shape


def reliabilities(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns of one kind.

    Returns the probability that each pattern is personal data and, per labeler, how often it votes
    against, abstains or votes for, given the truth. A weak prior says labelers are mostly right.
    """
    prior = np.stack([np.tile([4.0, 8.0, 2.0], (votes.shape[1], 1)), np.tile([4.0, 2.0, 8.0], (votes.shape[1], 1))], axis=1)
    margin = (votes == 2).sum(axis=1) - (votes == 1).sum(axis=1) - 0.5
    truth = 1 / (1 + np.exp(-1.5 * margin))
    for _ in range(STEPS):
        rates = prior.copy()
        for y, weight in ((1, truth * counts), (0, (1 - truth) * counts)):
            for vote in range(3):
                rates[:, y, vote] += ((votes == vote) * weight[:, None]).sum(axis=0)
        rates /= rates.sum(axis=2, keepdims=True)
        share = (np.sum(truth * counts) + 1) / (counts.sum() + 2)
        score = np.log(share / (1 - share))
        score = score + sum(np.log(rates[i, 1, votes[:, i]] / rates[i, 0, votes[:, i]]) for i in range(votes.shape[1]))
        truth = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return truth, rates


def fit(found: DataFrame) -> frozenset[int]:
    """The patterns that the span classifier accepts, from the pattern counts of all candidates."""
    rows = found.select(F.explode("patterns").alias("pattern")).groupBy("pattern").count().collect()
    accepted = []
    for kind in range(len(KINDS)):
        mine = sorted((r["pattern"], r["count"]) for r in rows if _votes(r["pattern"])[0] == kind)
        if not mine:
            continue
        parsed = [_votes(p) for p, _ in mine]
        votes, counts = np.array([v for _, v, _ in parsed]), np.array([float(c) for _, c in mine])
        truth, _ = reliabilities(votes, counts)
        features = np.concatenate([np.ones((len(mine), 1)), *[(votes == v).astype(float) for v in (1, 2)], np.eye(_SHAPES)[[s for _, _, s in parsed]]], axis=1)
        weights = np.zeros(features.shape[1])
        mass = counts / counts.sum()
        ridge = 1e-3 / len(weights) * np.eye(len(weights))
        for _ in range(25):  # Newton steps of a ridge logistic regression on the probabilities
            p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
            gradient = features.T @ (mass * (p - truth)) + ridge @ weights
            weights -= np.linalg.solve((features * (mass * p * (1 - p))[:, None]).T @ features + ridge, gradient)
        accepted += [p for (p, _), score in zip(mine, 1 / (1 + np.exp(-features @ weights))) if score >= THRESHOLD]
    return frozenset(accepted)


def _all_spans(base: list[int], others: list[int], patterns: list[int], accepted: frozenset[int]) -> list[tuple[int, int, int, bool]]:
    """Base spans and accepted candidates that touch none of them, by kind and start."""
    spans = [(base[i], base[i + 1], base[i + 2], True) for i in range(0, len(base), 3)]
    if others:
        taken = sorted(s[1:3] for s in spans)
        starts, reach = [a for a, _ in taken], [0, *accumulate((b for _, b in taken), max)]
        free = 0  # where the last added span ends
        for i in sorted(range(0, len(others), 3), key=lambda i: (others[i + 1], -others[i + 2])):
            kind, start, end = others[i : i + 3]
            # of the base spans that begin before this one ends, none reaches beyond its start
            if patterns[i // 3] in accepted and start >= free and reach[bisect_left(starts, end)] <= start:
                spans.append((kind, start, end, False))
                free = end
    return sorted(spans)


def find(documents: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans: an array of (kind, start, end, base), by kind in the order of ``KINDS`` and start.

    Null and empty texts have no spans; repeated rows get the same spans; an empty table gives an empty
    result; other columns are ignored. Spans of different kinds may overlap only among base spans.
    """
    found = materialise(candidates(documents, id=id, text=text), "candidates")
    accepted = fit(found)
    kind = found.schema["doc_id"].dataType.simpleString()

    def start():
        def work(batch):
            spans = [_all_spans(b, o, p, accepted) for b, o, p in zip(batch["base"], batch["others"], batch["patterns"])]
            return {"doc_id": batch["doc_id"], "spans": [
                [{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in x] for x in spans]}
        return work

    return map_batches(found, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>", start)


def digests(spans: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [number(kind).alias(f"n_{kind}") for kind in KINDS]
    return spans.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e, _ in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows with their texts redacted, each text searched once.

    A null text stays null, an empty one empty; equal texts are redacted alike, whatever their rows; an
    empty table gives an empty result; other columns stay as they are.
    """
    columns = documents.columns
    found = materialise(_with_candidates(documents.withColumn("_text", F.col(text)), columns, "_"), "candidates")
    accepted = fit(found.select(F.col("_patterns").alias("patterns")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)

    def start():
        def one(value: str | None, base: list[int], others: list[int], patterns: list[int]) -> str | None:
            return redacted(value, _all_spans(base, others, patterns, accepted)) if value else value

        return lambda batch: {c: batch[c] for c in columns} | {
            text: [one(*row) for row in zip(batch[text], batch["_base"], batch["_others"], batch["_patterns"])]}

    return map_batches(found, schema, start)
