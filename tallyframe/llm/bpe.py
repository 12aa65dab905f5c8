"""Byte-level BPE by backtracking over longest token matches, and decoding through an offset table.

The Aho-Corasick automaton of the vocabulary finds the longest token at every byte that the walk comes to. Encoding
walks from left to right with the longest match; a token is kept if the merges would really leave it
and its left neighbour as two tokens (the pair-compatibility table), else its next shorter prefix is
tried, and when none is left the walk steps back by one token. A byte position from which no way leads
on is marked, so the work is linear in the piece.

The vocabulary is read once on the driver and sent to the tasks: its size is that of the file, not of
the data. Texts are never cut; pieces are encoded once per task and looked up afterwards.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tallyframe.llm.common import map_batches

#: pieces a task remembers before it starts anew, and the longest piece it remembers
REMEMBERED = 200_000
REMEMBERED_CHARS = 64

# white space as Unicode defines it, which differs from Python's \s in U+001C to U+001F
_BLANK = r"\t-\r \x85\xa0  -     　"
#: runs between blanks, with the one space that belongs to them
_RUNS = rf" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """Bytes of each id, the two parts of each merged id (or None), ids of special texts."""

    tokens: list[bytes]
    parts: list[tuple[int, int] | None]
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters, vocabulary = _byte_letters(), content["model"]["vocab"]
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        size = max([*vocabulary.values(), *special.values()]) + 1
        tokens: list[bytes] = [b""] * size
        for letter_text, number in vocabulary.items():
            tokens[number] = bytes(letters[c] for c in letter_text)
        for content_text, number in special.items():
            tokens[number] = content_text.encode()
        parts: list[tuple[int, int] | None] = [None] * size
        for merge in content["model"]["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            parts[vocabulary[left + right]] = (vocabulary[left], vocabulary[right])
        # the walk compares ids for age, so merges must be numbered in their order
        ages = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in content["model"]["merges"]]
        if ages != sorted(ages) or any(p is not None and max(p) >= i for i, p in enumerate(parts)):
            raise ValueError("Vocabulary ids do not follow the order of its merges")
        return cls(tokens, parts, special)


def _little(numbers: array) -> bytes:
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        import regex

        self._parts, special = vocabulary.parts, set(vocabulary.special.values())
        self._pairs = {p: i for i, p in enumerate(vocabulary.parts) if p is not None}
        self._ids = {t.decode("latin-1"): i for i, t in enumerate(vocabulary.tokens) if t and i not in special}
        self._lengths, self._most = [len(t) for t in vocabulary.tokens], max(map(len, self._ids), default=0)
        self._matches = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, number in self._ids.items():
            self._matches.add_word(token, number)
        self._matches.make_automaton()
        # the longest token that each beginning of a token begins with, or -1
        self._best = {"": -1}
        for token in self._ids:
            for n in range(1, len(token) + 1):
                if (start := token[:n]) not in self._best:
                    self._best[start] = self._ids.get(start, self._best[token[:n - 1]])
        self._compatible: dict[int, bool] = {}
        self._tokens, self._special = [t.decode("latin-1") for t in vocabulary.tokens], vocabulary.special
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        self._runs, self._pieces = re.compile(_RUNS), regex.compile(_PIECES)
        self._seen: dict[str, bytes] = {}
        self._ids_of: dict[str, bytes] = {}

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens as they are.

        Going back in time, the token at the border on either side is split into its parts, the younger
        first. A merge of the two that touch at some time takes place if it is older than the merge that
        ends its left part, and no younger than the one that ends its right part.
        """
        key = left << 32 | right
        left_end = right_end = len(self._parts)
        apart = True
        while True:
            merged = self._pairs.get((left, right))
            if merged is not None and merged < left_end and merged <= right_end:
                apart = False
                break
            older = self._parts[left], self._parts[right]
            if older[0] is not None and (left > right or older[1] is None):
                left_end, left = left, older[0][1]
            elif older[1] is not None:
                right_end, right = right, older[1][0]
            else:
                break
        if len(self._compatible) > 2_000_000:
            self._compatible.clear()
        self._compatible[key] = apart
        return apart

    def _piece(self, piece: str) -> list[int]:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1")
        whole = self._ids.get(letters)
        if whole is not None:
            return [whole]
        size, most, tokens, lengths, known, best, reach = len(letters), self._most, self._tokens, self._lengths, self._compatible, self._best, self._matches.longest_prefix
        # the automaton says how far tokens reach from a place
        dead, out, place, token, last = set(), [], 0, best[letters[:reach(letters[:most])]], -1
        while token >= 0:
            end = place + lengths[token]
            if end not in dead:
                apart = last < 0 or known.get(last << 32 | token)
                if self._stay_apart(last, token) if apart is None else apart:
                    out.append(token)
                    if end == size:
                        return out
                    last, place, token = token, end, best[letters[end:end + reach(letters[end:end + most])]]
                    continue
            token = best[tokens[token][:-1]]  # the next shorter one
            if token < 0:
                # no way leads on from here: the token before is tried again and, its end being dead, shortened
                dead.add(place)
                if not out:
                    raise ValueError("The vocabulary lacks single bytes")
                token = out.pop()
                place -= lengths[token]
                last = out[-1] if out else -1
        return out

    def _run(self, run: str) -> bytes:
        """One run; its pieces are looked up too, as a word occurs with many marks behind it."""
        if run.isascii() and run[run[0] == " ":].isalpha():  # one piece, as most runs are
            found = self._ids_of.get(run) or self._new(run)
        else:
            found = b"".join([self._ids_of.get(piece) or self._new(piece) for piece in self._pieces.findall(run)])
        if len(run) <= REMEMBERED_CHARS:
            if len(self._seen) >= REMEMBERED:
                self._seen.clear()
            self._seen[run] = found
        return found

    def _new(self, piece: str) -> bytes:
        found = _little(array("I", self._piece(piece)))
        if len(piece) <= REMEMBERED_CHARS:
            if len(self._ids_of) >= REMEMBERED:
                self._ids_of.clear()
            self._ids_of[piece] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, seen = [], self._seen.get
        for i, part in enumerate(self._cut.split(text or "") if self._cut else [text or ""]):
            if i % 2:
                out.append(np.array([self._special[part]], dtype="<u4").tobytes())
            else:
                out += [seen(run) or self._run(run) for run in self._runs.findall(part)]
        return b"".join(out)


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        lengths = np.array([len(t) for t in vocabulary.tokens], dtype=np.int64)
        self._bytes = np.frombuffer(b"".join(vocabulary.tokens), dtype=np.uint8)
        self._starts = np.concatenate(([0], np.cumsum(lengths)))

    def decode(self, ids: bytes | np.ndarray) -> str:
        numbers = np.frombuffer(ids, dtype="<u4") if isinstance(ids, bytes) else ids
        if not len(numbers):
            return ""
        starts = self._starts[numbers]
        lengths = self._starts[numbers + 1] - starts
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
        return self._bytes[places].tobytes().decode("utf-8", "replace")


def encode(documents: DataFrame, vocabulary: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """The other columns and the ids of every whole text (null and empty: no ids).

    Rows pass one by one, so repeated rows, ties and empty tables need no care; a column named as the
    new one is replaced.
    """
    return _with(documents, vocabulary, text, f"`{ids}` array<int>", lambda e, d, t: {ids: np.frombuffer(e.encode(t), "<u4").tolist()})


def decode(tokens: DataFrame, vocabulary: str, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """The other columns and the text of every list of ids (null: empty text)."""
    return _with(tokens, vocabulary, ids, f"`{text}` string", lambda e, d, i: {text: d.decode(np.array(i or [], dtype=np.int64))})


def digests(documents: DataFrame, vocabulary: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, encoded and decoded again."""
    def of(encoder: Encoder, decoder: Decoder, value: str | None) -> dict:
        ids = encoder.encode(value)
        return {"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(),
                "decoded_sha256": hashlib.sha256(decoder.decode(ids).encode()).hexdigest()}

    rows = documents.select(documents[id].alias("doc_id"), documents[text].alias("text"))
    return _with(rows, vocabulary, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", of)


def _with(rows: DataFrame, path: str, source: str, added: str, of) -> DataFrame:
    vocabulary = rows.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    names = [c.rsplit(" ", 1)[0].strip(" `") for c in added.split(",")]
    kept = [f for f in rows.schema.fields if f.name != source and f.name not in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), added])

    def start():
        encoder, decoder = Encoder(vocabulary.value), Decoder(vocabulary.value)

        def work(batch):
            found = [of(encoder, decoder, value) for value in batch[source]]
            return {**{f.name: batch[f.name] for f in kept}, **{n: [x[n] for x in found] for n in names}}
        return work

    return map_batches(rows.select(*(f"`{f.name}`" for f in kept), f"`{source}`"), schema, start)
