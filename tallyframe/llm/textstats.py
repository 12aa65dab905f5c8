"""Counts over one whole text."""

from __future__ import annotations

import numpy as np

from tallyframe.llm.common import WORDS

SYMBOLS = "#*$%&|<>"


def repeated_positions(numbers: np.ndarray, width: int = 3) -> np.ndarray:
    """Which positions lie in a window of ``width`` numbers that occurs twice or more."""
    covered = np.zeros(len(numbers), dtype=bool)
    if len(numbers) < width:
        return covered
    codes, span = numbers[: len(numbers) - width + 1].astype(np.int64), int(numbers.max()) + 1
    for offset in range(1, width):
        codes = codes * span + numbers[offset : len(numbers) - width + 1 + offset]
        if offset < width - 1 and len(codes) * span >= 1 << 31:
            codes = np.unique(codes, return_inverse=True)[1]
    _, where, count = np.unique(codes, return_inverse=True, return_counts=True)
    again = count[where] > 1
    for offset in range(width):
        covered[offset : offset + len(again)] |= again
    return covered


def numbered(words: list[str]) -> tuple[np.ndarray, int]:
    """Words as numbers in order of first use, and how many there are."""
    seen: dict[str, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64), len(seen)


def measure(text: str | None) -> dict[str, int]:
    """The counts from which rules and classifiers start; null is measured as empty."""
    text = text or ""
    words = WORDS.findall(text)
    numbers, distinct = numbered(words)
    seen, repeated_lines, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORDS.search(line):
            lines += 1
            repeated_lines += line in seen
            seen.add(line)
    solid = "".join(words)
    upper = sum(map(str.isupper, words))
    counts = np.bincount(numbers) if words else np.zeros(1, dtype=np.int64)
    return {
        "n_chars": len(text), "n_words": len(words), "word_chars": len(solid),
        "n_symbols": sum(map(text.count, SYMBOLS)), "n_lines": lines, "n_dup_lines": repeated_lines,
        "n_repeat_words": int(repeated_positions(numbers).sum()) if words else 0,
        "n_distinct": distinct, "n_upper": upper, "n_top": int(counts.max()),
        "n_twice": int((numbers[1:] == numbers[:-1]).sum()) if words else 0,
        "n_marks": sum(map(text.count, ".,;:!?")), "n_shout": text.count("!"),
        "n_digits": sum(map(text.count, "0123456789")),
    }
