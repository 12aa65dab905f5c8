"""Words of whole texts as 64-bit numbers, by array operations over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: the number of the end of a text
END = np.uint64(1)
#: bytes that are hashed together, so few that their sums stay in a core's cache; a longer word extends its piece
PIECE = 1 << 15

_RNG = np.random.default_rng(20)
_LETTERS = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS[:, 65:91] = _LETTERS[:, 97:123]  # A to Z count as a to z
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_SOLID = np.ones(256, dtype=bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Polynomials over a word's bytes in two bases, from running sums; powers are kept for the next piece."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones((2, 0), dtype=np.uint64)

    def _grow(self, length: int) -> None:
        if self.powers.shape[1] >= length:
            return
        steps = np.ones((2, length), dtype=np.uint64)
        back = np.ones((2, length), dtype=np.uint64)
        for row, base in enumerate(_BASES):
            steps[row, 1:], back[row, 1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.powers, self.inverses = np.cumprod(steps, axis=1, dtype=np.uint64), np.cumprod(back, axis=1, dtype=np.uint64)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the words between starts and ends; pieces end with a word."""
        out = np.empty(len(starts), dtype=np.uint64)
        first = 0
        while first < len(starts):
            base = starts[first]
            last = max(first + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
            piece = data[base:ends[last - 1]]
            self._grow(len(piece) + 1)
            a, b = starts[first:last] - base, ends[first:last] - base
            found = np.zeros(last - first, dtype=np.uint64)
            for row in range(2):
                sums = np.zeros(len(piece) + 1, dtype=np.uint64)
                np.cumsum(_LETTERS[row][piece] * self.powers[row, :len(piece)], out=sums[1:])
                found = mixed(found + (sums[b] - sums[a]) * self.inverses[row][a])
            out[first:last] = found
            first = last
        return out

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number, row) of every word in order, with one end after each row's words; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
        edges = offsets - offsets[0]
        solid = _SOLID[data]
        start, end = solid.copy(), solid.copy()
        start[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        inner = edges[(edges > 0) & (edges < len(data))]
        start[inner] |= solid[inner]
        end[inner - 1] |= solid[inner - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        rows = np.searchsorted(edges, starts, side="right") - 1
        at = np.searchsorted(rows, np.arange(len(texts)), side="right")
        return np.insert(self.numbers(data, starts, ends), at, END), np.insert(rows, at, np.arange(len(texts)))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, byte by byte of all values and compressed."""
    parts = []
    for array in arrays:
        array = np.ascontiguousarray(array)
        raw = array.view(np.uint8).reshape(len(array), array.itemsize).T.tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        parts += [np.array([len(array), len(small)], dtype=np.int64).tobytes(), array.dtype.str.encode().ljust(8), small]
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        count, small = (int(x) for x in np.frombuffer(data, dtype=np.int64, count=2, offset=at))
        kind, at = np.dtype(data[at + 16:at + 24].decode().strip()), at + 24
        raw = pa.decompress(data[at:at + small], decompressed_size=count * kind.itemsize, codec="zstd", asbytes=True) if count else b""
        out.append(np.frombuffer(raw, dtype=np.uint8).reshape(kind.itemsize, count).T.copy().view(kind).ravel() if count else np.zeros(0, dtype=kind))
        at += small
    return out
