"""Language identification by a bidirectional gated recurrent network over bytes.

Both directions read windows of bytes; every position gets a probability for each language from the
two states that meet there, and a document's probabilities are the means over all its positions. The
network is trained in numpy by backpropagation through time on windows from anywhere in a bounded set of
texts; scoring reads every window of every text, many windows at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import map_batches, remainder
from tallyframe.session import materialise

PARTS, HELD = 3, 1
#: distinct texts that are learnt from, about, shared equally by the languages; of each language at least so many
TRAINING_ROWS = 3_000
LANGUAGE_ROWS = 60
#: bytes the network reads as one sequence, units per direction, windows computed together
WINDOW = 96
UNITS = 10
TOGETHER = 2048
STEPS, BATCH, RATE, SEED = 300, 128, 0.02, 7
UNDETERMINED = "und"


@dataclass
class Direction:
    """What each byte adds to the update, reset and new-state sums; recurrent weights; weights of the languages."""

    byte: np.ndarray
    state: np.ndarray
    out: np.ndarray


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    bias: np.ndarray

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.bias, *(w for d in (self.forward, self.backward) for w in (d.byte, d.state, d.out))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _new(languages: list[str], rng: np.random.Generator) -> Network:
    def direction() -> Direction:
        return Direction(*(rng.normal(0, s, shape).astype(np.float32) for s, shape in (
            (0.3, (256, 3 * UNITS)), (1 / np.sqrt(UNITS), (UNITS, 3 * UNITS)), (0.3, (UNITS, len(languages))))))
    return Network(languages, direction(), direction(), np.zeros(len(languages), dtype=np.float32))


def _step(d: Direction, letters: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    a, u = d.byte[letters], h @ d.state
    gates = _sigmoid(a[:, :2 * UNITS] + u[:, :2 * UNITS])
    z, r, un = gates[:, :UNITS], gates[:, UNITS:], u[:, 2 * UNITS:]
    n = np.tanh(a[:, 2 * UNITS:] + r * un)
    return n + z * (h - n), z, r, n, un


def _sums(d: Direction, by_place: np.ndarray, lengths: np.ndarray, reverse: bool) -> np.ndarray:
    """(position, language, window) sums of one direction; backwards, a state is zero before its bytes begin.

    Units are rows and windows columns here, so that all work on a state is over contiguous numbers; the
    halving inside the gates' sigmoid is moved into their weights.
    """
    size, count = by_place.shape
    halved = np.r_[np.full(2 * UNITS, 0.5), np.ones(UNITS)].astype(np.float32)
    byte, state, to_out = (np.ascontiguousarray(x, dtype=np.float32) for x in ((d.byte * halved).T, (d.state * halved).T, d.out.T))
    h, a, u = (np.zeros((n, count), dtype=np.float32) for n in (UNITS, 3 * UNITS, 3 * UNITS))
    out = np.empty((size, to_out.shape[0], count), dtype=np.float32)
    gates, z, r, new = a[:2 * UNITS], a[:UNITS], a[UNITS:2 * UNITS], a[2 * UNITS:]
    shortest = int(lengths.min())
    for t in range(size - 1, -1, -1) if reverse else range(size):
        np.take(byte, by_place[t], axis=1, out=a, mode="clip")
        np.matmul(state, h, out=u)
        gates += u[:2 * UNITS]
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        r *= u[2 * UNITS:]
        new += r
        np.tanh(new, out=new)
        h -= new
        h *= z
        h += new
        if reverse and t >= shortest:
            h *= t < lengths
        np.matmul(to_out, h, out=out[t])
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def cut(text: bytes) -> np.ndarray:
    """All windows of a text, the last one filled with zeros."""
    count = -(-len(text) // WINDOW)
    out = np.zeros(count * WINDOW, dtype=np.uint8)
    out[:len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out.reshape(count, WINDOW)


def positions(network: Network, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(position, language, window) probabilities; positions beyond a window's length are zero."""
    by_place = np.ascontiguousarray(windows.T)
    found = _sums(network.forward, by_place, lengths, False)
    found += _sums(network.backward, by_place, lengths, True)
    found += network.bias.astype(np.float32)[:, None]
    found -= found.max(axis=1, keepdims=True)
    np.exp(found, out=found)
    found /= found.sum(axis=1, keepdims=True)
    if lengths.min() < len(by_place):
        found *= (np.arange(len(by_place))[:, None] < lengths)[:, None, :]
    return found


def pooled(network: Network, texts: list[bytes]) -> np.ndarray:
    """Per text, the mean probability of each language over all its bytes (zeros for an empty text)."""
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    total = np.zeros((len(texts), len(network.languages)))
    held, held_owner, held_length, size = [], [], [], 0

    def flush() -> None:
        nonlocal held, held_owner, held_length, size
        if size:
            windows, who, lengths = np.concatenate(held), np.concatenate(held_owner), np.concatenate(held_length)
            for at in range(0, len(windows), TOGETHER):
                part = slice(at, at + TOGETHER)
                np.add.at(total, who[part], positions(network, windows[part], lengths[part]).sum(axis=0, dtype=np.float64).T)
        held, held_owner, held_length, size = [], [], [], 0

    for number, text in enumerate(texts):
        if text:
            windows = cut(text)
            lengths = np.full(len(windows), WINDOW)
            lengths[-1] = len(text) - (len(windows) - 1) * WINDOW
            held.append(windows)
            held_owner.append(np.full(len(windows), number))
            held_length.append(lengths)
            size += len(windows)
            if size >= 8 * TOGETHER:
                flush()
    flush()
    return total / np.maximum(counts, 1)[:, None]


def _gradients(network: Network, windows: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and its gradients by backpropagation through time; every position of full windows is labelled."""
    size, count = windows.shape[1], len(windows)
    kept, sums = [], network.bias + np.zeros((size, count, len(network.languages)), dtype=np.float32)
    for d, order in ((network.forward, range(size)), (network.backward, range(size - 1, -1, -1))):
        h, trace = np.zeros((count, UNITS), dtype=np.float32), []
        for t in order:
            before = h
            h, *rest = _step(d, windows[:, t], h)
            trace.append((t, before, h, *rest))
            sums[t] += h @ d.out
        kept.append(trace)
    p = _softmax(sums)
    rows = np.arange(count)
    loss = float(-(np.log(p[:, rows, truth] + 1e-9) * weight).mean())
    error = p
    error[:, rows, truth] -= 1
    error *= (weight / (size * count))[None, :, None]
    gradients = [error.sum(axis=(0, 1))]
    one_hot = np.eye(256, dtype=np.float32)
    for d, trace in zip((network.forward, network.backward), kept):
        to_byte, to_state, to_out = np.zeros_like(d.byte), np.zeros_like(d.state), np.zeros_like(d.out)
        dh = np.zeros((count, UNITS), dtype=np.float32)
        for t, before, h, z, r, n, un in reversed(trace):
            to_out += h.T @ error[t]
            dh = dh + error[t] @ d.out.T
            dn = dh * (1 - z) * (1 - n * n)
            dz, dr = dh * (before - n) * z * (1 - z), dn * un * r * (1 - r)
            by_byte = np.concatenate([dz, dr, dn], axis=1)
            by_state = np.concatenate([dz, dr, dn * r], axis=1)
            to_byte += one_hot[windows[:, t]].T @ by_byte
            to_state += before.T @ by_state
            dh = dh * z + by_state @ d.state.T
        gradients += [to_byte, to_state, to_out]
    return loss, gradients


def drawn(texts: list[bytes], which: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A full window of each chosen text, from anywhere in it; a shorter text is repeated."""
    out = np.empty((len(which), WINDOW), dtype=np.uint8)
    for row, i in enumerate(which):
        text = np.frombuffer(texts[i], dtype=np.uint8)
        at = rng.integers(0, max(1, len(text) - WINDOW + 1))
        out[row] = text[at:at + WINDOW] if len(text) >= WINDOW else np.resize(text, WINDOW)
    return out


def fit(texts: list[bytes], truth: np.ndarray, languages: list[str], steps: int = STEPS) -> Network:
    """A network trained by Adam on windows of whole texts; languages weigh the same however many texts they have."""
    rng = np.random.default_rng(SEED)
    network = _new(languages, rng)
    counts = np.bincount(truth, minlength=len(languages)).astype(np.float32)
    weights = (counts.sum() / (len(languages) * np.maximum(counts, 1))).astype(np.float32)
    first, second = [[np.zeros_like(p) for p in network.parts] for _ in range(2)]
    for step in range(1, steps + 1):
        chosen = rng.integers(0, len(texts), BATCH)
        _, gradients = _gradients(network, drawn(texts, chosen, rng), truth[chosen], np.minimum(weights[truth[chosen]], 20))
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)) + 0.05)
        for p, g, m, v in zip(network.parts, gradients, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def training_texts(documents: DataFrame, rows: int = TRAINING_ROWS, least: int = LANGUAGE_ROWS) -> DataFrame:
    """(lang, text) of distinct texts outside the held-out fold, chosen by their hash, a bounded number of each language."""
    known = documents.where(F.col("lang").isNotNull() & (F.coalesce(F.octet_length("text"), F.lit(0)) > 0) & (remainder("doc_id", PARTS) != HELD))
    hashed = known.select("lang", "text", F.xxhash64("text").alias("hash"))
    sizes = hashed.select("lang", "hash").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialise(sizes, "languages")
    quota = max(least, rows // max(1, sizes.count()))
    shares = sizes.select("lang", F.floor(F.least(F.lit(1.0), F.lit(float(quota)) / F.col("n")) * float(1 << 30)).alias("share"))
    picked = hashed.join(shares, "lang").where(F.pmod(F.xxhash64("hash", F.lit("sample")), F.lit(1 << 30)) < F.col("share"))
    return picked.groupBy("lang", "hash").agg(F.first("text").alias("text")).select("lang", "text")


def train(documents: DataFrame, rows: int = TRAINING_ROWS) -> Network | None:
    """A network learnt from whole texts of about ``rows`` documents, or a few of each language if those are more."""
    found = sorted((r["lang"], r["text"].encode("utf-8", "surrogatepass")) for r in training_texts(documents, rows).collect())
    if not found:
        return None
    languages = sorted({lang for lang, _ in found})
    number = {x: i for i, x in enumerate(languages)}
    return fit([text for _, text in found], np.array([number[lang] for lang, _ in found]), languages)


def identify(documents: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    Only text and lang of rows outside the fold are learnt from, every language that has such rows, and
    repeated texts once. Null texts and texts without a letter are ``und`` with score 0, as is everything if no row has a
    language to learn from; repeated rows get the same result; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = documents.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    network = train(rows)
    out = rows.select("doc_id", "text", (remainder("doc_id", PARTS) == HELD).alias("held_out"))

    def start():
        def work(batch):
            readable = [bool(t) and any(map(str.isalpha, t)) and network is not None for t in batch["text"]]
            texts = [t.encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(batch["text"], readable)]
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if network is not None:
                found = pooled(network, texts)
                for i in np.flatnonzero(readable):
                    best = int(np.argmax(found[i]))
                    names[i], scores[i] = network.languages[best], min(1.0, float(found[i, best]))
            return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": names, "score": scores}
        return work

    return map_batches(out, f"doc_id {out.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double", start)
