"""Tables that ids do not tell apart, rare classes, and parts of the operators against plain rules."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import language, learning, mixing, neardup, pii, quality, sharding, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], DOCS).repartition(4)


# ---- languages

WORDS = {"aa": "bako deru fimo galu", "bb": "zxqv wrts plnk ghjt", "cc": "œuvéà çàîô ñüéè ôîçé"}


def spoken(rng, lang):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(12))


def test_languages_are_learnt_from_rows_without_ids_and_rare_ones_as_well(spark):
    rng = random.Random(1)
    rows = [(None, spoken(rng, "aa"), "aa", None) for _ in range(1500)] + [(None, spoken(rng, "bb"), "bb", None) for _ in range(1500)]
    rows += [(7 * i, spoken(rng, "cc"), "cc", None) for i in range(6)]  # one in five hundred
    learnt = language.training_texts(frame(spark, rows), rows=600, least=20).groupBy("lang").count().collect()
    sizes = {r["lang"]: r["count"] for r in learnt}
    assert set(sizes) == {"aa", "bb", "cc"} and 120 < sizes["aa"] < 300 and 120 < sizes["bb"] < 300 and 2 <= sizes["cc"] <= 6


def test_null_ids_are_no_switch(spark, monkeypatch):
    monkeypatch.setattr(language, "STEPS", 40)
    rng = random.Random(2)
    rows = [(None, spoken(rng, lang), lang, None) for lang in ("aa", "bb") for _ in range(2000)]
    found = Counter(r["lang_pred"] for r in language.identify(frame(spark, rows)).collect())
    assert found["und"] == 0 and abs(found["aa"] - 2000) < 100


def test_windows_come_from_anywhere_in_a_text():
    rng = np.random.default_rng(3)
    text = bytes(range(256)) * 4
    firsts = {w[0] for w in language.drawn([text, b"ab"], np.zeros(3000, dtype=np.int64), rng)}
    assert len(firsts) > 200
    assert bytes(language.drawn([text, b"ab"], np.array([1]), rng)[0]) == b"ab" * (language.WINDOW // 2)


def test_network_against_a_plain_recurrence():
    rng = np.random.default_rng(4)
    network = language._new(["x", "y", "z"], rng)
    network.bias[:] = rng.normal(0, 1, 3)
    text = bytes(rng.integers(0, 256, language.WINDOW + 30).astype(np.uint8))

    def states(d, letters):
        h, out = np.zeros(language.UNITS), []
        for b in letters:
            a, u, n = d.byte[b].astype(float), h @ d.state.astype(float), language.UNITS
            z, r = (1 / (1 + np.exp(-(a[i * n:(i + 1) * n] + u[i * n:(i + 1) * n]))) for i in range(2))
            new = np.tanh(a[2 * n:] + r * u[2 * n:])
            h = (1 - z) * new + z * h
            out.append(h)
        return np.array(out)

    total = np.zeros(3)
    for part in (text[:language.WINDOW], text[language.WINDOW:]):
        sums = network.bias + states(network.forward, part) @ network.forward.out + states(network.backward, part[::-1])[::-1] @ network.backward.out
        total += language._softmax(sums).sum(axis=0)
    assert np.allclose(language.pooled(network, [text])[0], total / len(text), atol=1e-5)


# ---- shards

def test_copies_without_ids_are_cut(spark):
    rng = random.Random(5)
    rows = [(None, "one and the same text", "en", "s")] * 4000 + [(i, "x" * rng.randrange(60), "en", "s") for i in range(4000)]
    found = sharding.shard_by_bytes(frame(spark, rows)).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(sizes.values()) / sharding.SHARDS
    assert len(found) == 8000 and len(sizes) == sharding.SHARDS and max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_cuts_equal_a_sorted_list(spark):
    """Which rows lie before each splitter, against sorting all of them."""
    rng = random.Random(6)
    rows = [(rng.randrange(9), rng.randrange(4), i, rng.randrange(1, 50)) for i in range(900)] + [(3, 1, 1000 + i, 30) for i in range(700)]
    table = spark.createDataFrame(rows, "key long, tie long, copy long, size long")
    total, goals = sum(r[3] for r in rows), 7
    for j, cut in enumerate(sharding.splitters(table, goals, 0.0), 1):
        below = sum(r[3] for r in rows if r[:3] < cut)
        ordered, near = sorted(rows), []
        running = 0
        for r in ordered:
            near.append(abs(running - total * j // goals))
            running += r[3]
        assert abs(below - total * j // goals) == min(near)


# ---- labelled samples

def test_samples_are_bounded_in_rows_and_distinct_texts(spark):
    rows = [(i % 50, f"text {i}", "en", "s") for i in range(20_000)] + [(3, "again", "en", "s")] * 500
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    sample = learning.labelled_sample(frame(spark, rows), labels, F.lit(True), 200, "toxic").collect()
    assert 130 < len(sample) < 280 and len({r["text"] for r in sample}) == len(sample)
    whole = learning.labelled_sample(frame(spark, rows), labels, F.lit(True), 10**6, "toxic").collect()
    assert len(whole) == 20_001 and {r["y"] for r in whole if r["text"] == "again"} == {0}


# ---- mixing

def test_equal_rows_are_drawn_like_others(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LAST_ROWS", 4)
    monkeypatch.setattr(mixing, "_RUN", 7)
    rows = [(None, "a b c d", "en", "s")] * 300 + [(i, "w " * (1 + i % 9), "en", "s") for i in range(300)] + [(i, "t u v", "en", "r") for i in range(200)]
    found = mixing.mix(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for source in {r["source_size"] for r in found}:
        mine = [r for r in found if r["source_size"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 9
        assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in mine)


def test_inclusion_follows_the_expected_copies(spark):
    """Over many seeds a document is taken about as often as its share says."""
    rows = [(i, "w " * (40 if i % 2 else 4), "en", "s") for i in range(600)] + [(1000 + i, "w " * 20, "en", "big") for i in range(600)]
    docs, taken, seeds = frame(spark, rows).coalesce(1), Counter(), 5
    for seed in range(seeds):
        for r in mixing.mix(docs, seed=seed).collect():
            taken["short" if r["size"] == 4 else "long" if r["size"] == 40 else "big"] += r["copies"]
    target = {r["size"]: r["target"] for r in mixing.mix(docs).collect()}
    liking = {n: max(0.8, min(1.25, (400 / n) ** 0.125)) for n in (4, 40, 20)}
    rate = {n: target[n] / (sum(m * liking[m] * 300 for m in (4, 40)) if n != 20 else 20 * liking[20] * 600) for n in (4, 40, 20)}
    for name, n, count in (("short", 4, 300), ("long", 40, 300), ("big", 20, 600)):
        assert abs(taken[name] / seeds / count - min(2.0, rate[n] * liking[n])) < 0.05


# ---- private data

def test_spans_of_one_text_take_linear_time():
    def seconds(n):
        base = [x for i in range(n // 2) for x in (0, 40 * i, 40 * i + 9)]
        others = [x for i in range(n) for x in (1, 20 * i + 5, 20 * i + 12)]
        begun = time.perf_counter()
        spans = pii._all_spans(base, others, [1] * n, frozenset([1]))
        return time.perf_counter() - begun, spans
    small, big = seconds(4_000)[0], seconds(32_000)[0]
    assert big < 24 * max(small, 0.004)


def test_added_spans_touch_none_that_is_taken():
    rng = random.Random(8)
    for _ in range(300):
        base = sorted((rng.randrange(4), a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(6))))
        others = [(rng.randrange(4), a, a + rng.randrange(1, 7)) for a in (rng.randrange(60) for _ in range(rng.randrange(9)))]
        patterns = [rng.randrange(2) for _ in others]
        found = pii._all_spans([x for s in base for x in s], [x for s in others for x in s], patterns, frozenset([1]))
        taken, wanted = [(a, b) for _, a, b in base], [(*s, True) for s in base]
        for (kind, a, b), p in sorted(zip(others, patterns), key=lambda x: (x[0][1], -x[0][2])):
            if p and not any(c < b and a < d for c, d in taken):
                wanted.append((kind, a, b, False))
                taken.append((a, b))
        assert found == sorted(wanted)


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "mail a.b@c.org now", "x", 1), (None, None, "y", 2), (1, "", None, 3), (1, "mail a.b@c.org now", "x", 1)]
    given = spark.createDataFrame(rows, "base long, text string, patterns string, others int")
    found = pii.redact(given)
    assert found.columns == given.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(b, t and t.replace("a.b@c.org", "[EMAIL]"), p, o) for b, t, p, o in rows], key=repr)


# ---- near copies in the pipeline

LONG = "there is a text of several words that nobody else has written down"


def test_near_copies_are_judged_by_text_not_by_id(spark):
    rows = [(1, LONG, "en", "a"), (1, "quite another text under the same number of course", "en", "a"), (2, LONG, "de", "b"),
            (None, "words without a number twice in here", "en", "a"), (None, "words without a number twice in here", "en", "a"),
            (None, LONG, "en", "c"), (5, None, "en", "a"), (6, "", "en", "a"), (7, "one", "en", "a"), (7, "one", "en", "a")]
    kept = corpus_pipeline.near_copies(spark, frame(spark, rows), "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted(
        [(1, LONG), (1, rows[1][1]), (None, rows[3][1]), (5, None), (7, "one")], key=repr)


def test_one_of_each_class_stays(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) for _ in range(40)]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts) + rng.choice(["", "", " tail"]), "en", rng.choice("ab")) for _ in range(300)]
    kept = neardup.keep_one(frame(spark, rows), corpus_pipeline.COLUMNS).collect()
    numbers = {t: neardup.fingerprint(t) for _, t, *_ in rows}
    root = {n: n for n in set(numbers.values())}
    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 2:
                low, high = sorted((root[a], root[b]))
                root = {n: low if r == high else r for n, r in root.items()}
    members = defaultdict(set)
    for i, t, *_ in rows:
        members[root[numbers[t]]].add(i)
    found = defaultdict(list)
    for r in kept:
        found[root[numbers[r["text"]]]].append(r["doc_id"])
    assert {c: ids for c, ids in found.items()} == {c: [min((i for i in m if i is not None), default=None)] for c, m in members.items()}


# ---- fingerprints

def test_fingerprint_is_the_vote_of_its_terms(spark):
    """Votes counted here over the same term hashes."""
    texts = ["a", "a b", "one two three four five", "x y z x y z x y z w", " \t spaced\nwords here "]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    terms = [(i, *(w[j + k] if j + k < len(w) else None for k in range(3))) for i, w in enumerate(words) for j in range(len(w))]
    hashed = spark.createDataFrame(terms, "i int, a string, b string, c string").select("i", F.xxhash64("a", "b", "c").alias("h")).collect()
    wanted = {}
    for i in range(len(texts)):
        mine = [r["h"] & (1 << 64) - 1 for r in hashed if r["i"] == i]
        wanted[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mine) > len(mine))
    found = simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ["i"]).collect()
    assert {r["i"]: r["number"] & (1 << 64) - 1 for r in found} == wanted


def test_rows_without_ids_are_spread_and_have_no_next(spark):
    rows = [(None, f"text number {i % 40}", "en", "s") for i in range(400)] + [(3, "abcdefgh", "en", "s"), (9, "12345678", "en", "s")]
    edited = simhash.edited(frame(spark, rows))
    assert edited.where("doc_id is null").select("key").distinct().count() == 40
    found = simhash.compare(frame(spark, rows)).collect()
    assert len(found) == len(rows) and all(r["near_next"] == 0 for r in found if r["doc_id"] is None)
    by_id = {r["doc_id"]: r["edited_sha256"] for r in found}
    assert by_id[3] == hashlib.sha256(b"abcdef12").hexdigest() and by_id[9] == hashlib.sha256(b"123456ab").hexdigest()


# ---- the additive model

def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(11)
    rows = rng.normal(0, 1, (400, len(quality.FEATURES)))
    model = quality.fit(rows, (rows[:, 0] * rows[:, 1] + rows[:, 2] > 0).astype(float))
    for row, score in zip(rows[:20], model.score(rows[:20])):
        total = model.start
        for j, table in enumerate(model.tables):
            total += table[sum(e <= row[j] for e in model.edges[j])]
        for (i, j), table in zip(model.pairs, model.pair_tables):
            total += table[sum(e <= row[i] for e in model.coarse[i])][sum(e <= row[j] for e in model.coarse[j])]
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    assert model.pairs and ((model.score(rows) > 0.5) == (rows[:, 0] * rows[:, 1] + rows[:, 2] > 0)).mean() > 0.85
