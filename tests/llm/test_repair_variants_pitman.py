"""Conversation repair, spelling variants and the Pitman-Yor model against brute force."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallyframe import session
from tallyframe.llm import pitman, repair, seating, sql, tokens, variants

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


# ---- conversations

def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str, list[tuple[str, int | None]]]:
    """Uniform-cost search over (rows done, state): initial, must go, truncated -> cost, edits, (role, row or None)."""
    follows = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, edits, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        for initial, role in (("u", "user"), ("a", "assistant")):
            if initial in follows[state]:
                heapq.heappush(heap, (cost + 5, edits + "I", i, initial, (*out, (role, None))))
        if i < len(rows):
            initial, must_go, truncated = rows[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, state, out))
            if not must_go:
                extra = 5 if truncated else 0
                if initial in follows[state]:
                    heapq.heappush(heap, (cost + extra, edits + "K", i + 1, follows[state][initial], (*out, ("", i))))
                for new, role in (("u", "user"), ("a", "assistant")):
                    if new in follows[state]:
                        heapq.heappush(heap, (cost + 1 + extra, edits + "R", i + 1, new, (*out, (role, i))))
    raise AssertionError


def expected_repairs(rows):
    """The contract for (conv_id, turn, role, text) rows."""
    found, talks = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv]
        kind = crc(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}") % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        talks[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, turns in talks.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
        seen, faults, coded = set(), [], []
        for _, role, text in turns:
            words = WORD.findall(text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            coded.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, edits, out = cheapest(coded)
        known = [t for t, *_ in turns if t is not None]
        lines = [f"{role or turns[i][1]}:{'' if i is None else turns[i][2]}" for role, i in out]
        found[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                       sum(a[:1] + b[:1] not in ("su", "ua", "au") for (_, a, _), (_, b, _) in itertools.pairwise(turns)), cost, edits,
                       hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def audited(frame, **more):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.audit(frame, **more).collect()}


def talks(seed: int, conversations: int, longest: int):
    rng = random.Random(seed)
    texts = ["Hello.", "Hello.", "What now?", "cut off", "", " \t", "fine!", "naïve … ok.", None]
    rows = []
    for conv in [None, *range(conversations)]:
        for _ in range(rng.randrange(1, longest)):
            rows.append((conv, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "u"]), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


TALK = "conv_id long, turn long, role string, text string"


def test_repairs_equal_a_search_whatever_the_blocks(spark):
    rows = talks(1, 40, 14)
    frame = spark.createDataFrame(rows, TALK).repartition(3)
    wanted = expected_repairs(rows)
    assert audited(frame) == wanted
    assert audited(frame, block_bits=1, fan=2) == wanted


def test_a_conversation_over_many_blocks_and_levels(spark):
    rng = random.Random(2)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), f"line {i if rng.random() < 0.8 else 0}{rng.choice(['.', '', '!'])}") for i in range(700)]
    frame = spark.createDataFrame(rows, TALK).repartition(5)
    assert audited(frame, block_bits=3, fan=3) == expected_repairs(rows) == audited(frame)


def test_crossings_are_on_the_least_way():
    desk = repair.Desk()
    rng = random.Random(3)
    for _ in range(300):
        codes = tuple(rng.randrange(4) + rng.choice([0, 0, 4, 8]) for _ in range(rng.randrange(1, 12)))
        cost, edits, _ = desk.repaired(codes, repair.START, None)
        wanted = cheapest([("sua?"[c & 3], bool(c & 4), bool(c & 8)) for c in codes])
        assert (cost, edits) == wanted[:2]


def test_repaired_turns_come_as_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Oh."), (3, 1, "user", "So?")]
    turns = repair.ordered(spark.createDataFrame(rows, TALK))
    fixed = repair.repair(turns, repair.edits(repair.blocks(repair.judged(turns))))
    out = defaultdict(list)
    for r in fixed.orderBy("conv_id", "at", "number").collect():
        out[r["conv_id"]].append((r["edit"], r["role"], r["text"]))
    assert out == {1: [("K", "user", "Hi."), ("K", "assistant", "Yes.")]}  # a lone turn is dropped for less than it takes to answer it


def test_no_conversations_and_other_columns(spark):
    assert audited(spark.createDataFrame([], TALK)) == {}
    rows = talks(4, 5, 6)
    wide = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TALK + ", edit string, at long, fault string")
    assert audited(wide) == expected_repairs(rows)


def test_conversation_that_loses_everything(spark):
    turn = next(t for t in range(1000) if crc(f"1:{t}") % 20 == 0)
    assert audited(spark.createDataFrame([(1, turn, "user", "Hi.")], TALK)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


# ---- spelling variants

def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected_variants(rows):
    counts = Counter()
    for number, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            code = crc(f"{'' if number is None else number}:{run}")
            counts[run[:code % len(run)] + run[code % len(run) + 1:] if code % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: sorted((-words[x], x) for x in words if one_edit(w, x)) for w in words}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 10 * words[w] else None for w in words}

    def root(w):
        return root(form[w]) if form[w] else w
    return {w: (n, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items()}


def grouped(frame, **more):
    return {r["word"]: tuple(r[c] for c in ("n", "n_near", "form", "form_n", "root")) for r in variants.variants(frame, **more).collect()}


@pytest.mark.parametrize("most", [512, 3])
def test_variants_equal_all_pairs(spark, most):
    rng = random.Random(6)
    stems = ["wonderful", "WONDERS", "aaaaaaa", "aaaabaaa", "élèveÉcole", "question", "questions"]

    def word():
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w = rng.choice([w[:at] + rng.choice("abé") + w[at:], w[:at] + w[at + 1:], w[:at] + rng.choice("ab") + w[at + 1:]])
        return w
    rows = [(rng.choice([None, *range(50)]), " ".join(word() + rng.choice(["", ",", "1", "'s"]) for _ in range(rng.randrange(80)))) for _ in range(60)]
    rows += [(1, None), (2, ""), (3, "wonderful " * 4000), (None, "wonderful"), (4, "x" * 3000 + " " + "x" * 3000)]
    frame = spark.createDataFrame([(*r, "clash", 3, "clash") for r in rows], "doc_id long, text string, word string, n int, form string")
    assert grouped(frame, most=most) == expected_variants(rows)


def test_near_by_both_ends():
    rng = random.Random(7)
    for m, longer in ((7, 7), (7, 8), (9, 10)):
        pool = ["".join(rng.choice("ab") for _ in range(n)) for n in (m, longer) for _ in range(60)]
        a, b = sorted({w for w in pool if len(w) == m}), sorted({w for w in pool if len(w) == longer})
        found = variants.near(variants._matrix(a), variants._matrix(b), 0, 0, 1 << 30)
        assert found.tolist() == [[one_edit(x, y) for y in b] for x in a]


def test_no_words(spark):
    assert grouped(spark.createDataFrame([], "doc_id long, text string")) == {}
    assert grouped(spark.createDataFrame([(1, None), (2, "short"), (3, "onlyonce")], "doc_id long, text string")) == {}


# ---- language model

def test_tokens_are_numbered_by_their_lower_case_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 16)
    texts = ["The the THE", None, "", " \t\n", "Éa éa a\x0bb", "x" * 100, "ÉA", "a  b", "z"]
    numbers, rows = tokens.Hasher().words(pa.array(texts))
    seen, at = {}, 0
    for row, text in enumerate(texts):
        for word in [*WORD.findall((text or "").encode().lower().decode()), None]:
            assert rows[at] == row and seen.setdefault(word, numbers[at]) == numbers[at]
            at += 1
    assert at == len(numbers) and len(set(seen.values())) == len(seen) and seen[None] == tokens.END
    sliced, _ = tokens.Hasher().words(pa.array(["skip", *texts]).slice(1))
    assert sliced.tolist() == numbers.tolist()


def test_packing_is_lossless():
    arrays = [np.array([], dtype=np.int32), np.arange(-5, 900, dtype=np.int64), np.array([1.5, -0.0, 1e300]), np.array([7], dtype=np.uint64), np.arange(9, dtype=np.int16)]
    for a, b in zip(arrays, tokens.unpack(tokens.pack(*arrays))):
        assert a.dtype == b.dtype and a.tobytes() == b.tobytes()


def test_ways_to_seat_are_generalised_stirling_numbers():
    def ways(c, t, d):
        return float(t == 0) if c == 0 else 0.0 if not 0 < t <= c else ways(c - 1, t - 1, d) + (c - 1 - t * d) * ways(c - 1, t, d)
    table = seating.stirling(0.4, 8)
    for c in range(1, 9):
        for t in range(1, c + 1):
            assert math.isclose(math.exp(table[c, t]), ways(c, t, 0.4), rel_tol=1e-9)


def test_drawn_tables_follow_the_seating_process():
    """Shares over many draws against the exact conditional, for a small dish, and against a plain simulation for a large one."""
    rng, strength, d, parent, others = np.random.default_rng(1), 0.7, 0.5, 0.2, 3
    ways = seating.stirling(d)
    n = 20_000
    drawn = seating.draw_tables(np.full(n, 4), np.full(n, others), np.full(n, parent), strength, d, ways, rng)
    weight = [math.exp(ways[4, t]) * math.prod(strength + d * (others + j) for j in range(t)) * parent ** t for t in range(1, 5)]
    share = np.bincount(drawn, minlength=5)[1:] / n
    assert np.abs(share - np.array(weight) / sum(weight)).max() < 0.015
    few = seating.draw_tables(np.full(3_000, 60), np.full(3_000, others), np.full(3_000, parent), strength, d, ways, rng).mean()
    many = seating._seat_groups(np.full(3_000, 60), np.full(3_000, strength + d * others), np.full(3_000, parent), d, rng).mean()
    assert abs(few - many) < 0.12 * few
    assert (seating.draw_tables(np.array([0, 1]), np.array([0, 0]), np.array([0.1, 0.1]), strength, d, ways, rng) == [0, 1]).all()


def test_strength_is_found_again():
    rng = np.random.default_rng(2)
    truth, d, customers, tables = 5.0, 0.3, [], []
    for _ in range(600):
        t = 0
        for i in range(40):
            t += rng.random() < (truth + d * t) / (truth + i)
        customers.append(40)
        tables.append(t)
    now, seen = 1.0, []
    for i in range(200):
        now = seating.draw_strength(now, d, np.array(customers), np.array(tables), rng)
        seen += [now] if i > 50 else []
    assert abs(np.mean(seen) - truth) < 0.8


def base_of(rows):
    counts, split = Counter(), {}
    for i, (number, text) in enumerate(rows):
        words = [*WORD.findall((text or "").encode("utf-8", "surrogatepass").lower().decode()), None]
        split[i] = words
        if crc("" if number is None else str(number)) % 7 != 2:
            counts.update(words)
    total, vocabulary = sum(counts.values()), len(counts)
    return [(number, crc("" if number is None else str(number)) % 7 == 2, len(split[i]), sum(counts[w] > 0 for w in split[i]), total,
             round(sum(math.log10((counts[w] + 1) / (total + vocabulary + 1)) for w in split[i]), 6)) for i, (number, _) in enumerate(rows)]


def scored(frame):
    return [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in frame]


def test_base_scores_and_counts(spark, monkeypatch):
    monkeypatch.setattr(pitman, "BUCKET_TOKENS", 400)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)] + ["The", "the", "É"]
    rows = [(rng.choice([None, *range(60)]), " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for _ in range(150)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "same same"), (4, "same same"), (5, "long " * 5000)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, bucket string, batch int").repartition(4)
    found = pitman.score(frame).collect()
    assert sorted(scored(found), key=repr) == sorted(base_of(rows), key=repr)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    again = pitman.score(frame).collect()
    assert sorted((repr(r["doc_id"]), r["score"]) for r in again) == sorted((repr(r["doc_id"]), r["score"]) for r in found)


def test_no_documents_and_nothing_to_learn_from(spark):
    assert pitman.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(i for i in range(100) if crc(str(i)) % 7 == 2)
    only, = pitman.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (only["held_out"], only["n_tokens"], only["n_known"], only["train_tokens"]) == (True, 3, 0, 0)
    assert abs(only["score"]) < 1e-9 and abs(only["base_score"]) < 1e-9  # the unknown word is all there is


def test_probabilities_behind_each_context_add_up(spark):
    """Over all known words and one unknown, in every context and in their parent."""
    learn, rng = [i for i in range(5000) if crc(str(i)) % 7 != 2], random.Random(9)
    words = [f"w{i}" for i in range(12)]
    rows = [(learn[i], " ".join(rng.choice(words[:1 + i % 12]) for _ in range(6))) for i in range(300)]
    shared, buckets = _model(spark, rows)
    for context in range(len(shared.contexts)):
        total, tables = 0.0, shared.tables[context]
        above = {}
        for b in buckets:
            p = b.predictive(shared)
            total += p[(b.context == context)].sum()
            parent = b.parents(shared)
            for i, word in enumerate(b.word):
                if b.context[i] == context:
                    above[(id(b), word)] = parent[word]
        # words without a pair here get the restaurant's spare part of the parent's rest
        spare = (shared.strength + shared.discount * tables) / (shared.strength + shared.customers[context])
        assert abs(total + spare * (1 - sum(above.values())) - 1) < 1e-9
    everything = sum(shared.parent_probability(shared.word_customers, shared.word_tables)) + shared.parent_probability(np.zeros(1), np.zeros(1))[0]
    assert abs(everything - 1) < 1e-9


def _model(spark, rows):
    """The state after the sweeps; all words are frequent here."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    shared = pitman.survey(frame)
    parts = pitman.materialise(pitman.occurrences(frame, shared), "occurrences")
    direct = pitman._direct(parts, shared)
    states = pitman._gather(parts, shared)
    rng = np.random.default_rng(1)
    shared = pitman._total(states, shared, direct, rng, True)
    for number in range(2):
        states = pitman._swept(states, shared, number, False)
        shared = pitman._total(states, shared, direct, rng, False)
    assert int(shared.customers.sum() + direct.sum()) == shared.total
    return shared, [pitman.Bucket.opened(r["state"]) for r in states.select("state").collect()]


def test_every_predecessor_has_a_restaurant(spark, monkeypatch):
    """Rarer ones too, whose pairs lie in many buckets: customers and tables as counted over all, probabilities that add up."""
    monkeypatch.setattr(pitman, "WORD_SHARE", 0.02)
    monkeypatch.setattr(pitman, "BUCKET_TOKENS", 100)
    monkeypatch.setattr(pitman, "SHARD_BUCKETS", 4)
    rng, number = random.Random(12), lambda w: int(tokens.Hasher().words(pa.array([w]))[0][0])
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[:1 + (i * 7) % 60]) for _ in range(8))) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    after, pairs = Counter(), set()
    for i, text in rows:
        for a, b in itertools.pairwise([None, *text.split(), None]):
            pairs.add((a, b))
            after[a, b] += crc(str(i)) % 7 != 2
    shared = pitman.survey(frame.where("crc32(cast(doc_id as string)) % 7 <> 2"))
    known = {int(w): i for i, w in enumerate(shared.words)}
    rare = [w for w in words if number(w) not in known]
    assert shared.buckets > 8 and shared.shards > 2 and len(rare) > 20 and len(known) > 5
    states = pitman._gather(pitman.materialise(pitman.occurrences(frame, shared), "occurrences"), shared)
    links = sums = pitman._linked(states)
    rng = np.random.default_rng(1)
    shared = pitman._total(states, shared, np.zeros(len(known), dtype=np.int64), rng, True)
    for step in range(3):
        states = pitman._swept(states, shared, step, False, sums)
        sums = pitman._exchanged(states, links, shared, step)
        shared = pitman._total(states, shared, np.zeros(len(known), dtype=np.int64), rng, False, sums)
    assert sum(len(tokens.unpack(r["payload"])[3]) for r in links.where("bucket < 0").collect()) == len(rare)
    met = defaultdict(list)
    for r in pitman._met(states, sums).orderBy("bucket", "shard").collect():
        met[r["bucket"]].append(r["payload"])
    whole, seen = defaultdict(list), 0
    for state, *payloads in met.values():
        b = pitman.Bucket.opened(state)
        b.received(payloads)
        customers, tables = (v[b.context] for v in b.restaurants(shared))
        seen += len(b.context)
        for i in np.flatnonzero(b.context < 0):
            whole[int(customers[i]), int(tables[i])].append((int(b.customers[i]), int(b.tables[i]), float(b.predictive(shared)[i]), float(b.parents(shared)[b.word[i]])))
    assert seen == len(pairs)
    # contexts with equal sums lie together, so many times their customers and tables
    wanted = Counter()
    for (a, _), n in after.items():
        wanted[a] += n
    assert sorted(k[0] for k, v in whole.items() for _ in range(round(sum(c for c, *_ in v) / k[0]) if k[0] else 0)) == sorted(wanted[w] for w in rare if wanted[w])
    for (customers, tables), found in whole.items():
        n = round(sum(c for c, *_ in found) / customers) if customers else 0
        assert sum(c for c, *_ in found) == n * customers and sum(t for _, t, *_ in found) == n * tables
        spare = (shared.strength + shared.discount * tables) / (shared.strength + customers)
        if n:
            assert abs(sum(p for *_, p, _ in found) + spare * (n - sum(up for *_, up in found)) - n) < 1e-9


def test_scores_leave_the_last_sweep_only(spark, monkeypatch, tmp_path):
    """A sweep's tables go once the next has read them, occurrences are not kept beside their buckets, and no job leaves its shuffles."""
    monkeypatch.setattr(pitman, "BUCKET_TOKENS", 400)
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    frame = spark.createDataFrame([(i, " ".join(f"w{i * j % 60}" for j in range(i % 40))) for i in range(200)], "doc_id long, text string")
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen, swept = spark.conf.get(setting), [], pitman._swept

    def watched(*args):
        seen.append((spark.conf.get(setting), Counter(f.name.split("-")[0] for f in tmp_path.iterdir())))
        return swept(*args)

    monkeypatch.setattr(pitman, "_swept", watched)
    found = pitman.score(frame)
    left = Counter(f.name.split("-")[0] for f in tmp_path.iterdir())
    assert left == {"wordcounts": 1, "buckets": 1, "links": 1, "sweep": 1, "sums": 1}
    assert len(seen) == pitman.BURN + pitman.SAMPLES and all(on == "true" and n["sweep"] <= 1 and n["sums"] <= 1 for on, n in seen)
    assert spark.conf.get(setting) == before
    assert found.count() == 200


def test_only_tables_of_the_shared_folder_are_released(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path / "shared"))
    kept, gone = tmp_path / "other", session.materialise(spark.range(3), "gone")
    spark.range(3).write.parquet(str(kept))
    session.release(spark.read.parquet(str(kept)))
    session.release(gone)
    assert spark.read.parquet(str(kept)).count() == 3 and list((tmp_path / "shared").iterdir()) == []


def test_kept_seatings_give_the_mean():
    """Each seating counts with what was shared at its time, also after a bucket was packed and opened."""
    words = np.array([5, 9], dtype=np.uint64)
    shareds = [pitman.Shared(words, np.array([4, 4]), 8, 3, 1, np.array([6, 5]), np.array([2, 2 + i]), np.array([3, 2]), np.array([1, 1 + i]), 6 + i, 3) for i in range(3)]
    bucket = pitman.Bucket(*(np.array(x) for x in ([0, 1, -1, 0], [3, 5, 400, 0], [1, 2, 9, 0], [2, 2], [1, -1], [0, 3], [0], [70_000], [9])))
    wanted = np.zeros(4)
    for i, shared in enumerate(shareds):
        bucket.tables[:2], bucket.word_tables[1], bucket.rare_tables = [1 + i, 2 + i], 3 + i, np.array([9 + i])
        wanted += bucket.predictive(shared) / 3
        bucket.keep()
        bucket = pitman.Bucket.opened(bucket.packed())
    assert np.allclose(bucket.mean(shareds), wanted, rtol=1e-12)
    with pytest.raises(ValueError):
        bucket.mean(shareds[:2])


def test_singles_of_a_text_of_very_many_words_are_the_same():
    """Numbers too wide for one key are sorted by columns."""
    rng = np.random.default_rng(4)
    word, before, code = rng.integers(0, 40, 500), rng.integers(0, 40, 500), rng.integers(0, 6, 500)
    wide = 1 << 29
    narrow, far = pitman._singles(word, before, code), pitman._singles(word * wide, before * wide, code)
    assert all((a * n == b).all() for a, b, n in zip(narrow, far, (wide, wide, 1, 1)))
    assert sorted(zip(*map(list, narrow))) == sorted((*k, n) for k, n in Counter(zip(word, before, code)).items())


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    found = pitman.score(spark.read.parquet(f"{FOLDER}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


@pytest.mark.parametrize("table,query,run", [
    ("conversations", sql.OP11, lambda d: repair.audit(d)), ("documents", sql.OP12, lambda d: variants.variants(d))])
def test_sql_gives_the_same_rows(spark, table, query, run):
    db = duckdb.connect()
    db.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    found = run(spark.read.parquet(f"{FOLDER}/{table}.parquet"))
    wanted = db.execute(query)
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(repr, wanted.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in found.collect())
