"""Terms in texts against looking for every term in every text."""

from __future__ import annotations

import random

from tallyframe.operators.term_index import contained_terms


def found(spark, texts, terms, **more):
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    v = spark.createDataFrame([(x,) for x in terms], "term string")
    rows = contained_terms(t, v, **more).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


def test_short_long_and_awkward_terms(spark):
    texts = ["abcabcabd", "", None, "naïve café\nnext line", "aaaa", "x.y*z", "ab", "😀ok😀"]
    terms = ["a", "ab", "abc", "abca", "abcabcabd", "abcabcabde", "é", "fé\nnext", ".y*", "aaaa", "aaaaa", "😀ok", "", None, "ab", "zzzz"]
    for run in (1, 2, 4):
        assert found(spark, texts, terms, run=run) == {(i, x) for i, t in enumerate(texts) for x in terms if t and x and x in t}
    assert found(spark, texts, [None, ""]) == set() and found(spark, [], ["a"]) == set()


def test_fifty_thousand_terms(spark):
    rng = random.Random(1)
    syllables = ["ba", "ko", "ri", "mu", "ten", "sal", "vo", "qu"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    terms = list({word(rng.randrange(3, 9)) for _ in range(90_000)})[:50_000]
    texts = [" ".join(word(rng.randrange(2, 9)) for _ in range(30)) for _ in range(60)]
    assert len(terms) == 50_000
    assert found(spark, texts, terms) == {(i, x) for i, t in enumerate(texts) for x in terms if x in t}


def test_both_ways_agree_and_refuse_nothing(spark):
    texts = ["abcabcabd", "naïve café\nnext line", "aaaa", "x.y*z", "😀ok😀", "\x00a\x00", "", None]
    terms = ["a", "ab", "abca", "abcabcabd", "fé\nnext", "aaaaa", "😀ok", "\x00a", "ok😀", "y*z"]
    expected = {(i, x) for i, t in enumerate(texts) for x in terms if t and x in t}
    assert found(spark, texts, terms) == found(spark, texts, terms, max_bytes=1) == expected


def test_few_candidates_though_terms_share_their_runs(spark):
    """Every term shares its runs with every text, which used to make each pair a candidate."""
    texts = [f"{n:02d}" + "abcd" * 3 + "efgh" * 3 for n in range(40)]
    terms = [f"abcd{n:05d}efgh" for n in range(20_000)] + ["cdab", "efghefgh"]
    t, v = spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame([(x,) for x in terms], "term string")
    result = contained_terms(t, v)
    assert "Join" not in result._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in result.collect()} == {(i, x) for i in range(40) for x in terms[-2:]}
