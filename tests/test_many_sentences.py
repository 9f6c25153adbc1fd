"""Alignment of many sentences and texts at once equals the plain way, one after the other."""

import random
import re

from cutloom.operators import align as A
from tests.test_operators import WORDS, exchanges, stood_by_asset


def test_maxima_of_many_sentences_equal_those_of_each():
    rng = random.Random(31)
    cells, n = A.CELLS, 0
    try:
        for turn in range(300):
            A.CELLS = rng.choice((7, 100_000))
            letters = rng.choice(("ab", "abc", "abcdefgh", "aé😀"))
            text = lambda low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))  # noqa: B023, E731
            sentences = sorted({text(4, rng.choice((6, 14, 40))) for _ in range(rng.randint(1, 8))})
            texts = [text(0, rng.choice((8, 60, 200))) for _ in range(rng.randint(1, 4))]
            if turn % 3 == 0:
                texts = [(t[:7] * 30)[: len(t)] + rng.choice(sentences) + t[:5] for t in texts]  # level stretches, and sentences as they are
            want = set()
            for i, t in enumerate(texts):
                for k, q in enumerate(sentences):
                    best, end = A.scores(q, t)
                    want |= {(i, k, p, end[p] - p, best[p]) for p in A.local_maxima(best, A.radius_of(len(q)))}
            got = set()
            for i, k, first, last, length, value, _ in zip(*(x.tolist() for x in A.Script(sentences).peaks(texts))):
                got |= {(i, k, p, length, value) for p in range(first, last + 1)}
            assert got == want
            n += len(got)
    finally:
        A.CELLS = cells
    assert n > 3000


def test_more_repeats_in_a_sentence_than_places_in_a_text():
    # "aaaa" stands twice in the sentence and once in the text: looking two places back failed.
    [(k, place, before)] = A.Script(["aaaaa"]).shared("aaaa")
    assert (k, place.tolist(), before.tolist()) == (0, [0], [-1])


def test_confidence_is_rounded_as_in_sql(spark):
    df = spark.createDataFrame([(1, 0, "abcde", 0, 1, 20), (1, 1, "jklm", 2, 3, 20)], WORDS)
    s = spark.createDataFrame([(1, 1, "abcdefghijklm")], "item_id long, sent_id int, text string")
    assert [r.confidence for r in A.align(df, s).collect()] == [0.3188]  # 0.85 * 6 / 16


def test_words_stay_where_lists_of_all_recordings_come(spark):
    rng = random.Random(5)
    rows = [(a, i, rng.choice("tick tock and so on we go".split()), 0, 0, rng.choice((100, 900))) for a in range(4) for i in range(9000 if a == 3 else 70 * a)]
    script = [(1, k, " ".join(rng.choice("tick tock and so on we go".split()) for _ in range(4 + 40 * (k % 7 == 0)))) for k in range(12)]
    df, s = stood_by_asset(spark, rows), spark.createDataFrame(script, "item_id long, sent_id int, text string")
    least, letters = A.LIST, A.LETTERS
    A.LIST, A.LETTERS = 5, 100  # several lists, bands one by one
    try:
        got = sorted(tuple(r) for r in A.align(df, s).collect())
        A.LETTERS = 10**6  # bands together
        same = sorted(tuple(r) for r in A.align(df, s, spread=True).collect())
    finally:
        A.LIST, A.LETTERS = least, letters
    assert got == same and len(got) > 500 and {r[0] for r in got} == {1, 2, 3}
    lists = spark.createDataFrame([(10, ["a"])], "size_class int, norms array<string>")
    plan = exchanges(spark, lambda: A._bands(df, lists, [], False))
    assert sum("asset_id" in x for x in plan) == 1 and not any(re.search("asset_id, (?!\\d)", x) for x in plan)
