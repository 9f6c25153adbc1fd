"""Spelling variants against all pairs, on odd texts too."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cutloom.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_counts(docs, length=5, least=3):
    n = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= length and k >= least}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(n):
    out, form = set(), {}
    alike = {w: [x for x in n if near(w, x)] for w in n}
    for w in n:
        best = min(alike[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(alike[w]), form[w] and n[form[w]]))
    return out


def some_words(seed, size=400):
    rng = np.random.default_rng(seed)
    n = {}
    for _ in range(size):
        w = "".join(rng.choice(list("abcdeé×"), rng.integers(5, 9)))
        n[w] = int(rng.integers(3, 2000))
        for _ in range(3):
            i, kind = rng.integers(len(w)), rng.integers(3)
            x = w[:i] + ("", "a" + w[i], "b")[kind] + w[i + 1 :]
            n[x] = int(rng.integers(3, 90))
    n |= {"z" * 200: 5, "z" * 201: 50, "z" * 100 + "y" + "z" * 99: 400, "z" * 300: 9}  # long ones
    n |= {"ab" * 3 + "c" * k: 3 * 2**k for k in range(12)}  # a chain of forms
    return n


@pytest.mark.parametrize("leaf, groups", [(20_000, 10), (40, 10), (7, 3), (1, 2)])
def test_variants_equal_all_pairs(spark, leaf, groups):
    n = some_words(leaf)
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert set(map(tuple, S.variants(words, leaf=leaf, groups=groups).collect())) == plain_variants(n)


def test_trie_gives_each_pair_once():
    rng = np.random.default_rng(2)
    rows, queries = rng.integers(0, 3, (300, 5)), rng.integers(0, 3, (50, 5))
    found = [p for q, r in S.Trie(rows).near(queries) for p in zip(q.tolist(), r.tolist())]
    more = queries[:, None] - rows[None]
    ok = (np.where(more > 0, more, 0).sum(axis=2) <= 1) & (np.where(more < 0, -more, 0).sum(axis=2) <= 1)
    assert len(found) == len(set(found)) and set(found) == set(zip(*(x.tolist() for x in np.nonzero(ok))))


def test_verifier_and_one_edit():
    words = ["", "a", "b", "ab", "ba", "abc", "aabb", "abab", "x" * 60, "x" * 61, "x" * 59 + "y"]
    a, b = (x.ravel() for x in np.meshgrid(range(len(words)), range(len(words))))
    want = [near(words[i], words[j]) for i, j in zip(a, b)]
    assert S.Verifier(words).near(a, b).tolist() == want
    assert [S.one_edit(words[i], words[j]) for i, j in zip(a, b)] == want


def test_counts_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", 50)  # texts are cut between words only
    monkeypatch.setattr(S, "HELD", 20)
    words = ["Straße", "naïve", "ÉCOLE", "don't", "a×b÷c", "Tschüss", "word", "İstanbul", "中文words", "longer"]
    docs = [(i, " ".join(words[i % 7 :] * 9)) for i in range(250)] + [(None, "nameless " * 20), (7, None), (8, ""), (9, "q" * 500 + " " + "q" * 500 + ",") , (9, "q" * 500), (9, "q" * 500)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, word string, n int").repartition(4)
    got = {r.word: r.n for r in S.word_counts(df).collect()}
    assert got == plain_counts(docs) and len(got) > 15
    assert set(map(tuple, S.variants(S.staged(S.word_counts(df), "words")).collect())) == plain_variants(got)


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "a b c")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert S.variants(S.staged(S.word_counts(df), "words")).count() == 0
