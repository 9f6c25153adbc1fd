"""FM-index: searches against plain scanning, and reports against sets of words."""

import hashlib
import random
import re

import numpy as np
import pytest

from cutloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(i if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for doc, t in docs:
        w = words(t)
        hit, found = set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if (x := tuple(w[j : j + k])) in windows:
                    hit |= set(range(j, j + k))
                    found |= windows[x]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def report(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_index_finds_what_scanning_finds():
    rng = np.random.default_rng(4)
    for n, k in ((1, 1), (30, 2), (400, 3), (3000, 9)):
        text = rng.integers(1, k + 1, n)
        text[rng.integers(0, n, n // 40)] = 0
        text = np.append(text, 0)
        index = d.FmIndex(text, k, 4)
        rows = np.array([[0] * (6 - m) + rng.integers(1, k + 1, m).tolist() for m in rng.integers(1, 7, 60)])
        found, low, high = index.search(rows)
        got = {int(r): sorted(index.locate(np.arange(a, b)).tolist()) for r, a, b in zip(found, low, high)}
        for r, row in enumerate(rows):
            p = row[row > 0]
            want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
            assert got.get(r, []) == want


def corpus(n=120, seed=8):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)] + ["É", "日本", "x1"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25, 60])))) for i in range(25)]
    docs = []
    for i in range(n):
        t = [rng.choice(pool) for _ in range(rng.randrange(300))]
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items)[1])
            at = rng.randrange(len(t) + 1)
            t[at:at] = w[rng.randrange(3) :][: rng.choice([5, 12, 80])]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(t).upper() if i % 3 else " ".join(t)))
    return docs + [(500, docs[5][1]), (501, docs[5][1])], items


@pytest.mark.parametrize("block", [7, 10_000])
def test_random_texts(spark, block, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(d, "CUT_BYTES", 3000)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert report(d.contamination(a, b, block)) == brute(docs, items)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "... !"), (None, "a b"), (4, "Yes"), (5, "yes no"), (5, "yes no"), (6, "z " * 100_000 + "a b c d e f g h i j k"), (7, "aé b")]
    items = [(1, None), (2, ""), (3, "YES"), (None, "no"), (4, "a b c d e f g h i j k"), (4, "q q"), (9, "z")]
    a = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n_hit int, spans string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert report(d.contamination(a, b)) == brute(docs, items)
    spans = {r.doc_id: [(s["first"], s["stop"]) for s in r.spans] for r in d.contamination(a, b).collect()}
    assert spans[6] == [(0, 100_011)] and spans[4] == [(0, 1)] and spans[1] == []
    clean = d.keep_clean(a, b)
    assert clean.columns == a.columns and {r.doc_id for r in clean.collect()} == {1, 2, 3, None, 7}
    assert d.contamination(a.limit(0), b).count() == 0 and not any(r.contaminated for r in d.contamination(a, b.limit(0)).collect())
    assert d.keep_clean(a, b.limit(0)).count() == len(docs)
