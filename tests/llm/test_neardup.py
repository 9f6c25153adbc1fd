"""Near-duplicates against all pairs compared as sets of word tuples."""

import random
import re

import numpy as np
import pytest

from cutloom.llm import neardup
from cutloom.llm.components import components

SCHEMA = "doc_id long, text string"


def brute(rows, share):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for d, t in rows}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * share[1] >= share[0] * max(len(x), len(y)):
                both = len(x & y)
                if share[1] * both >= share[0] * (len(x) + len(y) - both):
                    r, s = root(a), root(b)
                    up[max(r, s)] = min(r, s)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def sf(spark, name="0.01"):
    return spark.read.parquet(f"/root/testdata/sf{name}/documents.parquet")


@pytest.mark.parametrize("share", [(85, 100), (80, 100)])
def test_all_documents_match_brute_force(spark, share):
    docs = sf(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(neardup.near_duplicates(docs, share)) == brute(rows, share)


def copies(n, edits, words=200, seed=3, start=0):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((start + i, " ".join(w)))
    return out


def test_large_groups_small_nodes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 4)
    monkeypatch.setattr(neardup, "DEEP_LEAF", 16)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 2_000)
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", 40)
    rows = copies(150, 9) + copies(60, 5, seed=5, start=1000) + copies(40, 3, 60, seed=6, start=2000)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(neardup.near_duplicates(df, (85, 100))) == brute(rows, (85, 100))


def test_shared_passage_is_not_a_duplicate(spark):
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(90)) + " " + passage) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert all(k for _, _, k in got(neardup.near_duplicates(df)).values())


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A B"), (6, "a b c d e"), (7, "a b c d e f"), (None, "a b"), (9, "x" * 300_000), (9, "x" * 300_000)]
    df = spark.createDataFrame([(a, b, b, 1) for a, b in rows], "doc_id long, text string, component_id string, kept int")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert (1, 0, 1, True) in out and (2, 0, 2, True) in out and (3, 0, 3, True) in out
    assert (4, 1, 4, True) in out and (5, 1, 4, False) in out and (6, 1, 6, True) in out and (7, 2, 7, True) in out
    assert (None, 1, None, True) in out and out.count((9, 1, 9, True)) == 2
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3), (300, 299), (299, 300)]
    df = components(spark.createDataFrame(edges, "u long, v long"))
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {299: 299, 300: 299}
    assert {r.node: r.component for r in df.collect()} == want


def test_shingles_ignore_ascii_case_only():
    a, b = neardup.shingles("One two THREE four five six"), neardup.shingles("one TWO three\nfour\tfive  six ")
    assert np.array_equal(a, b) and len(a) == 2
    assert not np.array_equal(neardup.shingles("É a b c d"), neardup.shingles("é a b c d"))


def test_trees_reach_the_target_recall():
    assert neardup.trees(0.85) == 12 and neardup.trees(0.8) > 12 and neardup.trees(0.85, 0.9) < 5
    rng, t, depth = np.random.default_rng(2), 0.85, 6
    n, met = 600, 0
    a = rng.integers(0, 1 << 16, (n, neardup.SIZE)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < t, a, rng.integers(0, 1 << 16, a.shape).astype(np.uint16))
    both = np.concatenate([a, b])
    path, row = neardup._mix(np.repeat(np.arange(1, 2, dtype=np.uint64), 2 * n)), np.arange(2 * n)
    for _ in range(depth):
        path, row = neardup._children(path, both, row, t)
    nodes = [set() for _ in range(2 * n)]
    for p, r in zip(path.tolist(), row.tolist()):
        nodes[r].add(p)
    met = np.mean([bool(nodes[i] & nodes[n + i]) for i in range(n)])
    assert neardup.trees(t, met, depth) <= 2 and met > 0.4
