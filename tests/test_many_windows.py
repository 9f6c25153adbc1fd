"""Retakes by running sums over whole recordings equal a plain search, in tiles of any size and in both forms."""

import random
import re

import numpy as np
import pyarrow as pa

from cutloom.operators import retakes as R
from cutloom.sources import tables as D
from tests.test_operators import exchanges, f1, stood_by_asset


def plain_partners(rows):
    """Each window's first best later one; of windows with an equal one only the first."""
    n, wins = len(rows), []
    for i in range(n):
        for j in range(i + 2, n):
            text = "".join(w for w, *_ in rows[i : j + 1])
            pause = j == n - 1 or rows[j + 1][1] - rows[j][2] > R.PAUSE_US
            if 4 <= len(text) <= 60 and (pause or j - i < 10):
                wins.append((rows[i][1], 0 if pause else 1, i, j, rows[j][2], text))
    wins.sort(key=lambda w: w[:4])
    out = {}
    for x in wins:
        best = (0.0, None)
        for y in wins:
            if y[2] > x[3] and y[0] - x[4] <= 15_000_000 and y[0] // 15_000_000 >= x[4] // 15_000_000 - 1:
                s = f1(x[5], y[5], 2)
                if s >= 0.55 and s > best[0]:
                    best = (s, y)
        if best[1]:
            out.setdefault(best[1][2:4], (*x[1:4], *best[1][2:4], best[0]))
    return sorted(out.values())


def test_partners_equal_a_plain_search():
    rng = random.Random(17)
    sizes, n = (R.TILE_A, R.PAGE, R.TILE_B, R.MOST_AT_ONCE), 0
    try:
        for turn in range(40):
            R.TILE_A, R.PAGE, R.TILE_B, R.MOST_AT_ONCE = sizes if turn % 2 else (8, 16, 3, 5)
            pool = rng.choice((["aa", "aaa", "ab", "abab", "b"], ["we", "went", "home", "", "again", "late", "then"], ["né", "😀a", "né né", "x" * 30]))
            rows, at = [], 0
            for _ in range(rng.randint(0, 45)):
                at += rng.choice((0, 100_000, 100_000, 300_000, 900_000, -400_000 if turn % 5 == 0 else 0, 4_000_000 if turn % 3 == 0 else 0))
                at = max(at, 0)
                rows.append((rng.choice(pool), at, at + 200_000))
                at += 0 if turn % 7 == 0 else 200_000
            stop = np.cumsum([len(w) for w, *_ in rows], dtype=np.int64)
            t = {"word_idx": pa.array(range(len(rows)), pa.int32()), "norm": pa.array([w for w, *_ in rows], pa.string()), "begin": stop - [len(w) for w, *_ in rows], "stop": stop}
            t |= {"start_us": pa.array([s for _, s, _ in rows], pa.int64()), "end_us": pa.array([e for *_, e in rows], pa.int64())}
            out = R._best_partners(7, pa.table(t)) if rows else None
            got = [] if out is None else sorted((r["a_track"], r["a_i"], r["a_j"], r["b_i"], r["b_j"], 2.0 * r["overlap"] / (r["n_a"] + r["n_b"])) for r in out.to_pylist())
            want = plain_partners(rows)
            assert [x[:5] for x in got] == [x[:5] for x in want] and all(abs(x[5] - y[5]) < 1e-12 for x, y in zip(got, want))
            n += len(got)
    finally:
        R.TILE_A, R.PAGE, R.TILE_B, R.MOST_AT_ONCE = sizes
    assert n > 300


def test_both_forms_of_retakes_are_equal_and_words_stay(spark):
    rng = random.Random(3)
    rows = [(a, i, rng.choice("we went home again late then slept ok".split()), 0, 0, 900) for a in range(6) for i in range(7 + 30 * a)]
    df = stood_by_asset(spark, [*rows, *((None, i, "we went", 0, 0, 900) for i in range(9))])
    step = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # recordings over several batches
    try:
        got = sorted(tuple(r) for r in R.self_duplicates(df).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", step)
    assert got == sorted(tuple(r) for r in R.self_duplicates(df, spread=True).collect()) and len({r[0] for r in got}) > 3
    plan = [re.sub(r"\d+", "n", x) for x in exchanges(spark, lambda: R.self_duplicates(df))]
    assert plan == ["Exchange hashpartitioning(asset_id, n)"] * 2  # the words once as they come, the pairs once


def test_words_turns_without_words(spark):
    turns = [(a, t, ["w"] * n) for a in (1, 2) for t, n in ((0, 3), (1, 0), (3, 2), (4, 0), (9, 1))]
    said = spark.createDataFrame(turns, "asset_id long, turn long, ws array<string>")
    found = spark.createDataFrame([(1, i) for i in (0, 2, 2, 3, 4, 5)] + [(2, 4)], "asset_id long, a_i int")
    got = sorted((r.asset_id, r.a_i, r.turn) for r in D.in_turns(found, said, "a_i").collect())
    assert got == [(1, 0, 0), (1, 2, 0), (1, 2, 0), (1, 3, 3), (1, 4, 3), (1, 5, 9), (2, 4, 3)]
    words = {(r.asset_id, r.word_idx): r.turn for r in D.timed(said).collect()}
    assert all(words[a, i] == t for a, i, t in got)
