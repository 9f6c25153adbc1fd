"""Operators that SQL can't say, against plain versions; and edges of those that it can."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from cutloom.operators import align as A
from cutloom.operators import edl as E
from cutloom.operators import intervals as I
from cutloom.operators import retakes as R
from cutloom.operators import segment as S
from cutloom.operators import signal as G
from cutloom.operators import speech as P
from cutloom.operators.phrases import locate_phrases
from cutloom.sources import tables as D

WORDS = "asset_id long, word_idx int, word string, start_us long, end_us long, conf_milli long"


def words(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], WORDS)


def say(texts, gap=100_000, dur=200_000):
    out, at = [], 0
    for t in texts:
        out.append((t, at, at + dur, 900))
        at += dur + gap
    return out


def test_pause_segments_at_the_threshold(spark):
    df = words(spark, ("a", 0, 400_000, 1), ("b", 1_200_000, 1_600_000, 1), ("c", 2_399_999, 2_400_000, None))
    assert [(r.seg_id, r.text, r.start_us) for r in S.pause_segments(df).orderBy("seg_id").collect()] == [(1, "a", 0), (2, "b c", 1_050_000)]
    assert [r.text for r in S.pause_segments(df, strict=True).collect()] == ["a b c"]
    assert S.pause_segments(df.limit(0)).count() == 0
    assert S.pause_segments(words(spark, ("x", 0, 0, 1))).count() == 0


def test_drop_words_half_open(spark):
    df = words(spark, ("a", 0, 200, 1), ("b", 200, 400, 1), ("c", 30_000_000, 30_000_200, 1))
    win = spark.createDataFrame([(1, 100, 300), (1, 100, 300), (1, 0, 50), (2, 0, 10**9)], "asset_id long, start_us long, end_us long")
    assert [r.word for r in I.drop_words(df, win).orderBy("word_idx").collect()] == ["b", "c"]
    everything = spark.createDataFrame([(1, 0, 10**8)], "asset_id long, start_us long, end_us long")
    assert I.drop_words(df, everything).count() == 0 and I.keep_words(df, everything).count() == 3


DECISIONS = "asset_id long, start_us long, end_us long, keep boolean, reason string, decided_by string"
DROPS = "asset_id long, start_us long, end_us long, reason string"


def plain_subtract(rows, drops, tolerance=300_000):
    """The rules of J8 for one asset, rows and joined drops one by one."""
    joined = []
    for s, e, r in sorted(drops):
        if joined and s <= joined[-1][1] + tolerance:
            joined[-1] = (joined[-1][0], max(e, joined[-1][1]), joined[-1][2] | {r})
        else:
            joined.append((s, e, {r}))
    out, first = [], {}
    for s, e, keep, reason in sorted(set(rows)):
        met = [d for d in joined if d[1] > s + tolerance and d[0] < e - tolerance]
        whole = [d for d in met if d[0] <= s + tolerance and d[1] >= e - tolerance]
        for d in met:
            if d not in whole:
                first.setdefault(d[:2], (s, e))
        if whole:
            out.append((s, e, False, "killed: " + "; ".join(sorted(whole[0][2]))))
        elif not met:
            out.append((s, e, keep, reason))
        elif keep:
            edges = [s, *(x for d in met for x in d[:2]), e]
            out += [(a, b, True, reason) for a, b in zip(edges[::2], edges[1::2]) if b - a > tolerance]
    for s, e, r in joined:
        a, b = first.get((s, e), (s, e))
        out.append((max(a, s), min(b, e), False, "; ".join(sorted(r))))
    return sorted(out)


def test_subtracted_drops_equal_plain_rules(spark):
    rng, rows, drops, want = random.Random(3), [], [], []
    for asset in range(150):
        at, own = 0, []
        for _ in range(rng.randint(0, 6)):
            at += rng.randint(0, 3) * 200_000
            end = at + rng.randint(1, 18) * 200_000
            own.append((at, end, rng.random() < 0.8, rng.choice(["", "x"])))
            at = end - (rng.random() < 0.1) * 100_000
        cut = [(s, s + rng.randint(1, 24) * 100_000, rng.choice("ab")) for s in (rng.randint(-5, 60) * 100_000 for _ in range(rng.randint(0, 4)))]
        rows += [(asset, *r, "rule") for r in own]
        drops += [(asset, *d) for d in cut]
        want += [(asset, *r) for r in plain_subtract(own, cut)]
    got = E.subtract_drops(spark.createDataFrame(rows, DECISIONS), spark.createDataFrame(drops, DROPS)).drop("decided_by")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_subtracted_drops_by_hand(spark):
    def left(rows, *drops):
        a = spark.createDataFrame([(1, *r, "rule") for r in rows], DECISIONS)
        return sorted(tuple(r)[1:] for r in E.subtract_drops(a, spark.createDataFrame([(1, *d) for d in drops], DROPS)).drop("decided_by").collect())

    one = [(0, 10_000_000, True, "")]
    assert left(one, (4_000_000, 6_000_000, "x")) == [(0, 4_000_000, True, ""), (4_000_000, 6_000_000, False, "x"), (6_000_000, 10_000_000, True, "")]
    assert left(one, (100_000, 9_900_000, "x")) == [(0, 10_000_000, False, "killed: x"), (100_000, 9_900_000, False, "x")]
    assert left(one, (9_800_000, 12_000_000, "x")) == [(0, 10_000_000, True, ""), (9_800_000, 12_000_000, False, "x")]
    assert left([(0, 10_000_000, False, "y")], (4_000_000, 6_000_000, "x")) == [(4_000_000, 6_000_000, False, "x")]
    # A drop behind all segments is placed although one of the same reason has killed a segment.
    assert left([(0, 1_000_000, True, "")], (-1, 1_000_000, "rule"), (5_000_000, 6_000_000, "rule"))[-1] == (5_000_000, 6_000_000, False, "rule")
    assert left(one) == one and left([], (1, 2, "x")) == [(1, 2, False, "x")]


def test_fences_are_stacked_in_order(spark):
    base = spark.createDataFrame([(1, 0, 10_000_000, True, "", "rule"), (1, 11_000_000, 12_000_000, True, "", "rule")], DECISIONS)
    first, second = (spark.createDataFrame([(1, *d)], DROPS) for d in ((2_000_000, 4_000_000, "again"), (1_900_000, 6_000_000, "no")))
    out = E.stack_fences(base, [(first, "self_dedup_rule"), (second, "llm")]).orderBy("seg_id").collect()
    assert [(r.start_us, r.end_us, r.keep, r.decided_by, r.seg_id) for r in out] == [
        (0, 2_000_000, True, "rule", 0), (2_000_000, 4_000_000, False, "llm", 1), (4_000_000, 6_000_000, False, "llm", 2), (6_000_000, 10_000_000, True, "rule", 3), (11_000_000, 12_000_000, True, "rule", 4),
    ]


def f1(a, b, n):
    count = lambda t: {g: sum(t[i : i + n] == g for i in range(len(t) - n + 1)) for g in {t[i : i + n] for i in range(len(t) - n + 1)}}
    ca, cb = count(a), count(b)
    over = sum(min(ca.get(g, 0), c) for g, c in cb.items())
    total = sum(ca.values()) + sum(cb.values())
    return 2 * over / total if ca and cb else 0.0


def test_alignment_scores_equal_plain_ones():
    rng = random.Random(5)
    for _ in range(40):
        q, t = ("".join(rng.choice("abc") for _ in range(n)) for n in (rng.randint(4, 14), rng.randint(1, 60)))
        best, end = A.scores(q, t)
        low, high = max(4, int(len(q) * 0.65)), int(len(q) * 2.2) + 1
        for s in range(len(t)):
            options = [(f1(q, t[s : s + n], 4), n) for n in range(low, high + 1) if s + n <= len(t)]
            top = max((v for v, _ in options), default=0.0)
            assert abs(best[s] - top) < 1e-12
            if top > 0:
                assert end[s] == s + min(n for v, n in options if abs(v - top) < 1e-12)


def test_peaks_equal_suppression():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x, r = rng.integers(0, 5, 40) / 5, int(rng.integers(4, 9))
        local = [i for i in range(40) if x[i] >= 0.25 and x[i] >= x[max(0, i - r) : i + r + 1].max()]
        kept = []
        for i in sorted(local, key=lambda i: -x[i]):
            if all(abs(i - k) >= r for k in kept):
                kept.append(i)
        assert A.peaks(x, r) == sorted(kept)


def plain_retakes(rows):
    n, wins = len(rows), []
    for track in (0, 1):
        for i in range(n):
            for j in range(i + 2, n):
                text = "".join(w for w, *_ in rows[i : j + 1])
                pause = j == n - 1 or rows[j + 1][1] - rows[j][2] > 250_000
                if 4 <= len(text) <= 60 and (pause if track == 0 else not pause and j - i < 10):
                    wins.append((rows[i][1], track, i, j, rows[j][2], text))
    wins.sort(key=lambda w: w[:4])
    pairs, used = [], set()
    for a, x in enumerate(wins):
        best = (0.0, None)
        for y in wins[a + 1 :]:
            if y[2] > x[3] and y[0] - x[4] <= 15_000_000:
                s = f1(x[5], y[5], 2)
                if s >= 0.55 and s > best[0]:
                    best = (s, y)
        if best[1] and best[1][2:4] not in used:
            used.add(best[1][2:4])
            pairs.append((round(best[0], 4), x, best[1]))
    out = []
    for s, x, y in sorted(pairs, key=lambda p: -p[0]):
        if all(x[3] < u[1][2] or x[2] > u[1][3] for u in out):
            out.append((s, x, y))
    return sorted((x[2], x[3], y[2], y[3], s) for s, x, y in out)


def test_retakes_equal_plain_search(spark):
    rng = random.Random(9)
    vocabulary = ["we", "went", "home", "again", "late", "then", "slept", "ok"]
    said = [rng.choice(vocabulary) for _ in range(34)]
    said[12:12] = said[4:10]
    rows = say(said)
    rows = [(w, s + (i // 9) * 900_000, e + (i // 9) * 900_000, c) for i, (w, s, e, c) in enumerate(rows)]
    got = sorted((r.a_i, r.a_j, r.b_i, r.b_j, r.similarity) for r in R.self_duplicates(words(spark, *rows)).collect())
    assert got == plain_retakes(rows) and got
    assert R.self_duplicates(words(spark, ("a", 0, 1, 1))).count() == 0


def test_retakes_count_repeated_bigrams(spark):
    rng = random.Random(21)
    rows = say([rng.choice(["aa", "aaa", "ab", "abab", "b"]) for _ in range(40)])
    got = sorted((r.a_i, r.a_j, r.b_i, r.b_j, r.similarity) for r in R.self_duplicates(words(spark, *rows)).collect())
    assert got == plain_retakes(rows) and got


def test_windows_reach_over_words_without_letters(spark):
    texts = ["ab", "cd", "ef"] + ["..."] * 2500 + ["gh", "..."] * 400 + ["end"]
    df = words(spark, *say(texts))
    got = {(r.i, r.j, r.track) for r in R.windows(df).collect()}
    want = set()
    for i in range(len(texts)):
        n = 0
        for j in range(i, len(texts)):
            n += len(texts[j]) if texts[j] != "..." else 0
            if n > 60:
                break
            if j - i >= 2 and n >= 4 and (j == len(texts) - 1 or j - i < 10):
                want.add((i, j, 0 if j == len(texts) - 1 else 1))
    assert got == want


def test_candidates_of_alignment_lose_no_match(spark):
    rng = random.Random(6)
    pool = ["alpha", "beta", "gamma", "delta", "one", "two", "three", "four", "five", "the", "and"]
    talk = [(a, i, w, i * 300_000, i * 300_000 + 200_000, 900) for a in range(12) for i, w in enumerate(rng.choices(pool, k=rng.randint(1, 60)))]
    lines = [(1, i, " ".join(rng.choices(pool, k=rng.randint(1, 9)))) for i in range(25)]
    df, s = spark.createDataFrame(talk, WORDS), spark.createDataFrame(lines, "item_id long, sent_id int, text string")
    got = {(r.asset_id, r.sent_id, r.first_idx, r.last_idx) for r in A.align(df, s).collect()}
    want = set()
    for a in range(12):
        own = [w for x, _, w, *_ in talk if x == a]
        text, ends = "".join(own), np.cumsum([len(w) for w in own])
        for _, i, q in lines:
            q = q.replace(" ", "")
            best, end = A.scores(q, text)
            for p in A.peaks(best, max(4, int(len(q) * 0.8))):
                if round(best[p], 4) >= 0.25:
                    want.add((a, i, *(int(np.searchsorted(ends, x, side="right")) for x in (p, end[p] - 1))))
    assert got == want and len(got) > 20


def test_own_scripts_over_many_bands_equal_a_plain_search(spark):
    rng = random.Random(8)
    pool = ["alpha", "beta", "gamma", "delta", "one", "two", "three", "four", "five", "the", "and", "...", "x" * 700, "z"]
    talk, lines = [], []
    for a in range(3):
        said = rng.choices(pool, [9] * 12 + [0.2, 3], k=rng.randint(900, 1200))
        talk += [(a, i, w, i * 300_000, i * 300_000 + 200_000, 900 if i % 5 else 20) for i, w in enumerate(said)]
        for n in range(9):
            at = rng.randrange(len(said) - 40)
            lines.append((a, n, " ".join(said[at : at + rng.choice([2, 7, 30])])))
        lines += [(a, 20, lines[-1][2]), (a, 21, "z " * 40), (a, 22, None), (a, 23, "ab")]
    df, s = spark.createDataFrame(talk, WORDS).repartition(3), spark.createDataFrame(lines, "asset_id long, sent_id int, text string")
    got = {(r.asset_id, r.sent_id, r.first_idx, r.last_idx, r.confidence) for r in A.align(df, s).collect()}
    want = set()
    for a in range(3):
        own = [(w.replace(".", ""), c) for x, _, w, _, _, c in talk if x == a]
        text, ends = "".join(w for w, _ in own), np.cumsum([len(w) for w, _ in own])
        for x, i, q in lines:
            q = (q or "").replace(" ", "").replace(".", "")
            if x != a or len(q) < 4:
                continue
            best, end = A.scores(q, text)
            for p in A.peaks(best, max(4, int(len(q) * 0.8))):
                first, last = (int(np.searchsorted(ends, v, side="right")) for v in (p, end[p] - 1))
                sure = np.mean([c / 1000 for _, c in own[first : last + 1]]) >= 0.5
                final = round(best[p] * (1.0 if sure else 0.85), 4)
                if final >= 0.25:
                    want.add((a, i, first, last, final))
    assert got == want and len({r[:2] for r in got}) > 25


def test_lists_of_sentences_lose_no_score():
    rng = random.Random(15)
    for _ in range(30):
        sentences = sorted({"".join(rng.choice("abcé😀") for _ in range(rng.randint(4, 30))) for _ in range(12)})
        text = "".join(rng.choice("abcdé😀") for _ in range(rng.randint(1, 150)))
        shared = {k: (p, b) for k, p, b in A.Script(sentences).shared(text)}
        for k, q in enumerate(sentences):
            best, end = A.scores(q, text)
            got, at = A.shared_scores(*shared[k], len(q), len(text), 4, 0, len(text), A.LEAST) if k in shared else (np.zeros(len(text)), end)
            good = best >= A.LEAST
            assert (got[good] == best[good]).all() and (at[good] == end[good]).all() and (got[~good] < A.LEAST).all()


def test_alignment_moves_words_and_lists_not_grams(spark):
    talk = [(a, i, "tick tock and so on".split()[i % 5], i * 300_000, i * 300_000 + 200_000, 900) for a in range(2) for i in range(9000)]
    lines = [(1, i, "tick tock and so on " * (1 + i % 3) + "x" * i) for i in range(40)]
    df, s = spark.createDataFrame(talk, WORDS), spark.createDataFrame(lines, "item_id long, sent_id int, text string")
    bands = A._bands(df, A._lists(s.select(F.translate("text", " ", "").alias("norm")), []), []).select("asset_id", "band", F.size("w").alias("n")).collect()
    assert {(r.asset_id, r.band) for r in bands} == {(a, b) for a in range(2) for b in range(2)} and sum(r.n for r in bands) < 2 * len(talk)
    got = {r.first_idx for r in A.align(df, s.filter("sent_id = 3")).filter("asset_id = 1").collect()}
    text, ends = "".join(w for a, _, w, *_ in talk if a == 1), np.cumsum([len(w) for a, _, w, *_ in talk if a == 1])
    q = lines[3][2].replace(" ", "")
    assert got == {int(np.searchsorted(ends, p, side="right")) for p in A.peaks(A.scores(q, text)[0], A.radius_of(len(q)))} and len(got) > 400


def stood_by_asset(spark, rows):
    """Words that stand by asset_id already, as those of conversations do."""
    df = spark.createDataFrame(rows, WORDS)
    return df.withColumn("start_us", F.sum(F.lit(300_000)).over(S.by_word())).withColumn("end_us", F.col("start_us") + 200_000)


def exchanges(spark, make):
    """How the plan of make() deals rows, without broadcasts, as for tables too large for them."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    return re.findall(r"Exchange (?:\w+\([^)]*\)|\w+)", re.sub(r"#\d+L?", "", plan))


def test_words_stay_where_their_recording_is(spark):
    rng = random.Random(5)
    rows = [(a, i, rng.choice("tick tock and so on we go".split()), 0, 0, rng.choice((100, 900))) for a in range(5) for i in range(9000 if a == 4 else 60 * a)]
    script = [(a, k, " ".join(rng.choice("tick tock and so on we go".split()) for _ in range(4 + 40 * (k % 7 == 0)))) for a in range(1, 6) for k in range(20)]
    df, s = stood_by_asset(spark, rows), spark.createDataFrame([*script, *(x[:1] + (99,) + x[2:] for x in script[:1])], "asset_id long, sent_id int, text string")
    least = A.LIST
    A.LIST = 6  # several lists of a recording's sentences
    try:
        got, same = ([tuple(r) for r in A.align(df, s, spread=x).collect()] for x in (False, True))
        plan = exchanges(spark, lambda: A._own_bands(df, s.withColumn("norm", F.translate("text", " ", ""))))
    finally:
        A.LIST = least
    assert len(got) > 1000 and {r[0] for r in got} == {1, 2, 3, 4} and sorted(got) == sorted(same)
    assert {re.sub(r"\d+", "n", x) for x in plan} == {"Exchange hashpartitioning(asset_id, n)"} and len(plan) <= 3


def test_turns_are_dealt_by_the_number_of_tasks(spark):
    talk = spark.createDataFrame([(a, t, "so it goes".split()) for a in range(40) for t in range(3)], "asset_id long, turn long, ws array<string>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "80")
    try:
        assert exchanges(spark, lambda: D.timed(talk)) == ["Exchange hashpartitioning(asset_id, 20)"]
        assert D.timed(talk).rdd.getNumPartitions() == 20  # merged to one by the size of the turns before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_uncovered_runs_move_no_words(spark):
    rng = random.Random(6)
    rows = [(a, i, "w", 0, 0, 900) for a in range(4) for i in range(50) if rng.random() < 0.9]
    ranges = [(a, x, x + rng.randrange(4)) for a in range(3) for x in (rng.randrange(48) for _ in range(6))] + [(1, 30, 20), (2, None, 5), (2, 5, None), (7, 1, 2)]
    df, covered = stood_by_asset(spark, rows), spark.createDataFrame(ranges, "asset_id long, first_idx int, last_idx int")
    want = set()
    for a in range(4):
        hidden = {i for b, x, y in ranges if b == a and x is not None and y is not None for i in range(min(x, y), max(x, y) + 1)}
        run: list[int] = []
        for i in [i for b, i, *_ in rows if b == a and i not in hidden] + [999]:
            if run and i != run[-1] + 1:
                want |= {(a, run[0], run[-1])} if len(run) > 1 else set()
                run = []
            run.append(i)
    assert {(r.asset_id, r.first_idx, r.last_idx) for r in S.uncovered_runs(df, covered).collect()} == want
    plan = exchanges(spark, lambda: S.uncovered_runs(df, covered))
    assert {re.sub(r"\d+", "n", x) for x in plan} == {"Exchange hashpartitioning(asset_id, n)"} and len(plan) == 2


def test_alignment_finds_repeats(spark):
    rows = say("noise one the quick brown fox jumps over it more noise the quick brown fox jumps over it end".split())
    s = spark.createDataFrame([(1, 1, "The quick brown fox jumps over it.".lower()), (1, 2, "never said at all"), (1, 3, "a")], "item_id long, sent_id int, text string")
    out = [(r.sent_id, r.first_idx, r.last_idx, r.confidence, r.keep, r.reason) for r in A.align(words(spark, *rows), s).orderBy("first_idx").collect()]
    assert out == [(1, 2, 8, 1.0, False, "repeat_discard"), (1, 11, 17, 1.0, True, "")]


def test_cursor_and_phrases(spark):
    df = words(spark, *say("aa bb cc aa dd".split()))
    lines = spark.createDataFrame([(1, 1, ["bb"]), (1, 2, ["aa"]), (1, 3, ["zz"]), (1, 4, [])], "asset_id long, line_no int, keywords array<string>")
    assert [(r.line_no, r.start_us, r.hit) for r in P.cursor_match(df, lines).orderBy("line_no").collect()] == [(1, 0, True), (2, 300_000, True), (3, 900_000, False), (4, 1_500_000, False)]
    p = spark.createDataFrame([(1, "c, c a"), (1, ""), (1, "zz"), (2, "aa")], "asset_id long, phrase string")
    assert {(r.phrase, r.first_idx, r.last_idx) for r in locate_phrases(df, p).collect()} == {("c, c a", 2, 3), ("", None, None), ("zz", None, None), ("aa", None, None)}


def test_cursor_matches_equal_a_plain_scan(spark):
    rng = random.Random(12)
    for asset in range(40):
        said = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 40))]
        keys = [["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 3))] for _ in range(12)]
        text, starts, cursor = "".join(said), np.cumsum([0, *map(len, said)])[:-1], 0
        for line in keys:
            want = next((j for k in line for j in range(cursor, len(said)) if k in "".join(said[j : j + 4])), None)
            found = (P._first_start(text, k, starts, cursor, 4) for k in line)
            got = next((j for j in found if j is not None), None)
            assert got == want
            cursor = cursor if got is None else got + 1


def test_repeated_ngrams_equal_plain_counts(spark):
    from cutloom.operators.ngrams import repeated_ngrams

    rng = random.Random(4)
    texts = [(a, "".join(rng.choice("abé") for _ in range(rng.choice([0, 3, 4, 7, 60])))) for a in (1, 2, 2**60, 2**60 + 1) for _ in range(20)]
    texts += [(1, "a" * 30_000), (1, None), (5, "x"), (6, "日本語文字" * 9), (7, "abcd"), (7, "abcd"), (None, "abcdabcd")]
    df = spark.createDataFrame(texts, "asset_id long, t string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = {(r.asset_id, r.n, r.gram): r.times for r in repeated_ngrams(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for a, t in texts:
        for n in range(4, 9):
            for i in range(len(t or "") - n + 1):
                want[a, n, t[i : i + n]] = want.get((a, n, t[i : i + n]), 0) + 1
    assert got == {k: v for k, v in want.items() if v >= 2}


def test_thousands_of_phrases_of_one_recording(spark, monkeypatch):
    from cutloom.operators import phrases as H

    monkeypatch.setattr(H, "STRETCH", 256)
    monkeypatch.setattr(H, "BLOCK", 64)
    rng = random.Random(5)
    said = [(a, i, rng.choice(["da", "ba", "ka,", "...", "la", "mi! ", "é", "x" * 90]), i * 10, i * 10 + 5, 1) for a in (1, 2) for i in range(700)]
    letters = lambda w: "".join(c for c in w if c not in " ,.!?")
    own = {a: [letters(w) for x, _, w, *_ in said if x == a] for a in (1, 2)}
    asked = [(a, " ".join(own[a][i : i + rng.choice([1, 2, 5, 9, 60])])) for a in (1, 2) for i in rng.choices(range(700), k=1500)]
    asked += [(1, "never so"), (1, ""), (1, None), (2, "..."), (3, "da"), (1, "da"), (1, "da")]
    got = sorted(((r.asset_id, r.phrase, r.first_idx, r.last_idx) for r in locate_phrases(spark.createDataFrame(said, WORDS), spark.createDataFrame(asked, "asset_id long, phrase string")).collect()), key=repr)
    want = []
    for a, phrase in asked:
        text, q = "".join(own.get(a, [])), letters(phrase or "")
        at = text.find(q) if q else -1
        ends = np.cumsum([len(w) for w in own.get(a, [])])
        want.append((a, phrase, *((int(np.searchsorted(ends, x, side="right")) for x in (at, at + len(q) - 1)) if at >= 0 else (None, None))))
    assert got == sorted(want, key=repr) and sum(r[2] is None for r in got) < 300


def test_signals_in_blocks_equal_whole_ones(spark):
    rng = np.random.default_rng(6)
    long = {a: rng.integers(-30_000, 30_000, n).tolist() for a, n in ((1, 1000), (2, 7), (3, 64), (4, 1))}
    moved = {1: [0] * 5 + long[1][:900], 2: long[2][2:], 3: [0] * 64, 4: long[4]}
    cut = lambda x, size: [(a, i // size, v[i : i + size]) for a, v in x.items() for i in range(0, len(v), size)]
    whole = spark.createDataFrame([(a, v, moved[a]) for a, v in long.items()], "asset_id long, samples array<int>, other array<int>")
    for size in (6, 16, 64):
        a, b = (spark.createDataFrame(cut(x, size), "asset_id long, block int, samples array<int>") for x in (long, moved))
        want = {(r.asset_id, r.frame_idx, r.n, round(r.rms, 9)) for r in G.frame_rms(whole, 10).collect()}
        assert {(r.asset_id, r.frame_idx, r.n, round(r.rms, 9)) for r in G.block_rms(a.selectExpr("asset_id", f"block * {size}L as at", "samples"), 10).collect()} == want
        want = {r.asset_id: (r.lag, round(r.peak, 9)) for r in G.lags(whole.selectExpr("asset_id", "samples as a", "other as b"), 6).collect()}
        assert {r.asset_id: (r.lag, round(r.peak, 9)) for r in G.block_lags(a, b, size, 6).collect()} == want
        assert want[1][0] == 5


def test_spread_segments_and_gaps_equal_plain_ones(spark):
    rng = random.Random(11)
    rows, at = [], 0
    for a in (1, 2, 3):
        for i in sorted(rng.sample(range(200), 90)):  # numbers may have holes, as after drops
            at += rng.choice([0, 100, 800, 801, 3000]) * 1000
            rows.append((a, i, f"w{i}", at, at + 250_000, i))
            at += 250_000
    df = spark.createDataFrame(rows, WORDS).repartition(3)
    table = lambda x: sorted(map(tuple, x.select(*sorted(x.columns)).collect()), key=repr)
    for block in (1, 7, 64, 8192):
        assert table(S.gaps(df, spread=True, block=block)) == table(S.gaps(df))
        for strict in (False, True):
            assert table(S.pause_segments(df, strict=strict, spread=True, block=block)) == table(S.pause_segments(df, strict=strict))


def test_words_outside_equal_plain_loops(spark):
    rng, rows = random.Random(11), []
    for asset in range(5):
        at = 0
        for i in range(60):
            at += rng.choice([0, 1, 5, 20])
            end = at + rng.choice([0, 1, 2, 7])
            marked = rng.random() < 0.2
            rows.append((asset, i, at, end, at - rng.randint(0, 9) if marked else None, end + rng.randint(-3, 9)))
    df = spark.createDataFrame(rows, "asset_id long, word_idx int, start_us long, end_us long, s long, e long").repartition(3)
    got = I.words_outside(df, F.col("s"), F.col("e"))
    inside = lambda a, s, e: any(w[0] == a and w[4] is not None and 2 * w[4] <= s + e < 2 * w[5] for w in rows)
    assert sorted((r.asset_id, r.word_idx) for r in got.collect()) == sorted(r[:2] for r in rows if not inside(r[0], r[2], r[3]))


def test_segments_move_turns_and_not_words(spark):
    from cutloom.plans.words import segments

    plan = segments(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_words_go_on_over_turns(spark, tmp_path):
    from cutloom.sources import tables as D

    rows = [(1, 2, "c d"), (1, 0, "a b."), (1, 1, None), (2, 5, ""), (2, 7, " x  y ")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.asset_id, r.word_idx, r.turn, r.word) for r in D.words(spark, str(tmp_path)).orderBy("asset_id", "word_idx").collect()]
    assert got == [(1, 0, 0, "a"), (1, 1, 0, "b."), (1, 2, 2, "c"), (1, 3, 2, "d"), (2, 0, 7, "x"), (2, 1, 7, "y")]


def test_spread_segments_join_words_once(spark):
    df = words(spark, *say(["a", "b"]))
    plan = S.pause_segments(df, spread=True, block=8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_spread_segments_count_pauses_between_blocks_that_are_apart(spark):
    df = spark.createDataFrame([(1, i, "w", t, t + 400_000, 900) for i, t in ((0, 0), (1, 500_000), (9, 3_000_000), (10, 9_000_000), (30, 9_500_000))], WORDS)
    table = lambda d: sorted((r.seg_id, r.first_idx, r.last_idx) for r in d.collect())
    assert table(S.pause_segments(df, spread=True, block=2)) == table(S.pause_segments(df)) == [(1, 0, 1), (2, 9, 9), (3, 10, 30)]
