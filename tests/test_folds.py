"""Scans of composed steps against plain loops, with blocks of a few rows."""

import random

import pytest

from cutloom.operators import edl as E
from cutloom.operators import folds

CUTS = "asset_id long, seg_id int, start_us long, end_us long"
US = 1000


def random_cuts(seed):
    rng, out = random.Random(seed), []
    for asset in range(6):
        at = 0
        for seg_id in range(1, rng.randint(1, 40)):
            at += rng.choice([-300, -60, -20, -9, 0, 5, 40, 200]) * US
            out.append((asset, seg_id, max(at, 0), max(at, 0) + rng.choice([-30, 0, 10, 49, 50, 51, 300, 900]) * US))
            at += rng.choice([0, 100, 200]) * US
    return out


def by_asset(cuts, order):
    for asset in sorted({c[0] for c in cuts}):
        yield asset, sorted((c for c in cuts if c[0] == asset), key=order)


def plain_fixed(cuts):
    out = []
    for asset, own in by_asset(cuts, lambda c: c[1]):
        last = None
        for _, i, s, e in own:
            s = last + 1000 if last is not None and s < last else s
            e = s + 50_000 if e < s else e
            last = e
            out.append((asset, i, s, e))
    return out


def plain_resolved(cuts):
    out = []
    for asset, own in by_asset(cuts, lambda c: (c[2], c[1])):
        cursor = None
        for _, i, s, e in own:
            if cursor is not None and s < cursor - 10_000:
                if cursor - s >= e - s - 50_000:
                    continue
                s = cursor
            out.append((asset, i, s, e))
            cursor = e if cursor is None else max(cursor, e)
    return out


def plain_guarded(rows):
    out = []
    for asset, own in by_asset(rows, lambda c: c[1]):
        last = None
        for k, (_, i, s, e, vs, ve, gs, ge) in enumerate(own):
            if gs is not None:
                s, e = gs, ge
            else:
                raw = e
                s = s if k == 0 else max(vs, last + 1000)
                e = raw if k == len(own) - 1 else min(ve, raw + 250_000)
            e = max(e, s + 50_000)
            last = e
            out.append((asset, i, s, e))
    return out


@pytest.mark.parametrize("blocks", [(2, 100 * US), (7, 1500 * US), (4096, 600_000_000)])
def test_folds_equal_plain_loops(spark, monkeypatch, blocks):
    monkeypatch.setattr(E, "BLOCK_CUTS", blocks[0])
    monkeypatch.setattr(E, "BLOCK_US", blocks[1])
    cuts = random_cuts(blocks[0])
    df = spark.createDataFrame(cuts, CUTS).repartition(3)
    assert sorted(map(tuple, E.fix_overlaps(df).collect())) == sorted(plain_fixed(cuts))
    assert sorted(map(tuple, E.resolve_overlaps(df).collect())) == sorted(plain_resolved(cuts))
    rng = random.Random(1)
    rows = [(*c, c[2] + rng.randint(-250, 250) * US, c[3] + rng.randint(-250, 400) * US, *((c[2], c[3] - 7) if rng.random() < 0.2 else (None, None))) for c in cuts]
    given = spark.createDataFrame(rows, CUTS + ", valley_start_us long, valley_end_us long, given_start_us long, given_end_us long")
    assert sorted(map(tuple, E.guard_valleys(given).collect())) == sorted(plain_guarded(rows))


def test_blocks_stay_whole_where_joins_change_at_run_time(spark):
    cuts = [(a + 6 * k, *c) for k in range(50) for a, *c in random_cuts(5)]
    # As large tables are planned: the join is planned for shuffles, then its smaller side fits a broadcast.
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "100KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame(cuts, CUTS).repartition(5)
        assert sorted(map(tuple, E.fix_overlaps(df).collect())) == sorted(plain_fixed(cuts))
        assert sorted(map(tuple, E.resolve_overlaps(df).collect())) == sorted(plain_resolved(cuts))
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_ends_that_were_moved_count(spark):
    rows = [(1, 1, 0, 100, 0, 101, None, None), (1, 2, 20, 60, 20, 60, None, None), (1, 3, 70, 400, 70, 400, None, None), (1, 4, 500, 300, 500, 300, None, None)]
    df = spark.createDataFrame([(a, i, *(x and x * US for x in r)) for a, i, *r in rows], CUTS + ", valley_start_us long, valley_end_us long, given_start_us long, given_end_us long")
    got = [(r.start_us // US, r.end_us // US) for r in E.guard_valleys(df).orderBy("seg_id").collect()]
    assert got == [(0, 101), (102, 152), (153, 400), (500, 550)]


def test_no_cuts(spark):
    df = spark.createDataFrame([], CUTS)
    assert E.fix_overlaps(df).count() == 0 and E.resolve_overlaps(df).count() == 0


def test_compositions_equal_steps():
    rng = random.Random(3)
    for _ in range(200):
        steps = [(rng.randint(-9, 9), rng.choice([None, *range(-9, 9)]), rng.randint(0, 4)) for _ in range(rng.randint(1, 12))]
        steps = [(c if t is None else min(c, t + d), t, d) for c, t, d in steps]  # steps never fall
        whole = folds.Composed()
        for s in steps:
            whole.then(*s)
        for start in [None, *range(-30, 30)]:
            x = start
            for c, t, d in steps:
                x = c if x is None or t is None or x <= t else x + d
            assert whole(start) == x
