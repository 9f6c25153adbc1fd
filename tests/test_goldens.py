"""Results on one real recording: 655 words, a script of 20 sentences, the retakes found and 36 audited parts."""

import json
from pathlib import Path

import pytest

from cutloom.operators import align as A
from cutloom.operators import checks as C
from cutloom.operators import retakes as R
from cutloom.operators import segment as S
from cutloom.operators import speech as P
from cutloom.operators.phrases import locate_phrases

GOLD = json.loads((Path(__file__).parent / "data" / "recording.json").read_text(encoding="utf-8"))


@pytest.fixture(scope="module")
def words(spark):
    rows = [(1, i, w, s, e, c) for i, (w, s, e, c) in enumerate(GOLD["words"])]
    return spark.createDataFrame(rows, "asset_id long, word_idx int, word string, start_us long, end_us long, conf_milli double")


def test_retakes(words):
    got = sorted((r.a_i, r.a_j, r.b_i, r.b_j, r.similarity, r.dup_type, round(r.gap_us / 1e6, 3)) for r in R.self_duplicates(words).collect())
    assert got == sorted(map(tuple, GOLD["pairs"])) and len(got) == 15


def test_script_alignment_and_what_is_left(spark, words):
    script = spark.createDataFrame([(1, *s) for s in GOLD["sentences"]], "item_id long, sent_id int, text string")
    found = A.align(words, script).cache()
    got = sorted((r.sent_id, r.interval_idx, r.first_idx, r.last_idx, r.confidence, r.keep) for r in found.collect())
    assert got == sorted(map(tuple, GOLD["intervals"])) and len(got) == 19
    left = sorted((r.first_idx, r.last_idx, r.text.replace(" ", "")) for r in S.uncovered_runs(words, found).collect())
    assert left == sorted(map(tuple, GOLD["adlibs"])) and len(left) == 15
    repeats = {i for i, n, *_ in GOLD["intervals"] if n > 0}
    labelled = spark.createDataFrame([(i, i in repeats) for i, _ in GOLD["sentences"]], "sent_id int, repeat boolean")
    quality = C.detector_quality(found.filter("interval_idx > 0"), labelled, ["sent_id"]).first()
    assert tuple(quality) == (1, 0, 0, 19, 1.0, 1.0, 1.0)
    r = A.summary(words, script, found).first()
    assert (r.sentences, r.matched, r.unmatched, r.repeats, r.adlibs, r.match_rate) == (20, 18, 2, 1, 15, 0.9)


def test_part_audit(spark):
    us = lambda x: round(x * 1_000_000)
    rows = [(1, i, us(edl), us(v), us(a), us(tail)) for i, edl, v, a, tail, _ in GOLD["audit"]]
    df = spark.createDataFrame(rows, "asset_id long, seg_id long, edl_us long, v_us long, a_us long, tail_us long")
    got = {r.seg_id: sorted(r.violations) for r in C.part_audit(df, df.drop("edl_us")).collect()}
    assert got == {i: flags for i, *_, flags in GOLD["audit"]} and len(got) == 36


def test_located_phrases(spark):
    said = [("美", 54.6, 54.8), ("国", 54.8, 55.0), ("从", 55.0, 55.2), ("61", 56.7, 57.0), ("万", 57.0, 57.2), ("美元", 57.2, 57.6)]
    rows = [(1, i, w, round(s * 1e6), round(e * 1e6), 900) for i, (w, s, e) in enumerate(said)]
    df = spark.createDataFrame(rows, "asset_id long, word_idx int, word string, start_us long, end_us long, conf_milli long")
    out = {r.phrase: (r.start_us, r.end_us) for r in locate_phrases(df, spark.createDataFrame([(1, "61万美元"), (1, "不存在的话")], "asset_id long, phrase string")).collect()}
    assert out == {"61万美元": (56_700_000, 57_600_000), "不存在的话": (None, None)}


def insert(i=1, template="stat", placement="upper", start=10, end=14, theme=None, **variables):
    return (i, template, placement, theme, start * 1_000_000, end * 1_000_000, json.dumps(variables or {"number": "70%", "label": "x"}))


FULL = {"template": "fullscreen", "placement": "full", "lines": ["a"]}
OVERLAYS = {
    "valid": ([insert()], set()),
    "template": ([insert(template="bogus")], {"template"}),
    "times": ([insert(end=9)], {"times"}),
    "overlap": ([insert(1, end=15), insert(2, start=14, end=18)], {"overlap"}),
    "fullscreen": ([insert(n, start=10 * n, end=10 * n + 4, **FULL) for n in (1, 2, 3)], {"too many fullscreen"}),
    "bars": ([insert(template="chart", eyebrow="x", bars=[])], {"bars"}),
    "full placement": ([insert(**FULL | {"placement": "upper"})], {"placement of fullscreen"}),
    "upper placement": ([insert(template="topbar", placement="full", title="a")], {"placement of topbar"}),
    "ids": ([insert(1), insert(1, start=20, end=24)], {"duplicate id"}),
    "swiss": ([insert(theme="swiss")], set()),
    "kinetic": ([insert(theme="kinetic")], set()),
    "theme": ([insert(theme="neon")], {"theme"}),
    "variables": ([insert(template="stat", number=1)], {"no label"}),
    "nulls": ([(None, None, None, None, None, None, None)], {"template", "placement", "times"}),
}


def test_overlay_cases(spark):
    names = list(OVERLAYS)
    rows = [(names.index(n), *r) for n, (inserts, _) in OVERLAYS.items() for r in inserts]
    df = spark.createDataFrame(rows, "asset_id long, id int, template string, placement string, theme string, start_us long, end_us long, vars string")
    got = {n: set() for n in names}
    for r in C.overlay_errors(df).collect():
        got[names[r.asset_id]].add(r.error)
    assert got == {n: errors for n, (_, errors) in OVERLAYS.items()}
