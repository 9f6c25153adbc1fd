"""Checks of outputs and storyboards: small cases by hand."""

from cutloom.operators import checks as C

ITEMS = "asset_id long, item_id int, method string, start_us long, end_us long, keywords_absent array<string>, keywords_present array<string>, min_us long, max_us long"


def test_items_by_hand(spark):
    s = 1_000_000
    # Asset 1: 20 s, "Hello big world" at 1 s and "good bye" at 17 s, loud there and silent from 5 to 10 s; the plan differs by 0.3 s.
    words = [(1, i, w, at * s, at * s + 400_000) for i, (w, at) in enumerate((("Hello", 1), ("big", 2), ("world", 3), ("unheard", 7), ("good", 17), ("bye", 18)))]
    frames = [(1, k * s, (k + 1) * s, 0.0049 if 5 <= k < 10 else 0.02) for k in range(20)]
    assets = [(1, 20 * s, 20 * s + 300_000), (2, 20 * s, 20 * s + 300_001), (3, 20 * s, None), (4, None, 5 * s)]
    whole, quiet, none = (0, 5 * s), (5 * s, 10 * s), (None, None)
    cases = [
        (1, "keyword_absent", whole, ["bad"], None, None, None, ("PASS", None, [])),
        (1, "keyword_absent", whole, ["bad", "Big World"], None, None, None, ("FAIL", None, ["Big World"])),
        (1, "keyword_absent", quiet, ["bad"], None, None, None, ("FAIL", None, None)),  # silence fails before the text
        (1, "keyword_absent", whole, [], None, None, None, ("PASS", None, None)),  # no keywords: is there speech?
        (1, "keyword_absent", quiet, None, [], None, None, ("FAIL", None, None)),
        (1, "keyword_absent", whole, [], ["world", "moon"], None, None, ("FAIL", ["moon"], None)),
        (1, "keyword_absent", none, ["bad"], None, None, None, ("SKIP", None, None)),
        (1, "keyword_present", whole, None, ["hello", "world"], None, None, ("PASS", [], None)),
        (1, "keyword_present", whole, None, ["hello", "bye"], None, None, ("FAIL", ["bye"], None)),
        (1, "keyword_present", quiet, None, ["unheard"], None, None, ("FAIL", None, None)),
        (1, "keyword_present", none, None, ["hello"], None, None, ("SKIP", None, None)),
        (1, "last_word_complete", whole, None, ["good", "bye"], None, None, ("PASS", [], None)),
        (1, "last_word_complete", none, None, ["good", "bye"], 2 * s, None, ("FAIL", ["good"], None)),
        (3, "last_word_complete", none, None, ["bye"], None, None, ("FAIL", None, None)),  # an asset without sound
        (4, "last_word_complete", none, None, ["bye"], None, None, ("ERROR", None, None)),
        (1, "duration_check", none, None, None, 20 * s, 20 * s, ("PASS", None, None)),
        (1, "duration_check", none, None, None, 20 * s + 1, None, ("FAIL", None, None)),
        (1, "duration_check", none, None, None, None, None, ("PASS", None, None)),
        (4, "duration_check", none, None, None, None, None, ("ERROR", None, None)),
        (1, "edl_duration_check", none, None, None, None, None, ("PASS", None, None)),
        (2, "edl_duration_check", none, None, None, None, None, ("FAIL", None, None)),
        (3, "edl_duration_check", none, None, None, None, None, ("SKIP", None, None)),
        (1, "audio_content_check", whole, None, None, None, None, ("PASS", None, None)),
        (1, "audio_content_check", quiet, None, None, None, None, ("FAIL", None, None)),
        (1, "unknown", whole, None, None, None, None, ("SKIP", None, None)),
        (1, None, whole, None, None, None, None, ("SKIP", None, None)),
    ]
    items = spark.createDataFrame([(a, k, m, *w, ka, kp, lo, hi) for k, (a, m, w, ka, kp, lo, hi, _) in enumerate(cases)], ITEMS)
    plan = spark.createDataFrame([*assets, (5, s, s)], "asset_id long, total_us long, edl_us long")
    checked = C.check_items(
        items, spark.createDataFrame(words, "asset_id long, word_idx int, word string, start_us long, end_us long"),
        spark.createDataFrame(frames, "asset_id long, start_us long, end_us long, rms double"), plan,
    ).cache()
    got = {r.item_id: (r.status, r.missing, r.found) for r in checked.collect()}
    assert got == {k: c[-1] for k, c in enumerate(cases)}
    total = {r.asset_id: (r.total, r.passed, r.failed, r.skipped, r.errored, r.edl_differs, r.overall) for r in C.summary(checked, plan).collect()}
    assert total == {1: (21, 8, 9, 4, 0, False, "FAIL"), 2: (1, 0, 2, 0, 0, True, "FAIL"), 3: (2, 0, 1, 1, 0, False, "FAIL"), 4: (2, 0, 0, 0, 2, False, "FAIL"), 5: (0, 0, 0, 0, 0, False, "PASS")}


def test_queries_meet_all_methods(spark):
    from cutloom import catalog

    out = catalog.queries()["v6_output_checks"](spark, "/root/testdata/sf0.001").collect()
    assert len({r.method for r in out}) == 7 and {r.status for r in out} == {"PASS", "FAIL", "SKIP"} and any(r.missing for r in out) and any(r.found for r in out)
    total = catalog.queries()["a13_output_summary"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.total for r in total) == len(out) and sum(r.failed - r.edl_differs for r in total) == sum(r.status == "FAIL" for r in out)


def test_keep_ends_by_hand(spark):
    words = spark.createDataFrame([(1, i, i * 1000, i * 1000 + 800) for i in range(4)], "asset_id long, word_idx int, start_us long, end_us long")
    cut = [(1, 1, 800, 0), (1, 2, 1799, 1), (1, 3, 2900, 2), (1, 4, 3800 + 499_999, 3), (2, 1, 9, 0)]
    out = {(r.asset_id, r.seg_id): (r.last, r.margin_us, r.status) for r in C.keep_ends(spark.createDataFrame(cut, "asset_id long, seg_id int, end_us long, last_idx int"), words).collect()}
    assert out == {(1, 1): (False, 0, "PASS"), (1, 2): (False, -1, "FAIL"), (1, 3): (False, 100, "PASS"), (1, 4): (True, 499_999, "FAIL"), (2, 1): (True, None, "FAIL")}
    whole = spark.createDataFrame([(1, 4, 3800 + 500_000, 3)], "asset_id long, seg_id int, end_us long, last_idx int")
    assert [r.status for r in C.keep_ends(whole, words).collect()] == ["PASS"]


def test_storyboard_by_hand(spark):
    s, rules = 1_000_000, ("length", "first", "flashes", "components", "bridges", "hook", "cuts", "narration", "contiguous", "shots", "mean")

    def scene(asset, i, start, n_chars=10, kind="scene", cut="hard", flash=False, component=None, dur=3 * s):
        return (asset, i, start, start + dur, i if component is None else component, kind, cut, flash, n_chars)

    # Asset 1 keeps all rules: 20 scenes of 3 s, flashes 9 s apart, 3 bridges, 3 soft cuts and a big one.
    good = [scene(1, i, 3 * s * i, kind="hook" if i == 1 else "bridge" if i in (4, 8, 12) else "scene", cut="soft" if i in (2, 6, 10) else "big" if i == 15 else "hard", flash=i in (5, 8)) for i in range(20)]
    # Asset 2 breaks all but the flashes: a late hook, one component, gaps, few letters.
    bad = [scene(2, i, 20 * s * i + (i > 0), n_chars=1, kind="hook" if i == 1 else "bridge", cut="soft", flash=i < 2, component=1, dur=20 * s) for i in range(4)]
    close = [scene(3, i, 3 * s * i, flash=i in (0, 2)) for i in range(4)]
    many = [scene(4, i, 9 * s * i, flash=i < 3, dur=9 * s) for i in range(4)]
    scenes = spark.createDataFrame([*good, *bad, *close, *many], "asset_id long, scene_id int, start_us long, end_us long, component int, kind string, cut string, flash boolean, n_chars int")
    specs = spark.createDataFrame([(1, 60 * s + 500_000, "tutorial"), (2, 80 * s + 500_001, "documentary")], "asset_id long, target_us long, pace string")
    out = {r.asset_id: r for r in C.storyboard(scenes, specs).collect()}
    assert {k for k in rules if not out[1][f"{k}_ok"]} == set() and out[1].mean_us == 3 * s and out[1].shots_per_minute == 20
    assert {k for k in rules if out[2][f"{k}_ok"]} == {"flashes"}  # two, 20 s apart
    assert not out[3].flashes_ok and not out[4].flashes_ok and out[3].length_ok is None and out[3].first_ok is None and out[3].shots_ok is None


def test_storyboard_queries_run(spark):
    from cutloom import catalog

    ends = catalog.queries()["j19_keep_ends"](spark, "/root/testdata/sf0.001").collect()
    assert {r.status for r in ends if not r.last} == {"PASS"} and {r.margin_us for r in ends} == {150_000} and {r.status for r in ends if r.last} == {"FAIL"}
    assert all(r.contiguous_ok for r in catalog.queries()["v7_storyboard_verdicts"](spark, "/root/testdata/sf0.001").collect())


def test_detector_quality_by_hand(spark):
    found = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 9)], "asset_id int, turn int")
    labelled = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (1, 4, None), (3, 1, False)], "asset_id int, turn int, repeat boolean")
    got = {r.asset_id: tuple(r)[1:] for r in C.detector_quality(found, labelled, ["asset_id", "turn"], ["asset_id"]).collect()}
    assert got == {1: (1, 1, 1, 1, 0.5, 0.5, 0.5), 2: (0, 1, 0, 0, 0.0, None, 0.0), 3: (0, 0, 0, 1, None, None, None)}
