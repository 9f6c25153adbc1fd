"""Checks of an output against a list of items, in the words and the loudness of its own timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.operators import intervals as I

_SPEECH = ("keyword_absent", "keyword_present", "last_word_complete", "audio_content_check")


def _ok(c: Column) -> Column:
    return F.when(c, "PASS").otherwise("FAIL")


def _differs(tolerance_us: int) -> Column:
    return F.abs(F.col("total_us") - F.col("edl_us")) > tolerance_us


def check_items(items: DataFrame, words: DataFrame, frames: DataFrame, assets: DataFrame, least_rms: float = 0.005, tolerance_us: int = 300_000, tail_us: int = 4_000_000) -> DataFrame:
    """items(asset_id, item_id, method, start_us, end_us, keywords_absent, keywords_present, min_us, max_us), unique by
    asset and item; words(asset_id, word_idx, word, start_us, end_us) and frames(asset_id, start_us, end_us, rms) on the
    output's time; assets(asset_id, total_us, edl_us) -> asset_id, item_id, method, status, missing, found, rms.

    A window's words are those with their midpoint in it, its rms that of its loudest frame.  last_word_complete looks at
    the last min_us (4 s) of the output.  SKIP: no window, no planned length, or an unknown method; ERROR: the output's
    length is unknown.  missing and found are null where the text was not looked at."""
    none, method = F.array().cast("array<string>"), F.col("method")
    tail, total = method == "last_word_complete", F.col("total_us")
    i = items.join(assets.select(F.col("asset_id").alias("_d"), "total_us", "edl_us"), F.col("asset_id") == F.col("_d"), "left").drop("_d")
    i = i.withColumns({
        "_lo": F.when(tail, F.greatest(total - F.coalesce("min_us", F.lit(tail_us)), F.lit(0))).otherwise(F.col("start_us")), "_hi": F.when(tail, total).otherwise(F.col("end_us")),
        "keywords_absent": F.coalesce("keywords_absent", none), "keywords_present": F.coalesce("keywords_present", none),
    })
    windows = I.bucketed(i.filter(method.isin(*_SPEECH) & F.col("_lo").isNotNull() & F.col("_hi").isNotNull()), F.col("_lo"), F.col("_hi"), "item_id")
    said = I.point_join(words, I.twice_mid() / 2, windows, I.mid_inside(), "inner").groupBy("asset_id", "item_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", F.lower("word").alias("w")))), lambda x: x["w"]), " ").alias("_text")
    )
    sound = I.bucketed(frames, None, None, "rms").select(F.col("_asset").alias("a"), F.col("_bucket").alias("b"), F.col("_start").alias("s"), F.col("_end").alias("e"), "rms")
    meets = (F.col("_asset") == F.col("a")) & (F.col("_bucket") == F.col("b")) & (F.col("s") < F.col("_end")) & (F.col("_start") < F.col("e"))
    loud = windows.join(sound, meets).groupBy(F.col("_asset").alias("asset_id"), "item_id").agg(F.max("rms").alias("rms"))
    j = i.join(said, ["asset_id", "item_id"], "left").join(loud, ["asset_id", "item_id"], "left")

    text, window = F.coalesce("_text", F.lit("")), F.col("_lo").isNotNull() & F.col("_hi").isNotNull()
    lost = F.filter("keywords_present", lambda k: ~F.contains(text, F.lower(k)))
    heard = F.filter("keywords_absent", lambda k: F.contains(text, F.lower(k)))
    some_absent, some_present = F.size("keywords_absent") > 0, F.size("keywords_present") > 0
    silent = F.coalesce("rms", F.lit(0.0)) < least_rms
    all_there, none_heard = _ok(F.size(lost) == 0), _ok(F.size(heard) == 0)
    absent = F.when(~window, "SKIP").when(~some_absent & some_present, all_there).when(~some_absent, _ok(~silent)).when(silent, "FAIL").otherwise(none_heard)
    present = F.when(~window, "SKIP").when(silent, "FAIL").otherwise(all_there)
    length = total.between(F.coalesce("min_us", F.lit(0)), F.coalesce("max_us", F.lit(9_999_000_000)))
    status = (
        F.when(method == "keyword_absent", absent).when(method == "keyword_present", present)
        .when(tail, F.when(total.isNull(), "ERROR").when(silent, "FAIL").otherwise(all_there))
        .when(method == "duration_check", F.when(total.isNull(), "ERROR").otherwise(_ok(length)))
        .when(method == "edl_duration_check", F.when(F.col("edl_us").isNull(), "SKIP").when(total.isNull(), "ERROR").otherwise(_ok(~_differs(tolerance_us))))
        .when(method == "audio_content_check", F.when(~window, "SKIP").otherwise(_ok(~silent))).otherwise("SKIP")
    )
    read = window & (method.isin("keyword_present", "last_word_complete") & ~silent | (method == "keyword_absent") & ~some_absent & some_present)
    return j.select(
        "asset_id", "item_id", "method", status.alias("status"), F.when(read, lost).alias("missing"),
        F.when(window & (method == "keyword_absent") & some_absent & ~silent, heard).alias("found"), "rms",
    )


def summary(checked: DataFrame, assets: DataFrame, tolerance_us: int = 300_000) -> DataFrame:
    """Counts of check_items by asset; a length that differs from the planned one counts as one more FAIL, whether or not an
    item asks for it.  overall: PASS without FAIL and ERROR."""
    s = F.col("status")
    n = checked.groupBy("asset_id").agg(F.count("*").alias("total"), *[F.count_if(s == k.upper()).alias(f"_{k}") for k in ("pass", "fail", "skip", "error")])
    both = assets.select("asset_id", F.coalesce(_differs(tolerance_us), F.lit(False)).alias("edl_differs")).join(n, "asset_id", "full")
    at = lambda c: F.coalesce(c, F.lit(0))
    differs = F.coalesce("edl_differs", F.lit(False))
    failed = at("_fail") + differs.cast("int")
    return both.select(
        "asset_id", at("total").alias("total"), at("_pass").alias("passed"), failed.alias("failed"), at("_skip").alias("skipped"), at("_error").alias("errored"),
        differs.alias("edl_differs"), _ok((failed == 0) & (at("_error") == 0)).alias("overall"),
    )


def detector_quality(found: DataFrame, labelled: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """found(keys), labelled(keys, repeat) -> tp, fp, fn, tn, precision, recall and f1 to 4 decimals, by the columns of by or
    over all.  A key found without a label counts as fp, a null label as no repeat; a share of nothing is null."""
    f = found.select(*keys).distinct().withColumn("_found", F.lit(True))
    m = labelled.groupBy(*keys).agg(F.coalesce(F.bool_or("repeat"), F.lit(False)).alias("_repeat")).join(f, keys, "full")
    p, q = F.coalesce("_found", F.lit(False)), F.coalesce("_repeat", F.lit(False))
    counts = [F.count_if(c).alias(n) for n, c in (("tp", p & q), ("fp", p & ~q), ("fn", ~p & q), ("tn", ~p & ~q))]
    g = m.groupBy(*(by or [])).agg(*counts)
    share = lambda a, b: F.round(F.try_divide(a * F.lit(1.0), b), 4)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def keep_ends(segments: DataFrame, words: DataFrame, tail_us: int = 500_000) -> DataFrame:
    """segments(asset_id, seg_id, end_us, last_idx) -> asset_id, seg_id, last, margin_us, status: a kept end must reach the end
    of its last word, the asset's last one by tail_us more.  An index without a word fails."""
    last = F.lead("seg_id").over(Window.partitionBy("asset_id").orderBy("end_us", "seg_id")).isNull()
    w = words.select(F.col("asset_id").alias("_a"), F.col("word_idx").alias("_i"), F.col("end_us").alias("_word_end"))
    j = segments.select("asset_id", "seg_id", "end_us", "last_idx", last.alias("last")).join(w, (F.col("asset_id") == F.col("_a")) & (F.col("last_idx") == F.col("_i")), "left")
    margin = F.col("end_us") - F.col("_word_end")
    return j.select("asset_id", "seg_id", "last", margin.alias("margin_us"), _ok(F.coalesce(margin, F.lit(-1)) >= F.when(F.col("last"), tail_us).otherwise(0)).alias("status"))


#: First scene's limit, shots a minute, mean shot, by pace.
PACES = {"hook": (2_000_000, 30, 60, 800_000, 2_000_000), "tutorial": (5_000_000, 15, 30, 2_000_000, 5_000_000), "documentary": (8_000_000, 8, 15, 3_000_000, 8_000_000)}


def storyboard(scenes: DataFrame, specs: DataFrame) -> DataFrame:
    """scenes(asset_id, scene_id, start_us, end_us, component, kind, cut: hard | soft | big, flash, n_chars) and
    specs(asset_id, target_us, pace) -> a row per asset with scenes: measures, and whether each rule holds.

    length: durations sum to the target +-0.5 s; first: first scene within its pace's limit; flashes: at most 2, 8 s apart from
    start to start; components: none used 4 times; bridges: at most 15 %; hook: one starts within 3 s; cuts: at most 15 %
    soft and 5 % big; narration: 3 to 4 characters a second; contiguous: each scene starts where the one before ends; shots and mean:
    a minute's shots and the mean shot in the pace's band.  Null where the target or the pace is unknown."""
    w = Window.partitionBy("asset_id").orderBy("scene_id")
    earlier = F.last(F.when(F.col("flash"), F.col("start_us")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    dur = F.col("end_us") - F.col("start_us")
    s = scenes.withColumns({"_before": F.lag("end_us").over(w), "_since": F.when(F.col("flash"), F.col("start_us") - earlier), "_dur": dur})
    most = scenes.groupBy("asset_id", "component").count().groupBy("asset_id").agg(F.max("count").alias("most_used"))
    g = s.groupBy("asset_id").agg(
        F.count("*").alias("n_scenes"), F.sum("_dur").alias("total_us"), F.avg("_dur").alias("mean_us"), F.min_by("_dur", "scene_id").alias("first_us"),
        F.count_if("flash").alias("n_flashes"), F.min("_since").alias("flash_gap_us"), F.count_if(F.col("kind") == "bridge").alias("n_bridges"),
        F.count_if((F.col("kind") == "hook") & (F.col("start_us") <= 3_000_000)).alias("_hooks"), *[F.count_if(F.col("cut") == k).alias(f"n_{k}") for k in ("hard", "soft", "big")],
        F.sum("n_chars").alias("n_chars"), F.count_if(F.col("_before") != F.col("start_us")).alias("n_breaks"),
    )
    bands = F.create_map(*[x for k, v in PACES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    g = g.join(most, "asset_id").join(specs.select("asset_id", "target_us", "pace"), "asset_id", "left").withColumn("_band", F.try_element_at(bands, F.col("pace")))
    band, n, cuts = lambda k: F.get("_band", F.lit(k)), F.col("n_scenes"), F.col("n_hard") + F.col("n_soft") + F.col("n_big")
    minute, total = n * 60_000_000, F.col("total_us")
    rules = {
        "length": F.abs(total - F.col("target_us")) <= 500_000, "first": F.col("first_us") <= band(0),
        "flashes": (F.col("n_flashes") <= 2) & (F.coalesce("flash_gap_us", F.lit(8_000_000)) >= 8_000_000), "components": F.col("most_used") < 4,
        "bridges": F.col("n_bridges") * 100 <= n * 15, "hook": F.col("_hooks") > 0, "cuts": (F.col("n_soft") * 100 <= cuts * 15) & (F.col("n_big") * 100 <= cuts * 5),
        "narration": (F.col("n_chars") * 1_000_000).between(3 * total, 4 * total), "contiguous": F.col("n_breaks") == 0,
        "shots": minute.between(band(1) * total, band(2) * total), "mean": F.col("mean_us").between(band(3), band(4)),
    }
    return g.withColumns({f"{k}_ok": v for k, v in rules.items()}).drop("_hooks", "_band").withColumn("shots_per_minute", F.try_divide(minute * F.lit(1.0), total))


def part_audit(planned: DataFrame, parts: DataFrame, limit_us: int = 100_000, tail_us: int = 500_000) -> DataFrame:
    """J20, V3 (V4 with a limit of 50 ms): planned(asset_id, seg_id, edl_us), parts(asset_id, seg_id, v_us, a_us, tail_us) ->
    asset_id, seg_id, missing, violations.  Lengths of 0 are unknown and not compared; null limits are broken by nothing."""
    j = planned.select("asset_id", "seg_id", "edl_us").join(parts.withColumn("_there", F.lit(True)), ["asset_id", "seg_id"], "left")
    v, a, dur, missing = F.col("v_us"), F.col("a_us"), F.col("edl_us"), F.col("_there").isNull()
    flags = F.array_compact(F.array(
        F.when(missing, "FILE_MISSING"), F.when((v > 0) & (F.abs(v - dur) > limit_us), "V_DUR_DIFF"), F.when((a > 0) & (F.abs(a - dur) > limit_us), "A_DUR_DIFF"),
        F.when((v > 0) & (a > 0) & (F.abs(v - a) > limit_us), "VA_SYNC"), F.when(F.col("tail_us") > tail_us, "SILENT_TAIL"),
    ))
    return j.select("asset_id", "seg_id", missing.alias("missing"), flags.alias("violations"))


# Templates with the placement and the variables that each one takes, placements and themes.
TEMPLATES = {"topbar": ("upper", ["title"]), "stat": ("upper", ["number", "label"]), "chart": ("upper", ["eyebrow", "bars"]), "fullscreen": ("full", ["lines"])}
PLACEMENTS = ("upper", "full")
THEMES = ("frosted", "swiss", "kinetic")


def overlay_errors(inserts: DataFrame, most_full: int = 2) -> DataFrame:
    """V1: inserts(asset_id, id, template, placement, theme, start_us, end_us, vars: JSON text) -> a row per error: asset_id,
    id, error.  Ids that stand twice or more, overlaps with the next insert by start (named by the first one's id) and, with a
    null id, more than most_full fullscreen inserts are errors too.  A null theme is the first one; nulls elsewhere are unknown."""
    key, spec = Window.partitionBy("asset_id", "id"), Window.partitionBy("asset_id")
    i = inserts.withColumns({
        "_same": F.count("*").over(key), "_next": F.lead("start_us").over(spec.orderBy("start_us", "end_us", "id")),
        "_place": F.row_number().over(key.orderBy("start_us", "end_us")),
    })
    template, has = F.col("template"), lambda name: F.coalesce(F.array_contains(F.json_object_keys("vars"), name), F.lit(False))
    wrong = [
        F.when((F.col("_same") > 1) & (F.col("_place") > 1), "duplicate id"),
        F.when(~F.coalesce(template.isin(*TEMPLATES), F.lit(False)), "template"),
        F.when(~F.coalesce(F.col("placement").isin(*PLACEMENTS), F.lit(False)), "placement"),
        F.when(~F.coalesce("theme", F.lit(THEMES[0])).isin(*THEMES), "theme"),
        F.when(~F.coalesce(F.col("end_us") > F.col("start_us"), F.lit(False)), "times"),
        F.when((template == "chart") & (F.coalesce(F.json_array_length(F.get_json_object("vars", "$.bars")), F.lit(0)) == 0), "bars"),
        F.when(F.col("_next") < F.col("end_us"), "overlap"),
    ]
    for name, (placement, needed) in TEMPLATES.items():
        wrong.append(F.when((template == name) & ~F.col("placement").eqNullSafe(F.lit(placement)), f"placement of {name}"))
        wrong += [F.when((template == name) & ~has(k), f"no {k}") for k in needed]
    own = i.select("asset_id", "id", F.explode(F.array_compact(F.array(*wrong))).alias("error"))
    full = inserts.groupBy("asset_id").agg(F.count_if(template == "fullscreen").alias("n")).filter(F.col("n") > most_full)
    return own.unionByName(full.select("asset_id", F.lit(None).cast(inserts.schema["id"].dataType).alias("id"), F.lit("too many fullscreen").alias("error")))


def sampled_differences(words: DataFrame, other: DataFrame, least_milli: int = 850, near_us: int = 1_000_000, samples: int = 20, most_us: int = 100_000) -> DataFrame:
    """The words of two transcripts that both hold with more confidence than least_milli within near_us of each other, the
    first of each of up to samples stretches of equal counts -> asset_id, tile, word_idx, diff_us (to the nearest), passed."""
    a = words.filter(F.col("conf_milli") > least_milli).select("asset_id", "word_idx", "word", "start_us")
    b = other.filter(F.col("conf_milli") > least_milli).select(F.col("asset_id").alias("_a"), F.col("word").alias("_w"), F.col("start_us").alias("_s"))
    bucket = lambda c: F.floor(c / near_us)
    a = a.withColumn("_bucket", F.explode(F.array(*[bucket(F.col("start_us")) + k for k in (-1, 0, 1)])))
    apart = F.abs(F.col("start_us") - F.col("_s"))
    j = a.join(b, (F.col("asset_id") == F.col("_a")) & (F.col("word") == F.col("_w")) & (F.col("_bucket") == bucket(F.col("_s"))) & (apart < near_us))
    near = j.groupBy("asset_id", "word_idx", "start_us").agg(F.min(apart).alias("diff_us"))
    near = near.withColumn("tile", F.ntile(samples).over(Window.partitionBy("asset_id").orderBy("start_us", "word_idx")))
    first = F.row_number().over(Window.partitionBy("asset_id", "tile").orderBy("start_us", "word_idx"))
    return near.withColumn("_n", first).filter("_n = 1").select("asset_id", "tile", "word_idx", "diff_us", (F.col("diff_us") < most_us).alias("passed"))


def sync_verdicts(lags: DataFrame, hashes: DataFrame, rate: int, most_ms: int = 40, most_distance: int = 10) -> DataFrame:
    """V9: lags(asset_id, lag in samples, peak) of rate samples a second, hashes(asset_id, distance) -> with the verdicts."""
    a, b = F.abs("lag") * 1000 < most_ms * rate, F.col("distance") < most_distance
    return lags.join(hashes, "asset_id").select("*", a.alias("lag_pass"), b.alias("hash_pass"), (a & b).alias("seg_pass"))


def decision_faults(edl: DataFrame, deciders: tuple[str, ...] = ("rule", "llm", "self_dedup_rule", "human")) -> DataFrame:
    """edl(asset_id, seg_id, start_us, end_us, keep, text, decided_by) -> asset_id, seg_id, faults.  A text is words or one
    placeholder in brackets, not both; nulls in times, keep and decider are missing."""
    text, tag = F.coalesce("text", F.lit("")), r"\[[^\]]*\]"
    missing = F.col("start_us").isNull() | F.col("end_us").isNull() | F.col("keep").isNull() | F.col("decided_by").isNull()
    faults = F.array_compact(F.array(
        F.when(missing, "missing"), F.when(text == "", "text"), F.when(text.rlike(tag) & ~text.rlike(f"^{tag}$"), "tag in text"),
        F.when(~F.col("decided_by").isin(*deciders), "decider"), F.when(F.col("end_us") <= F.col("start_us"), "times"),
    ))
    return edl.select("asset_id", "seg_id", faults.alias("faults"))


def unknown_components(used: DataFrame, catalog: DataFrame) -> DataFrame:
    """used(asset_id, component), catalog(line) with ids at the head of lines, as [namespace.id] -> components of no line,
    and how often an asset uses them."""
    ids = catalog.select(F.regexp_extract("line", r"^\[([a-z0-9_-]+\.[a-z0-9_-]+)\]", 1).alias("component")).filter("component <> ''").distinct()
    return used.join(ids, "component", "left_anti").groupBy("asset_id", "component").agg(F.count("*").alias("n"))
