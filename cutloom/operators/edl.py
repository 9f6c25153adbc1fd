"""Edit decisions: unions of fences, human overrides, output timelines, ordered fixes of cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.operators import folds
from cutloom.operators import intervals as I
from cutloom.sources.tables import staged

FPS = 30
#: Numbers of cuts and microseconds in a block of an ordered fold.
BLOCK_CUTS, BLOCK_US = 4096, 600_000_000


def frames(us: Column, fps: int = FPS) -> Column:
    """Whole frames of a duration, half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(us * fps / F.lit(1000000.0)).cast("long"))


def output_timeline(segments: DataFrame, fps: int = FPS) -> DataFrame:
    """Adds out_frame, the sum of the frames of all segments before."""
    w = Window.partitionBy("asset_id").orderBy("start_us", "seg_id").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("n_frames", frames(F.col("end_us") - F.col("start_us"), fps)).withColumn("out_frame", F.coalesce(F.sum("n_frames").over(w), F.lit(0)))


def merge_human(base: DataFrame, human: DataFrame) -> DataFrame:
    """base(asset_id, seg_id, keep, decided_by, ...) with keep and decided_by of human rows of the same id; a human row
    without a base row stands as an orphan."""
    h = human.select(F.col("asset_id").alias("_a"), F.col("seg_id").alias("_s"), F.col("keep").alias("_keep"))
    j = base.join(h, (F.col("asset_id") == F.col("_a")) & (F.col("seg_id") == F.col("_s")), "full")
    return j.select(
        F.coalesce("asset_id", "_a").alias("asset_id"), F.coalesce("seg_id", "_s").alias("seg_id"), "start_us", "end_us", F.coalesce("_keep", "keep").alias("keep"),
        F.when(F.col("_a").isNotNull(), "human").otherwise(F.col("decided_by")).alias("decided_by"), F.col("asset_id").isNull().alias("orphan"),
    )


def keep_edited(made: DataFrame, edited: DataFrame, keys: list[str]) -> DataFrame:
    """V2: rows of edited in place of made ones of the same keys, edited ones without a made row too; edited: whether."""
    other = [c for c in made.columns if c not in keys]
    e = edited.select(*[F.col(c).alias(f"_{c}") for c in made.columns]).withColumn("_edited", F.lit(True))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    j = made.join(e, on, "full")
    taken = [F.when(F.col("_edited"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in other]
    return j.select(*[F.coalesce(f"_{k}", k).alias(k) for k in keys], *taken, F.col("_edited").isNotNull().alias("edited"))


def distinct_drops(edl: DataFrame) -> DataFrame:
    """Removes drop rows with equal times; keep rows stay."""
    w = Window.partitionBy("asset_id", "keep", "start_us", "end_us").orderBy("decided_by", "seg_id")
    return edl.withColumn("_n", F.row_number().over(w)).filter(F.col("keep") | (F.col("_n") == 1)).drop("_n")


def fix_overlaps(cuts: DataFrame, gap_us: int = 1_000, least_us: int = 50_000) -> DataFrame:
    """Left to right: a cut that starts before the end of the one before starts gap_us after it; an end before its start
    moves to least_us after it.  Uses ends that are already fixed."""
    s, e, last = F.col("start_us"), F.col("end_us"), F.col("_last")
    c = cuts.select("asset_id", "seg_id", "start_us", "end_us").withColumns({
        "_c": F.when(e < s, s + least_us).otherwise(e), "_t": F.when(e < s, s).otherwise(F.greatest(s, e - gap_us)), "_d": F.lit(gap_us + least_us).cast("long"),
    })
    c = folds.with_cursor(c, ["seg_id", "start_us", "end_us"], BLOCK_CUTS)
    start = F.when(s < last, last + gap_us).otherwise(s)
    return c.select("asset_id", "seg_id", start.alias("start_us"), F.when(e < start, start + least_us).otherwise(e).alias("end_us"))


def resolve_overlaps(cuts: DataFrame, slack_us: int = 10_000, least_us: int = 50_000) -> DataFrame:
    """By start: a cut that starts before the cursor less slack_us is pushed to it, or left out if less than least_us of
    it would remain; the cursor follows the ends of cuts that stay."""
    s, e, last = F.col("start_us"), F.col("end_us"), F.col("_last")
    c = cuts.select("asset_id", "seg_id", "start_us", "end_us").withColumns({
        "_c": e, "_t": F.least(e, F.greatest(s + slack_us, e - least_us - 1)), "_d": F.lit(0).cast("long"),
    })
    c = folds.with_cursor(c, ["start_us", "seg_id"], BLOCK_US)
    pushed = F.coalesce(s < last - slack_us, F.lit(False))
    c = c.filter(~pushed | (last < e - least_us))
    return c.select("asset_id", "seg_id", F.when(pushed, last).otherwise(s).alias("start_us"), "end_us")


def guard_valleys(cuts: DataFrame, window_us: int = 250_000, gap_us: int = 1_000, least_us: int = 50_000) -> DataFrame:
    """cuts(asset_id, seg_id, start_us, end_us, valley_start_us, valley_end_us, given_start_us, given_end_us), in order of
    seg_id.  Given times stay.  Else starts move to their valleys, gap_us behind the fixed end before at least, and ends to
    theirs, window_us behind their own place at most; an asset's first start and last end stay.  All last least_us."""
    ends = cuts.groupBy("asset_id").agg(F.min("seg_id").alias("_first"), F.max("seg_id").alias("_end"))
    c = cuts.join(ends, "asset_id")
    given, first = F.col("given_start_us").isNotNull() & F.col("given_end_us").isNotNull(), F.col("seg_id") == F.col("_first")
    start = F.when(given, F.col("given_start_us")).when(first, F.col("start_us")).otherwise(F.col("valley_start_us"))
    end = F.when(given, F.col("given_end_us")).when(F.col("seg_id") == F.col("_end"), F.col("end_us")).otherwise(F.least("valley_end_us", F.col("end_us") + window_us))
    c = c.select("asset_id", "seg_id", start.alias("_s"), end.alias("_e"), (given | first).alias("_own"))
    fixed = F.greatest("_e", F.col("_s") + least_us)
    c = c.withColumns({"_c": fixed, "_t": F.when(~F.col("_own"), fixed - gap_us - least_us), "_d": F.lit(gap_us + least_us).cast("long")})
    c = folds.with_cursor(c, ["seg_id", "_s", "_e"], BLOCK_CUTS)
    moved = F.when(F.col("_own") | F.col("_last").isNull(), F.col("_s")).otherwise(F.greatest("_s", F.col("_last") + gap_us))
    return c.select("asset_id", "seg_id", moved.alias("start_us"), F.greatest("_e", moved + least_us).alias("end_us"))


def pull_starts(cuts: DataFrame, pause_us: int = 800_000, pad_us: int = 150_000, least_us: int = 50_000) -> DataFrame:
    """Kept cuts(asset_id, seg_id, start_us, end_us) in order; a start behind a pause that is dropped moves pad_us ahead,
    as far as pad_us behind what was kept before."""
    w = Window.partitionBy("asset_id").orderBy("start_us", "seg_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("end_us").over(w)
    gap = F.col("start_us") - before
    start = F.when((gap > pause_us) & (gap - 2 * pad_us > least_us), F.greatest(F.col("start_us") - pad_us, before + pad_us)).otherwise(F.col("start_us"))
    return cuts.select("asset_id", "seg_id", start.alias("start_us"), "end_us")


def clamp_keeps(cuts: DataFrame, words: DataFrame, pad_us: int = 300_000, least_us: int = 50_000) -> DataFrame:
    """Cuts between pad_us before an asset's first word and pad_us behind its last; shorter ones than least_us go."""
    w = words.groupBy("asset_id").agg(F.greatest(F.min("start_us") - pad_us, F.lit(0)).alias("_lo"), (F.max("end_us") + pad_us).alias("_hi"))
    j = cuts.join(w, "asset_id").select("asset_id", "seg_id", F.greatest("start_us", "_lo").alias("start_us"), F.least("end_us", "_hi").alias("end_us"))
    return j.filter(F.col("end_us") - F.col("start_us") >= least_us)


def bound_ends(cuts: DataFrame, words: DataFrame, head_us: int = 300_000, tail_us: int = 500_000, back_us: int = 1_000_000, least_us: int = 50_000) -> DataFrame:
    """The first cut of an asset starts head_us before the first word that starts in or behind it, at 0 at least; the
    last one ends tail_us behind the latest end of words that start at most back_us before it; all last least_us."""
    order = Window.partitionBy("asset_id").orderBy("seg_id")
    c = cuts.withColumns({"_first": F.row_number().over(order) == 1, "_last": F.lead("seg_id").over(order).isNull()})
    at = c.groupBy("asset_id").agg(F.min(F.when(F.col("_first"), F.col("start_us"))).alias("_a"), F.min(F.when(F.col("_last"), F.col("start_us"))).alias("_b"), F.count("*").alias("_n"))
    head = words.join(at, "asset_id").groupBy("asset_id").agg(F.min(F.when(F.col("start_us") >= F.col("_a"), F.col("start_us"))).alias("_head"))
    moved = F.when(F.col("_head") - F.col("_a") < head_us, F.greatest(F.col("_head") - head_us, F.lit(0))).otherwise(F.col("_a"))
    at = at.join(head, "asset_id", "left").withColumn("_start", moved)
    behind = F.when(F.col("_n") == 1, F.col("_start")).otherwise(F.col("_b"))
    tail = words.join(at.select("asset_id", behind.alias("_from")), "asset_id").groupBy("asset_id").agg(F.max(F.when(F.col("start_us") >= F.col("_from") - back_us, F.col("end_us"))).alias("_tail"))
    c = c.join(at.select("asset_id", "_start"), "asset_id").join(tail, "asset_id", "left")
    start = F.when(F.col("_first"), F.col("_start")).otherwise(F.col("start_us"))
    end = F.when(F.col("_last"), F.greatest("end_us", F.coalesce(F.col("_tail") + tail_us, F.col("end_us")))).otherwise(F.col("end_us"))
    return c.select("asset_id", "seg_id", start.alias("start_us"), F.greatest(end, start + least_us).alias("end_us"))


def to_source(points: DataFrame, timeline: DataFrame, fps: int = FPS) -> DataFrame:
    """points(asset_id, out_us, ...) on the output's time -> seg_id and source_us of the segment they fall in."""
    us = lambda frames: frames * F.lit(1000000.0) / fps
    b = I.bucketed(timeline, us(F.col("out_frame")), us(F.col("out_frame") + F.col("n_frames")), "seg_id", F.col("start_us").alias("_source"))
    inside = (F.col("out_us") >= F.col("_start")) & (F.col("out_us") < F.col("_end"))
    return I.point_join(points, F.col("out_us"), b, inside, "inner").withColumn("source_us", F.col("_source") + (F.col("out_us") - F.col("_start"))).drop("_source", "_start", "_end")


def joined_drops(drops: DataFrame, tolerance_us: int = 300_000) -> DataFrame:
    """Drops of an asset that overlap, or lie within the tolerance of each other, as one; reason: theirs, sorted and distinct.
    Rows without times, or that end where they start, are left out."""
    d = drops.filter("end_us > start_us").select("asset_id", "start_us", "end_us", "reason")
    order = Window.partitionBy("asset_id").orderBy("start_us", "end_us")
    before = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_cut", F.when(F.col("start_us") > before + tolerance_us, 1).otherwise(0))
    d = d.withColumn("_island", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    reasons = F.array_join(F.array_sort(F.collect_set("reason")), "; ")
    return d.groupBy("asset_id", "_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), reasons.alias("reason")).drop("_island")


def subtract_drops(segments: DataFrame, drops: DataFrame, tolerance_us: int = 300_000, by: str = "llm") -> DataFrame:
    """segments(asset_id, start_us, end_us, keep, reason, decided_by) without drops(asset_id, start_us, end_us, reason).

    The drops of a call count as their union (joined_drops), so their order doesn't matter.  A segment and a drop meet if they
    overlap by more than the tolerance at both ends of the segment.  A segment that no drop meets stays.  One that a drop covers
    up to the tolerance turns into a drop of reason "killed: <the drop's>".  Of another kept segment the stretches between its
    drops stay that are longer than the tolerance; another dropped segment goes.  Every drop is placed once besides: cut to the
    first segment that it meets without covering it, else whole.

    Where one drop at a time is taken away, a drop shorter than the tolerance right behind another one is passed over; here both
    are one.  Equal segments count once; no segments leave the drops, no drops the segments.
    """
    keys = ["asset_id", "start_us", "end_us", "keep", "reason", "decided_by"]
    rows = segments.select(*keys).distinct()
    joined = joined_drops(drops, tolerance_us)
    start, end = F.col("start_us"), F.col("end_us")
    pairs = I.overlapping(rows, joined.withColumnRenamed("reason", "_reason"), "_reason").filter((F.col("_end") > start + tolerance_us) & (F.col("_start") < end - tolerance_us))
    pairs = pairs.withColumn("_covers", (F.col("_start") <= start + tolerance_us) & (F.col("_end") >= end - tolerance_us))
    none = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("_start", "long"), ("_end", "long"), ("_reason", "string"), ("_covers", "boolean"))])
    cut = F.when(F.col("_start").isNotNull(), F.struct("_start", "_end"))
    met = pairs.unionByName(none).groupBy(*keys).agg(F.array_sort(F.collect_list(cut)).alias("cuts"), F.max(F.when(F.col("_covers"), F.col("_reason"))).alias("killer"))
    row = lambda s, e, keep, reason, decider: F.struct(s.alias("start_us"), e.alias("end_us"), keep.alias("keep"), reason.alias("reason"), decider.alias("decided_by"))
    own = row(start, end, F.col("keep"), F.col("reason"), F.col("decided_by"))
    between = F.zip_with(
        F.concat(F.array(start), F.transform("cuts", lambda x: x["_end"])), F.concat(F.transform("cuts", lambda x: x["_start"]), F.array(end)),
        lambda s, e: row(s, e, F.lit(True), F.col("reason"), F.col("decided_by")),
    )
    left = (
        F.when(F.col("killer").isNotNull(), F.array(row(start, end, F.lit(False), F.concat(F.lit("killed: "), "killer"), F.lit(by))))
        .when(F.size("cuts") == 0, F.array(own))
        .when(F.col("keep"), F.filter(between, lambda x: x["end_us"] - x["start_us"] > tolerance_us))
    )
    left = met.select("asset_id", F.explode(left).alias("r")).select("asset_id", "r.*")
    first = pairs.filter(~F.col("_covers")).groupBy(F.col("asset_id").alias("_asset"), "_start", "_end").agg(F.min(F.struct("start_us", "end_us")).alias("_row"))
    placed = joined.join(first, (F.col("asset_id") == F.col("_asset")) & (start == F.col("_start")) & (end == F.col("_end")), "left")
    placed = placed.select(
        "asset_id", F.greatest("start_us", "_row.start_us").alias("start_us"), F.least("end_us", "_row.end_us").alias("end_us"),
        F.lit(False).alias("keep"), "reason", F.lit(by).alias("decided_by"),
    )
    return left.unionByName(placed)


def stack_fences(base: DataFrame, fences: list[tuple[DataFrame, str]], tolerance_us: int = 300_000) -> DataFrame:
    """base(asset_id, start_us, end_us, keep, reason, decided_by) under fences of (drops, decider), the last one on top.

    Each fence is taken away as in J8 and equal drop rows are placed once; seg_id numbers an asset's rows by time (W25).
    Decisions and drops, small against the words that they were made from, are written before they are met several times."""
    out = staged(base.select("asset_id", "start_us", "end_us", "keep", "reason", "decided_by"), "decisions")
    for drops, by in fences:
        drops = staged(drops.select("asset_id", "start_us", "end_us", "reason"), "drops")
        out = staged(distinct_drops(subtract_drops(out, drops, tolerance_us, by).withColumn("seg_id", F.lit(0))).drop("seg_id"), "decisions")
    order = Window.partitionBy("asset_id").orderBy("start_us", "end_us", "keep", "decided_by", "reason")
    return out.withColumn("seg_id", F.row_number().over(order) - 1)
