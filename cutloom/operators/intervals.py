"""Range joins between words, points and intervals of the same asset.

Intervals are cut at buckets of time, so that every range join is an equi-join on (asset, bucket) with the exact test
behind it: it needs no broadcast, whatever the number of intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_US = 10_000_000


def _bucket(us: Column) -> Column:
    return F.floor(us / BUCKET_US)


def bucketed(intervals: DataFrame, start: Column | None = None, end: Column | None = None, *keep: str | Column) -> DataFrame:
    """_asset, _bucket, _start, _end and keep, a row per bucket that an interval touches."""
    start, end = F.col("start_us") if start is None else start, F.col("end_us") if end is None else end
    out = intervals.select(F.col("asset_id").alias("_asset"), start.alias("_start"), end.alias("_end"), *keep)
    return out.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col("_start")), _bucket(F.greatest("_start", "_end")))))


def point_join(points: DataFrame, at: Column, intervals: DataFrame, inside: Column, how: str) -> DataFrame:
    """Joins points with bucketed intervals of the same asset where inside holds; inside is on _start, _end and points."""
    p = points.withColumn("_at_bucket", _bucket(at))
    on = (F.col("asset_id") == F.col("_asset")) & (F.col("_at_bucket") == F.col("_bucket")) & inside
    return p.join(intervals, on, how).drop("_at_bucket", "_asset", "_bucket")


def overlapping(left: DataFrame, right: DataFrame, *keep: str) -> DataFrame:
    """Pairs of intervals of the same asset that share time, each pair once; right's times are _start and _end."""
    cut = left.withColumn("_left_bucket", F.explode(F.sequence(_bucket(F.col("start_us")), _bucket(F.greatest("start_us", "end_us")))))
    shared = (F.col("start_us") < F.col("_end")) & (F.col("_start") < F.col("end_us"))
    once = F.col("_bucket") == _bucket(F.greatest("start_us", "_start"))
    on = (F.col("asset_id") == F.col("_asset")) & (F.col("_left_bucket") == F.col("_bucket")) & shared & once
    return cut.join(bucketed(right, None, None, *keep), on).drop("_left_bucket", "_asset", "_bucket")


def twice_mid() -> Column:
    return F.col("start_us") + F.col("end_us")


def mid_inside() -> Column:
    return (twice_mid() >= 2 * F.col("_start")) & (twice_mid() < 2 * F.col("_end"))


def drop_words(words: DataFrame, windows: DataFrame) -> DataFrame:
    """Words whose midpoint lies in no window [start, end)."""
    return point_join(words, twice_mid() / 2, bucketed(windows), mid_inside(), "left_anti")


def words_outside(words: DataFrame, start: Column, end: Column) -> DataFrame:
    """Words whose midpoint lies in none of the windows [start, end) that words of their asset bring along; start is null for a
    word without one.

    No join: in order of time, the latest end of the windows that begin up to a midpoint.  A task holds one asset's words."""
    event = lambda at, kind, end: F.struct(at.cast("long").alias("_at"), F.lit(kind).alias("_kind"), end.cast("long").alias("_end"))
    own, opens = event(twice_mid(), 1, F.lit(None)), event(2 * start, 0, 2 * end)
    e = words.select("*", F.inline(F.when(start.isNotNull(), F.array(opens, own)).otherwise(F.array(own))))
    before = Window.partitionBy("asset_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("_covered", F.max("_end").over(before) > F.col("_at")).filter("_kind = 1 and not coalesce(_covered, false)")
    return e.drop("_at", "_kind", "_end", "_covered")


def keep_words(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Words whose midpoint lies in a segment [start, end)."""
    return point_join(words, twice_mid() / 2, bucketed(segments), mid_inside(), "left_semi")


def contained_words(words: DataFrame, segments: DataFrame, tolerance_us: int = 10_000) -> DataFrame:
    """Words inside a segment with a tolerance at both ends; adds seg_id."""
    b = bucketed(segments, F.col("start_us") - tolerance_us, F.col("end_us") + tolerance_us, "seg_id")
    inside = (F.col("start_us") >= F.col("_start")) & (F.col("end_us") <= F.col("_end"))
    return point_join(words, F.col("start_us"), b, inside, "inner").drop("_start", "_end")


def index_ranges(ranges: DataFrame, words: DataFrame) -> DataFrame:
    """ranges(asset_id, range_id, first_idx, last_idx) -> times of the first word's start and the last one's end.

    error: an index out of range; then the times are null."""
    at = words.select(F.col("asset_id").alias("_a"), F.col("word_idx").alias("_i"), F.col("start_us"), F.col("end_us"))
    first, last = at.drop("end_us"), at.drop("start_us")
    out = ranges.join(first, (F.col("asset_id") == F.col("_a")) & (F.col("first_idx") == F.col("_i")), "left").drop("_a", "_i")
    out = out.join(last, (F.col("asset_id") == F.col("_a")) & (F.col("last_idx") == F.col("_i")), "left").drop("_a", "_i")
    bad = F.col("start_us").isNull() | F.col("end_us").isNull() | (F.col("first_idx") > F.col("last_idx"))
    return out.select("asset_id", "range_id", F.when(~bad, F.col("start_us")).alias("start_us"), F.when(~bad, F.col("end_us")).alias("end_us"), bad.alias("error"))


def word_at(points: DataFrame, words: DataFrame) -> DataFrame:
    """points(asset_id, point_id, t_us) -> the first word with start < t < end, or nulls."""
    b = bucketed(words, None, None, "word_idx", "word")
    out = point_join(points, F.col("t_us"), b, (F.col("_start") < F.col("t_us")) & (F.col("t_us") < F.col("_end")), "left")
    best = F.min(F.when(F.col("word_idx").isNotNull(), F.struct("word_idx", "word", "_start", "_end"))).alias("b")
    out = out.groupBy("asset_id", "point_id", "t_us").agg(best)
    return out.select("asset_id", "point_id", "t_us", "b.word_idx", "b.word", F.col("b._start").alias("word_start_us"), F.col("b._end").alias("word_end_us"))


def best_gap(points: DataFrame, words: DataFrame, window_us: int = 250_000) -> DataFrame:
    """The positive gap between words whose midpoint is nearest to t within window_us: gap_mid2 is twice the midpoint."""
    w = Window.partitionBy("asset_id").orderBy("word_idx")
    g = words.withColumn("_next", F.lead("start_us").over(w)).filter(F.col("_next") > F.col("end_us"))
    g = g.withColumn("gap_mid2", F.col("_next") + F.col("end_us"))
    mid = F.floor(F.col("gap_mid2") / 2)
    b = bucketed(g, mid - window_us, mid + window_us + 1, "gap_mid2")
    near = F.abs(F.col("gap_mid2") - 2 * F.col("t_us"))
    out = point_join(points, F.col("t_us"), b, near <= 2 * window_us, "left")
    out = out.groupBy("asset_id", "point_id", "t_us").agg(F.min(F.when(F.col("gap_mid2").isNotNull(), F.struct(near.alias("d"), F.col("gap_mid2")))).alias("b"))
    return out.select("asset_id", "point_id", "t_us", F.col("b.gap_mid2").alias("gap_mid2"))


def snap_points(points: DataFrame, words: DataFrame, window_us: int = 250_000, pad_us: int = 200_000) -> DataFrame:
    """points(asset_id, point_id, t_us, side: start | end | any) moved out of words: to the middle of the nearest gap,
    else behind the word (start), before it (end) or past its nearer edge (any)."""
    inside = word_at(points, words).drop("word")
    gap = best_gap(points, words, window_us).select(F.col("asset_id").alias("_a"), F.col("point_id").alias("_p"), "gap_mid2")
    out = points.join(inside.drop("t_us"), ["asset_id", "point_id"]).join(gap, (F.col("asset_id") == F.col("_a")) & (F.col("point_id") == F.col("_p"))).drop("_a", "_p")
    t, s, e = F.col("t_us"), F.col("word_start_us"), F.col("word_end_us")
    fallback = F.when(F.col("side") == "start", e + pad_us).when(F.col("side") == "end", s - pad_us).when(t - s <= e - t, s - pad_us).otherwise(e + pad_us)
    method = F.when(F.col("word_idx").isNull(), "outside").when(F.col("gap_mid2").isNotNull(), "gap").otherwise("fallback")
    snapped2 = F.when(method == "outside", 2 * t).when(method == "gap", F.col("gap_mid2")).otherwise(2 * fallback)
    return out.select("asset_id", "point_id", "t_us", "side", method.alias("method"), F.greatest(snapped2, F.lit(0)).alias("snapped2_us"))
