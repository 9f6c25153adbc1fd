"""Signals as sample arrays: framed loudness, silent tails, lags, image hashes.

Built-in expressions over arrays do the framing; the cross-correlation is a vectorised function over batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame_rms(signals: DataFrame, frame: int, scale: float = 32768.0) -> DataFrame:
    """signals(asset_id, samples) -> asset_id, frame_idx, n, rms; a last partial frame counts.  Empty arrays give none."""
    s = signals.filter(F.size("samples") > 0)
    # An array of frames first: a row of the result takes its own samples along only.
    at = F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / frame).cast("int"))
    cut = F.transform(at, lambda i: F.struct(i.alias("frame_idx"), F.slice("samples", i * frame + 1, frame).alias("x")))
    s = s.select("asset_id", F.explode(cut).alias("f")).select("asset_id", "f.frame_idx", "f.x")
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return s.select("asset_id", "frame_idx", F.size("x").alias("n"), (F.sqrt(total / F.size("x")) / scale).alias("rms"))


def block_rms(blocks: DataFrame, frame: int, scale: float = 32768.0) -> DataFrame:
    """A18 for long signals: blocks(asset_id, at, samples), at: the place of a block's first sample -> as frame_rms().

    A block sums the squares of its share of each frame; only frames that blocks share meet others.  Blocks that don't follow
    each other leave out what is between them; empty and null ones count for nothing."""
    b = blocks.filter(F.size("samples") > 0)
    first, stop = F.floor(F.col("at") / frame), F.col("at") + F.size("samples")
    low = lambda k: F.greatest(k * frame - F.col("at"), F.lit(0)).cast("int")
    high = lambda k: F.least((k + 1) * frame - F.col("at"), F.size("samples").cast("long")).cast("int")
    part = lambda k: F.struct(k.alias("frame_idx"), F.slice("samples", low(k) + 1, high(k) - low(k)).alias("x"))
    b = b.select("asset_id", F.explode(F.transform(F.sequence(first, F.floor((stop - 1) / frame)), part)).alias("f")).select("asset_id", "f.frame_idx", "f.x")
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    g = b.groupBy("asset_id", F.col("frame_idx").cast("int").alias("frame_idx")).agg(F.sum(F.size("x")).cast("int").alias("n"), F.sum(total).alias("total"))
    return g.select("asset_id", "frame_idx", "n", (F.sqrt(F.col("total") / F.col("n")) / scale).alias("rms"))


def silent_tail(frames: DataFrame, total_s: Column, frame_s: float, loud: float, full: int) -> DataFrame:
    """Seconds after the start of the last full frame louder than loud; all of it where there is none."""
    f = frames.filter(F.col("n") == full).groupBy("asset_id").agg(F.max(F.when(F.col("rms") > loud, F.col("frame_idx") * F.lit(frame_s))).alias("last_s"))
    return f.select("asset_id", (total_s - F.coalesce("last_s", F.lit(0.0))).alias("tail_s"))


def valley(points: DataFrame, frames: DataFrame, window: int) -> DataFrame:
    """points(asset_id, point_id, frame_at) -> the quietest frame within window frames, the first of equals."""
    near = points.withColumn("frame_idx", F.explode(F.sequence(F.col("frame_at") - window, F.col("frame_at") + window)))
    j = near.join(frames, ["asset_id", "frame_idx"])
    return j.groupBy("asset_id", "point_id", "frame_at").agg(F.min(F.struct("rms", "frame_idx")).alias("b")).select("asset_id", "point_id", "frame_at", F.col("b.frame_idx").alias("frame_idx"), F.col("b.rms").alias("rms"))


def valley_cuts(points: DataFrame, frames: DataFrame, frame_us: int, window_us: int = 250_000) -> DataFrame:
    """points(asset_id, point_id, t_us) -> cut_us, the middle of the quietest frame that begins within window_us, kept
    within it, the first of equals, and gain_db, how much quieter it is than the frame of the point.  A point without frames
    stays where it is and gains 0."""
    low, high = F.greatest(F.col("t_us") - window_us, F.lit(0)), F.col("t_us") + window_us
    at = F.sequence(F.ceil(low / frame_us), F.greatest(F.ceil(low / frame_us), F.ceil(high / frame_us) - 1))
    near = points.withColumn("frame_idx", F.explode(at)).join(frames, ["asset_id", "frame_idx"])
    best = near.groupBy("asset_id", "point_id").agg(F.min(F.struct("rms", "frame_idx")).alias("b"))
    own = frames.select("asset_id", F.col("frame_idx").alias("_at"), F.col("rms").alias("_rms"))
    j = points.withColumn("_at", F.floor(F.col("t_us") / frame_us)).join(best, ["asset_id", "point_id"], "left").join(own, ["asset_id", "_at"], "left")
    middle = F.floor(F.col("b.frame_idx") * frame_us + F.lit(frame_us) / 2)
    cut = F.coalesce(F.least(F.greatest(middle, low), high), F.col("t_us"))
    gain = F.coalesce(decibel(F.col("_rms")) - decibel(F.col("b.rms")), F.lit(0.0))
    return j.select("asset_id", "point_id", "t_us", cut.alias("cut_us"), gain.alias("gain_db"))


def snap_edges(edges: DataFrame, frames: DataFrame, window: int, least: int) -> DataFrame:
    """edges(asset_id, start_frame, end_frame): the start moves to the quietest frame within window on its right, the end
    to that on its left, the outermost of equals; both stay where fewer than least frames would be left."""
    key = ["asset_id", "start_frame", "end_frame"]

    def quiet(low, high, order):
        near = edges.distinct().withColumn("frame_idx", F.explode(F.sequence(low, high))).join(frames, ["asset_id", "frame_idx"])
        return near.groupBy(*key).agg(F.min(F.struct("rms", (F.col("frame_idx") * order).alias("o"))).alias("b")).select(*key, (F.col("b.o") * order).alias("at"))

    s, e = F.col("start_frame"), F.col("end_frame")
    left = quiet(s, s + window, 1).withColumnRenamed("at", "_s")
    right = quiet(e - window, e, -1).withColumnRenamed("at", "_e")
    out = edges.join(left, key, "left").join(right, key, "left")
    fits = F.coalesce(F.col("_e") - F.col("_s") >= least, F.lit(False))
    return out.select("asset_id", F.when(fits, F.col("_s")).otherwise(s).alias("start_frame"), F.when(fits, F.col("_e")).otherwise(e).alias("end_frame"))


def decibel(rms: Column) -> Column:
    return 20 * F.log10(rms + 1e-9)


def _lag(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.DataFrame:
    import numpy as np

    rows = []
    for x, y, m in zip(a, b, most):
        n = min(len(x), len(y))
        x, y = np.asarray(x[:n], dtype=float), np.asarray(y[:n], dtype=float)
        norm = np.sqrt((x * x).sum() * (y * y).sum()) or 1.0
        best = (-np.inf, 0)
        for lag in range(-int(m), int(m) + 1):
            if abs(lag) < n:
                c = (x[max(0, -lag) : n - max(0, lag)] * y[max(0, lag) : n + min(0, lag)]).sum() / norm
                if c > best[0]:
                    best = (c, lag)
        rows.append((best[1], best[0] if n else 0.0))
    return pd.DataFrame(rows, columns=["lag", "peak"])


def lags(pairs: DataFrame, most: int) -> DataFrame:
    """pairs(asset_id, a, b) -> lag of b behind a in samples, the first of the highest normalised correlations, and it."""
    lag = F.pandas_udf(_lag, "lag int, peak double")
    return pairs.select("asset_id", lag("a", "b", F.lit(most)).alias("r")).select("asset_id", "r.lag", "r.peak")


def _products(a: pd.Series, near: pd.Series, most: pd.Series) -> pd.Series:
    import numpy as np

    out = []
    for x, y, m in zip(a, near, most):  # y: from m samples ahead of x to m behind it, 0 where there are none
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        out.append(np.correlate(y, x, "valid").tolist() if len(x) else [0.0] * (2 * int(m) + 1))
    return pd.Series(out)


def block_lags(a: DataFrame, b: DataFrame, size: int, most: int) -> DataFrame:
    """M1 for long signals: a, b(asset_id, block, samples), blocks of size samples from 0 on, the last one may be shorter ->
    asset_id, lag, peak, as lags() gives them.

    Each block of a meets the samples of b around it, most on either side at most; sums of products of all blocks are added
    up.  Samples behind the end of the shorter signal don't count.  most may not exceed size.  An asset in one of both gives
    no row."""
    if most > size:
        raise ValueError("lags must not reach over a block")
    lengths = [x.groupBy("asset_id").agg(F.sum(F.size("samples")).alias("n")) for x in (a, b)]
    n = lengths[0].join(lengths[1].withColumnRenamed("n", "m"), "asset_id").select("asset_id", F.least("n", "m").alias("n"))
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))

    def cut(x: DataFrame) -> DataFrame:
        """Blocks as doubles, without what stands behind the common length."""
        keep = F.least(F.greatest(F.col("n") - F.col("block") * size, F.lit(0)), F.lit(size)).cast("int")
        return x.join(n, "asset_id").select("asset_id", "block", F.slice(F.transform("samples", lambda v: v.cast("double")), F.lit(1), keep).alias("x")).filter(F.size("x") > 0)

    a, b = cut(a), cut(b)
    # Each block of b goes to its own place and to both neighbours, as far as lags reach.
    head = b.select("asset_id", (F.col("block") - 1).alias("block"), F.lit(2).alias("side"), F.slice("x", 1, most).alias("y"))
    tail = b.select("asset_id", (F.col("block") + 1).alias("block"), F.lit(0).alias("side"), F.slice(F.concat(zeros(F.greatest(F.lit(most) - F.size("x"), F.lit(0))), "x"), -most, most).alias("y"))
    own = b.select("asset_id", "block", F.lit(1).alias("side"), F.col("x").alias("y"))
    around = (own if most == 0 else own.unionByName(head).unionByName(tail)).groupBy("asset_id", "block").pivot("side", [0, 1, 2]).agg(F.first("y"))
    j = a.join(around, ["asset_id", "block"], "left")
    side = lambda k: F.coalesce(F.col(k), F.array().cast("array<double>"))
    left = F.concat(zeros(F.lit(most) - F.size(side("0"))), side("0"))
    right = F.concat(side("1"), side("2"))
    near = F.concat(left, F.slice(right, F.lit(1), F.size("x") + most), zeros(F.greatest(F.size("x") + most - F.size(right), F.lit(0))))
    products = F.pandas_udf(_products, "array<double>")
    j = j.select("asset_id", "x", near.alias("near")).select("asset_id", F.posexplode(products("x", "near", F.lit(most))).alias("k", "c"))
    sums = j.groupBy("asset_id", (F.col("k") - most).alias("lag")).agg(F.sum("c").alias("c")).join(n, "asset_id").filter(F.abs("lag") < F.col("n"))
    best = sums.groupBy("asset_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "lag")).alias("b"))
    square = lambda x, name: x.groupBy("asset_id").agg(F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias(name))
    out = best.join(square(a, "_a"), "asset_id").join(square(b, "_b"), "asset_id")
    norm = F.sqrt(F.col("_a") * F.col("_b"))
    return out.select("asset_id", F.col("b.lag").alias("lag"), (-F.col("b.c") / F.when(norm == 0, 1.0).otherwise(norm)).alias("peak"))


def dhash(pixels: Column) -> Column:
    """32 x 32 grey values -> 16 rows of 15 bits: whether a 2 x 2 block's mean (floor) exceeds the block's to its right."""
    at = lambda r, c: F.get(pixels, r * 32 + c)
    block = lambda r, c: F.floor((at(2 * r, 2 * c) + at(2 * r, 2 * c + 1) + at(2 * r + 1, 2 * c) + at(2 * r + 1, 2 * c + 1)) / 4)
    row = lambda r: F.aggregate(F.sequence(F.lit(0), F.lit(14)), F.lit(0), lambda a, c: a * 2 + F.when(block(r, c) > block(r, c + 1), 1).otherwise(0))
    return F.transform(F.sequence(F.lit(0), F.lit(15)), row)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def valley_guard(cuts: DataFrame, gap_us: int = 1_000, least_us: int = 50_000) -> DataFrame:
    """Starts behind the previous cut's own end, ends least_us after their start; the first start and last end stay.  The whole
    rule, which goes on from ends that it has moved, is edl.guard_valleys."""
    w = Window.partitionBy("asset_id").orderBy("seg_id")
    before, first, last = F.lag("end_us").over(w), F.row_number().over(w) == 1, F.lead("seg_id").over(w).isNull()
    c = cuts.withColumns({"_before": before, "_first": first, "_last": last})
    start = F.when(F.col("_first"), F.col("start_us")).otherwise(F.greatest("start_us", F.col("_before") + gap_us))
    c = c.withColumn("start_us", start)
    end = F.when(F.col("_last"), F.col("end_us")).otherwise(F.greatest("end_us", F.col("start_us") + least_us))
    return c.withColumn("end_us", end).drop("_before", "_first", "_last")
