"""Splitting and trimming of word ranges, as-of words and cursor matches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.operators.segment import islands


def split_ranges(words: DataFrame, pause_us: int = 800_000, pad_us: int = 150_000) -> DataFrame:
    """words(asset_id, range_id, ...) cut at pauses of more than pause_us; padded, within the range's own times."""
    gap = F.col("start_us") - F.lag("end_us").over(Window.partitionBy("asset_id", "range_id").orderBy("word_idx"))
    whole = Window.partitionBy("asset_id", "range_id")
    w = words.withColumns({"_lo": F.min("start_us").over(whole), "_hi": F.max("end_us").over(whole)})
    s = islands(w, gap > pause_us, "asset_id", "range_id").groupBy("asset_id", "range_id", "island")
    return s.agg(
        F.min("word_idx").alias("first_idx"), F.max("word_idx").alias("last_idx"),
        F.greatest(F.min("start_us") - pad_us, F.min("_lo")).alias("start_us"), F.least(F.max("end_us") + pad_us, F.min("_hi")).alias("end_us"),
    ).drop("island")


def trim_fillers(words: DataFrame, filler: Column, gap_us: int = 300_000, pad_us: int = 150_000, least_us: int = 50_000) -> DataFrame:
    """Ranges without the fillers at their ends that stand apart on both sides; what is shorter than least_us goes.

    An asset's first and last word have endless gaps outside."""
    o = Window.partitionBy("asset_id").orderBy("word_idx")
    before = F.coalesce(F.col("start_us") - F.lag("end_us").over(o), F.lit(gap_us))
    after = F.coalesce(F.lead("start_us").over(o) - F.col("end_us"), F.lit(gap_us))
    w = words.withColumn("_out", F.when(filler & (before >= gap_us) & (after >= gap_us), 1).otherwise(0))
    r = Window.partitionBy("asset_id", "range_id").orderBy("word_idx")
    w = w.withColumn("_head", F.min("_out").over(r.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_tail", F.min("_out").over(r.rowsBetween(0, Window.unboundedFollowing)))
    g = w.groupBy("asset_id", "range_id").agg(
        F.min("start_us").alias("s"), F.max("end_us").alias("e"), F.max(F.when(F.col("_head") == 1, F.col("end_us"))).alias("h"),
        F.min(F.when((F.col("_tail") == 1) & (F.col("_head") == 0), F.col("start_us"))).alias("t"), F.sum(F.greatest("_head", "_tail")).alias("n_removed"),
    )
    start = F.when(F.col("h").isNotNull(), F.least(F.col("h") + pad_us, F.col("e"))).otherwise(F.col("s"))
    g = g.withColumn("start_us", start)
    g = g.withColumn("end_us", F.when(F.col("t").isNotNull(), F.greatest(F.col("t") - pad_us, F.col("start_us"))).otherwise(F.col("e")))
    return g.filter(F.col("end_us") - F.col("start_us") >= least_us).select("asset_id", "range_id", "start_us", "end_us", "n_removed")


def next_words(points: DataFrame, words: DataFrame) -> DataFrame:
    """For points(asset_id, point_id, t_us) the earliest word that starts at t or after it, without a range join:
    points and words in one order of time, looking ahead."""
    w = words.select("asset_id", F.lit(None).cast("long").alias("point_id"), F.col("start_us").alias("t"), F.lit(1).alias("kind"), F.struct("word_idx", "start_us").alias("w"))
    p = points.select("asset_id", F.col("point_id").cast("long"), F.col("t_us").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("struct<word_idx:int,start_us:bigint>").alias("w"))
    # Back in time, words of the same time before points; of equal starts the first word comes last.
    o = Window.partitionBy("asset_id").orderBy(F.desc("t"), F.desc("kind"), F.desc("w.word_idx")).rowsBetween(Window.unboundedPreceding, 0)
    out = p.unionByName(w).withColumn("n", F.last("w", ignorenulls=True).over(o)).filter("kind = 0")
    return out.select("asset_id", "point_id", F.col("t").alias("t_us"), "n.word_idx", F.col("n.start_us").alias("word_start_us"))


def translations(cues: DataFrame, lines: DataFrame) -> DataFrame:
    """Cues in order with the lines of the same place (by their index); missing ones are ''."""
    place = lambda df, o: df.withColumn("_place", F.row_number().over(Window.partitionBy("asset_id").orderBy(o)))
    en = place(lines, "index").select("asset_id", "_place", F.col("en"))
    return place(cues, "cue_idx").join(en, ["asset_id", "_place"], "left").withColumn("en", F.coalesce("en", F.lit(""))).drop("_place")


def _first_start(text: str, keyword: str, starts: np.ndarray, cursor: int, ahead: int) -> int | None:
    """The first word from the cursor on from which ahead words, written together, hold the keyword; text: all words written
    together, starts: where each begins in it."""
    at = text.find(keyword, int(starts[cursor])) if cursor < len(starts) else -1
    while at >= 0:
        first, last = (int(np.searchsorted(starts, x, side="right")) - 1 for x in (at, at + max(len(keyword), 1) - 1))
        j = max(cursor, last - ahead + 1)
        if j <= first:
            return j
        at = text.find(keyword, at + 1)  # it runs over more words than a stretch has
    return None


def cursor_match(words: DataFrame, lines: DataFrame, ahead: int = 10) -> DataFrame:
    """lines(asset_id, line_no, keywords) on the words, in order, from a cursor on.

    A line is hit at the first j from the cursor on where words j..j+ahead-1 hold its first keyword that is found at all;
    the cursor moves behind it.  A line without a hit starts 0.6 s after the line before, the first at 0.  hit: whether.

    A keyword that is not found from a cursor on is never found later, so each is searched to the end once."""

    def run(key, w: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        w = w[w["word"].str.len() > 0].sort_values("word_idx")
        said, start = w["word"].tolist(), w["start_us"].tolist()
        text, starts = "".join(said), np.cumsum([0, *map(len, said)])[:-1]
        cursor, before, gone, rows = 0, None, set(), []
        for no, keywords in lines.sort_values("line_no")[["line_no", "keywords"]].itertuples(index=False):
            hit = None
            for k in keywords:
                if hit is None and k not in gone:
                    hit = _first_start(text, k, starts, cursor, ahead)
                    if hit is None:
                        gone.add(k)
            if hit is not None:
                cursor = hit + 1
            before = start[hit] if hit is not None else 0 if before is None else before + 600_000
            rows.append((key[0], no, before, hit is not None))
        return pd.DataFrame(rows, columns=["asset_id", "line_no", "start_us", "hit"])

    a = words.select("asset_id", "word_idx", "word", "start_us").groupBy("asset_id")
    return a.cogroup(lines.select("asset_id", "line_no", "keywords").groupBy("asset_id")).applyInPandas(run, "asset_id long, line_no int, start_us long, hit boolean")
