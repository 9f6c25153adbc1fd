"""Ordered logic over words: gaps, pause segments, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.sources.tables import by_asset

PAUSE_US, PAD_US, LEAST_US = 800_000, 150_000, 300_000


def by_word(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("asset_id",))).orderBy("word_idx")


def running_sum(words: DataFrame, value: str, name: str, keys: tuple[str, ...] = ("asset_id",), order: str = "word_idx", block: int = 8192) -> DataFrame:
    """Adds name: the sum of value up to each row, in order of its number.  Sums run within blocks of numbers, and the blocks'
    totals go ahead of them, so that no task holds all rows of a key."""
    at = words.withColumn("_block", F.floor(F.col(order) / block))
    totals = at.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    ahead = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum(value).over(Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = at.withColumn(name, within).join(totals.select(*keys, "_block", ahead.alias("_ahead")), [*keys, "_block"])
    return joined.withColumn(name, F.col(name) + F.col("_ahead")).drop("_block", "_ahead")


def neighbours(words: DataFrame, before: dict[str, str], after: dict[str, str], keys: tuple[str, ...] = ("asset_id",), block: int = 8192) -> DataFrame:
    """Adds columns with values of the word before and of the word after each; before, after: new name -> column.  Words are
    looked at within blocks of numbers; a block's ends meet those of the blocks that have words next to it."""
    at = words.withColumn("_block", F.floor(F.col("word_idx") / block))
    within = Window.partitionBy(*keys, "_block").orderBy("word_idx")
    cols = sorted({*before.values(), *after.values()})
    ends = at.groupBy(*keys, "_block").agg(F.max(F.struct("word_idx", *cols)).alias("_last"), F.min(F.struct("word_idx", *cols)).alias("_first"))
    order = Window.partitionBy(*keys).orderBy("_block")
    ends = ends.select(*keys, "_block", F.lag("_last").over(order).alias("_left"), F.lead("_first").over(order).alias("_right"))
    first, last = F.row_number().over(within) == 1, F.lead("word_idx").over(within).isNull()
    at = at.withColumns({"_is_first": first, "_is_last": last, **{k: F.lag(c).over(within) for k, c in before.items()}, **{k: F.lead(c).over(within) for k, c in after.items()}})
    j = at.join(ends, [*keys, "_block"])
    j = j.withColumns({**{k: F.when(F.col("_is_first"), F.col(f"_left.{c}")).otherwise(F.col(k)) for k, c in before.items()}, **{k: F.when(F.col("_is_last"), F.col(f"_right.{c}")).otherwise(F.col(k)) for k, c in after.items()}})
    return j.drop("_block", "_left", "_right", "_is_first", "_is_last")


def gaps(words: DataFrame, spread: bool = False, block: int = 8192) -> DataFrame:
    """gap_before_us and gap_after_us; null at an asset's ends, which counts as endless.  spread: for recordings of very many
    words, no task holds all words of one."""
    if spread:
        n = neighbours(words, {"_end": "end_us"}, {"_start": "start_us"}, block=block)
        return n.withColumns({"gap_before_us": F.col("start_us") - F.col("_end"), "gap_after_us": F.col("_start") - F.col("end_us")}).drop("_end", "_start")
    w = by_word()
    return words.withColumn("gap_before_us", F.col("start_us") - F.lag("end_us").over(w)).withColumn("gap_after_us", F.lead("start_us").over(w) - F.col("end_us"))


def islands(words: DataFrame, cut: Column, *keys: str) -> DataFrame:
    """Adds island: how many cuts lie at or before each word."""
    w = by_word(*keys)
    flagged = words.withColumn("_cut", F.when(cut, 1).otherwise(0))
    return flagged.withColumn("island", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def spread_islands(words: DataFrame, is_pause, block: int = 8192) -> DataFrame:
    """Adds island: how many pauses lie before each word, is_pause of the gap to the word before.  Pauses are counted within
    blocks of numbers; a block's ends and count meet those of the blocks before it, so that words move once."""
    at = words.withColumn("_block", F.floor(F.col("word_idx") / block))
    w = by_word("asset_id", "_block")
    pause = F.when(is_pause(F.col("start_us") - F.lag("end_us").over(w)), 1).otherwise(0)
    at = at.withColumn("_pause", pause).withColumn("_inner", F.sum("_pause").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = at.groupBy("asset_id", "_block").agg(F.min(F.struct("word_idx", "start_us")).alias("_first"), F.max(F.struct("word_idx", "end_us")).alias("_last"), F.max("_inner").alias("_all"))
    order = Window.partitionBy("asset_id").orderBy("_block")
    blocks = blocks.withColumn("_opens", F.when(is_pause(F.col("_first.start_us") - F.lag("_last.end_us").over(order)), 1).otherwise(0))
    ahead = F.sum(F.col("_opens") + F.col("_all")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_all")
    joined = at.join(blocks.select("asset_id", "_block", ahead.alias("_ahead")), ["asset_id", "_block"])
    return joined.withColumn("island", F.col("_inner") + F.col("_ahead")).drop("_block", "_pause", "_inner", "_ahead")


def text_of(word: str = "word", order: str = "word_idx", sep: str = " ") -> Column:
    """The words of a group in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, word))), lambda x: x[word]), sep)


def pause_segments(words: DataFrame, pause_us: int = PAUSE_US, pad_us: int = PAD_US, least_us: int = LEAST_US, strict: bool = False, spread: bool = False, block: int = 8192) -> DataFrame:
    """Segments between pauses of at least pause_us (strict: more than), padded, short ones dropped, numbered from 1.

    spread: for recordings of very many words; pauses and the segments' numbers come from blocks of words, so that a task
    holds a block or a segment, at the price of two more joins."""
    if spread:
        s = spread_islands(words, lambda gap: gap > pause_us if strict else gap >= pause_us, block)
    else:
        gap = F.col("start_us") - F.lag("end_us").over(by_word())
        s = islands(words, gap > pause_us if strict else gap >= pause_us)
    s = s.groupBy("asset_id", "island").agg(
        F.greatest(F.min("start_us") - pad_us, F.lit(0)).alias("start_us"),
        (F.max("end_us") + pad_us).alias("end_us"),
        F.count("*").alias("n_words"),
        text_of().alias("text"),
        F.min("word_idx").alias("first_idx"),
        F.max("word_idx").alias("last_idx"),
        F.avg("conf_milli").alias("mean_conf"),
    )
    s = s.filter(F.col("end_us") - F.col("start_us") >= least_us)
    return s.withColumn("seg_id", F.row_number().over(Window.partitionBy("asset_id").orderBy("start_us"))).drop("island")


def uncovered_runs(words: DataFrame, covered: DataFrame, least_us: int = 500_000) -> DataFrame:
    """Maximal runs of words that no interval of covered(asset_id, first_idx, last_idx) holds, of least_us at least.

    No join: in order of their numbers, words meet the furthest end of the intervals that begin up to them."""
    ends = F.greatest("first_idx", "last_idx")
    c = covered.filter("first_idx is not null and last_idx is not null").select("asset_id", F.least("first_idx", "last_idx").alias("word_idx"), ends.alias("_last"))
    # By asset_id, as words may stand already, which then don't move.
    c = by_asset(c).withColumn("_kind", F.lit(0))
    e = c.unionByName(words.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    reach = F.max("_last").over(Window.partitionBy("asset_id").orderBy("word_idx", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    left = e.withColumn("_reach", reach).filter("_kind = 1 and not coalesce(_reach >= word_idx, false)").drop("_kind", "_last", "_reach")
    run = left.withColumn("run", F.col("word_idx") - F.row_number().over(by_word()))
    out = run.groupBy("asset_id", "run").agg(
        F.min("word_idx").alias("first_idx"), F.max("word_idx").alias("last_idx"),
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), text_of().alias("text"),
    )
    return out.filter(F.col("end_us") - F.col("start_us") >= least_us).drop("run")
