"""Words that arrive in chunks: each chunk once, and pause segments as they close.  Works on streams and on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunks_once(chunks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """ST1: the first of rows of equal (asset_id, chunk, word_idx); of a stream, among those no later than delay.

    Columns: asset_id, chunk, word_idx, ts and any others."""
    keys = ["asset_id", "chunk", "word_idx"]
    return chunks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys) if chunks.isStreaming else chunks.dropDuplicates(keys)


def new_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """ST1 for batches: rows of chunks whose (asset_id, chunk) is not done."""
    return chunks.join(done.select("asset_id", "chunk").distinct(), ["asset_id", "chunk"], "left_anti")


def sessions(words: DataFrame, key: str, pause_ms: int, delay: str = "10 minutes", dur_ms=None) -> DataFrame:
    """ST2: segments of key whose words follow each other within pause_ms of the end of the one before.

    A word exactly pause_ms after an end still belongs; late rows merge as long as the watermark lets them in.
    words: key, ts (start) and, with dur_ms, a column of lengths.  Columns: key, start, end, n."""
    gap = F.concat((F.lit(pause_ms) + (F.lit(0) if dur_ms is None else dur_ms)).cast("string"), F.lit(" milliseconds"))
    w = words.withWatermark("ts", delay) if words.isStreaming else words
    out = w.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    return out.drop("w")
