"""Retakes and stutters inside a recording: windows of words, scored by bigram F1 within 15 s, best partners, greedy choice.

Windows don't travel: a task takes its recordings' words, one recording after the other, and cuts their windows itself.  Tiles
of windows are compared with the later ones in reach: of the signs (bigrams, the first, second, ... time) that windows from a word
hold one after the other, a running sum says how many each of the tile's windows holds.  The greedy choice runs over islands of
overlapping ranges, which don't bear on each other.

spread=True is for recordings that no task can hold: a group of a job gets the words around a bucket of time, as far as the letters
of its windows reach on the recording's line of letters.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.functions.text import normalize
from cutloom.operators.segment import by_word, running_sum

LEAST_WORDS, MOST_WIDTH, LEAST_CHARS, MOST_CHARS = 3, 10, 4, 60
PAUSE_US, MOST_GAP_US, STUTTER_US = 250_000, 15_000_000, 3_000_000
THRESHOLD = (55, 100)
#: Letters of a line in a block; earlier windows (and pages of them), words that later ones begin at, and later windows that are
#: compared at a time.
BLOCK, TILE_A, PAGE, TILE_B, MOST_AT_ONCE = 2048, 256, 8192, 128, 4096


def _on_line(words: DataFrame, spread: bool = True) -> DataFrame:
    """Words with their letters and where these begin and end on the recording's line of letters.  Not spread: one sum over a
    recording, for which words that stand by asset_id needn't move."""
    w = words.select("asset_id", "word_idx", F.coalesce(normalize(F.col("word")), F.lit("")).alias("norm"), "start_us", "end_us")
    w = w.withColumn("size", F.length("norm").cast("long"))
    w = running_sum(w, "size", "stop") if spread else w.withColumn("stop", F.sum("size").over(by_word().rowsBetween(Window.unboundedPreceding, 0)))
    return w.withColumn("begin", F.col("stop") - F.col("size")).drop("size")


class Line:
    """The words of a group in order, and its windows as pairs (first word, last word, track)."""

    def __init__(self, table: pa.Table):
        t = table.sort_by("word_idx")
        self.idx, self.begin, self.stop, self.start_us, self.end_us = (t[c].to_numpy() for c in ("word_idx", "begin", "stop", "start_us", "end_us"))
        self.text = "".join(t["norm"].to_pylist())
        # The word behind a group's windows is in the group, so that only a recording's last word has none.
        self.pause = np.append(self.start_us[1:] - self.end_us[:-1] > PAUSE_US, True)

    def windows(self, starts: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows from these words, to those of ends (flags) only."""
        last = np.searchsorted(self.stop, self.begin[starts] + MOST_CHARS, side="right")
        pauses = np.flatnonzero(self.pause)
        low, high = np.searchsorted(pauses, starts + LEAST_WORDS - 1), np.searchsorted(pauses, last)
        size = np.maximum(high - low, 0)
        i0 = np.repeat(starts, size)
        j0 = pauses[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]
        i1, j1 = np.repeat(starts, MOST_WIDTH - LEAST_WORDS + 1), (starts[:, None] + np.arange(LEAST_WORDS - 1, MOST_WIDTH)).ravel()
        inside = j1 < np.repeat(last, MOST_WIDTH - LEAST_WORDS + 1)
        i1, j1 = i1[inside], j1[inside]
        i1, j1 = i1[~self.pause[j1]], j1[~self.pause[j1]]
        i, j, track = np.concatenate([i0, i1]), np.concatenate([j0, j1]), np.repeat([0, 1], [len(i0), len(i1)])
        keep = self.stop[j] - self.begin[i] >= LEAST_CHARS
        if ends is not None:
            keep &= ends[j]
        return i[keep], j[keep], track[keep]


_WINDOWS = "asset_id long, track int, i int, j int, start_us long, end_us long, norm string"


def _cut_windows(key: tuple, table: pa.Table) -> pa.Table:
    asset, block = (k.as_py() for k in key)
    line = Line(table)
    i, j, track = line.windows(np.flatnonzero(line.begin // BLOCK == block))
    base = line.begin[0]
    norm = [line.text[a:b] for a, b in zip((line.begin[i] - base).tolist(), (line.stop[j] - base).tolist())]
    return pa.table({
        "asset_id": pa.array([asset] * len(i), pa.int64()), "track": track.astype(np.int32), "i": line.idx[i].astype(np.int32), "j": line.idx[j].astype(np.int32),
        "start_us": line.start_us[i], "end_us": line.end_us[j], "norm": pa.array(norm, pa.string()),
    })


def windows(words: DataFrame) -> DataFrame:
    """Candidate windows of at least 3 words and 4 to 60 letters: up to every pause (track 0), and of 3 to 10 words
    (track 1) where track 0 has none.  Words without letters count as words; windows reach over any number of them.

    Work grows with the windows: pauses are looked up, words behind the last letter aren't walked over."""
    w = _on_line(words)
    block = F.floor(F.col("begin") / BLOCK)
    # A block's windows and the word behind them begin at most MOST_CHARS behind its last letter.
    both = F.when((block > 0) & (F.col("begin") - block * BLOCK <= MOST_CHARS), F.array(block, block - 1)).otherwise(F.array(block))
    return w.withColumn("block", F.explode(both)).groupBy("asset_id", "block").applyInArrow(_cut_windows, _WINDOWS)


_BEST = "asset_id long, a_track int, a_i int, a_j int, a_start long, a_end long, b_i int, b_j int, b_start long, b_end long, overlap int, n_a int, n_b int"
_KINDS = {"long": pa.int64(), "int": pa.int32()}
_BEST_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _BEST.split(", ")])


def _best_partners(asset: int, table: pa.Table, bucket: int | None = None) -> pa.RecordBatch | None:
    """The best partners of a line's windows, or of those that end in a bucket of time.  Of a whole line, each partner once, with
    the first of its windows."""
    line = Line(table)
    every = np.arange(len(line.idx))
    i, j, track = line.windows(every)
    order = np.lexsort((j, i, track, line.start_us[i]))
    i, j, track = i[order].astype(np.int32), j[order].astype(np.int32), track[order]
    start, end, size = line.start_us[i], line.end_us[j], line.stop[j] - line.begin[i] - 1
    less = (THRESHOLD[0] * size).astype(np.int16)
    a = np.arange(len(i)) if bucket is None else np.flatnonzero(end // MOST_GAP_US == bucket)
    if not len(a):
        return None
    # For each word the bigrams that windows from it hold, one after the other: a window's are the first of its word's.  Of a
    # bigram the first, second, ... time in a window are different signs, so that two windows share what signs they share.
    chars = np.frombuffer(line.text.encode("utf-32-le"), "<u4").astype(np.int64)
    kinds, grams = np.unique(chars[:-1] << 32 | chars[1:], return_inverse=True)
    reach = np.zeros(len(every), dtype=np.int64)
    np.maximum.at(reach, i, size)
    base = np.append(0, np.cumsum(reach))
    word, nth, bits = np.repeat(every, reach), np.arange(base[-1]) - np.repeat(base[:-1], reach), len(kinds).bit_length()
    key = np.sort((word << bits | grams[(line.begin - line.begin[0])[word] + nth]) << 6 | nth)
    opens = np.flatnonzero(np.diff(key >> 6, prepend=-1))
    times = np.diff(opens, append=len(key))
    gram = (key >> 6 & (1 << bits) - 1)[opens]
    most = np.zeros(len(kinds), dtype=np.int64)
    np.maximum.at(most, gram, times)
    sign = np.empty(len(key), dtype=np.int64)
    sign[base[key >> 6 + bits] + (key & 63)] = np.repeat((np.cumsum(most) - most)[gram] - opens, times) + np.arange(len(key))
    row, since, kinds = base[i], (end // MOST_GAP_US - 1) * MOST_GAP_US, int(most.sum())
    best, partner, overlap = np.zeros(len(i)), np.full(len(i), -1), np.zeros(len(i), dtype=np.int64)
    holds = np.zeros((TILE_A // 8, kinds, 8), dtype=np.uint8)  # which of the tile's windows hold a sign, by eights
    eights, bytes_ = holds.view(np.uint64)[:, :, 0], holds.reshape(-1)
    found: list[tuple] = []

    def settle() -> None:
        """The first of the best of each window, of what is found and what stands."""
        x, y, over = (np.concatenate(c) for c in zip(*found))
        found.clear()
        f1 = 2.0 * over / (size[x] + size[y])
        top = np.lexsort((y, -f1, x))
        top = top[np.diff(x[top], prepend=-1) > 0]
        x, y, over, f1 = x[top], y[top], over[top], f1[top]
        top = (f1 > best[x]) | (f1 == best[x]) & (y < partner[x])
        best[x[top]], partner[x[top]], overlap[x[top]] = f1[top], y[top], over[top]

    for page in range(0, len(a), PAGE):
        # Where the page's windows are set in holds, sign by sign.
        own = a[page : page + PAGE]
        many = size[own]
        bounds = np.append(0, np.cumsum(many))
        window = np.repeat(np.arange(len(own)) % TILE_A, many)
        window = ((window >> 3) * kinds + sign[np.arange(bounds[-1]) + np.repeat(row[own] - bounds[:-1], many)]) * 8 + (window & 7)
        for p in range(0, len(own), TILE_A):
            x = own[p : p + TILE_A]
            low, high = start.searchsorted(since[x].min()), start.searchsorted(end[x].max() + MOST_GAP_US, side="right")
            may = low + np.flatnonzero(i[low:high] > j[x].min())
            if not len(may):
                continue
            held = window[bounds[p] : bounds[p + len(x)]]
            bytes_[held] = 1
            need, behind = np.full(TILE_A, np.iinfo(np.int16).max, dtype=np.int16), np.full(TILE_A, len(every), dtype=np.int32)
            need[: len(x)], behind[: len(x)] = less[x], j[x]
            first, last = int(i[may].min()), int(i[may].max()) + 1
            for at in range(first, last, TILE_B):
                far = min(at + TILE_B, last)
                later = may if far - at == last - first else may[(i[may] >= at) & (i[may] < far)]
                # Sums of eight windows' bytes in one number: what carries over is taken away again, as no window holds 256 bigrams.
                sums = np.empty((len(eights), base[far] - base[at] + 1), dtype=np.uint64)
                sums[:, 0] = 0
                np.cumsum(eights.take(sign[base[at] : base[far]], axis=1, mode="clip"), axis=1, out=sums[:, 1:])
                for q in range(0, len(later), MOST_AT_ONCE):
                    y = later[q : q + MOST_AT_ONCE]
                    opens = row[y] - base[at]
                    over = sums.take(opens + size[y], axis=1, mode="clip")
                    over -= sums.take(opens, axis=1, mode="clip")
                    over = over.T.copy().view(np.uint8)
                    more = over * np.int16(2 * THRESHOLD[1])
                    more -= less[y, None]
                    reach = more >= need
                    mixed = np.flatnonzero(i[y] <= behind[: len(x)].max())
                    reach[mixed] &= i[y[mixed], None] > behind
                    pair = np.flatnonzero(reach)
                    if len(pair):
                        of, to = y[pair // TILE_A], x[pair % TILE_A]
                        fits = np.flatnonzero((start[of] - end[to] <= MOST_GAP_US) & (start[of] >= since[to]))
                        found.append((to[fits], of[fits], over.ravel()[pair[fits]].astype(np.int64)))
                        if len(fits) > PAGE:
                            settle()
            bytes_[held] = 0
        if found:
            settle()
    x = np.flatnonzero(partner >= 0)
    if bucket is None:
        x = x[np.unique(partner[x], return_index=True)[1]]
    y = partner[x]
    columns = (np.full(len(x), asset), track[x], line.idx[i[x]], line.idx[j[x]], start[x], end[x],
               line.idx[i[y]], line.idx[j[y]], start[y], end[y], overlap[x], size[x], size[y])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BEST_SCHEMA)], schema=_BEST_SCHEMA)


def _best_in_bucket(key: tuple, table: pa.Table) -> pa.Table:
    asset, bucket = (k.as_py() for k in key)
    out = _best_partners(asset, table, bucket)
    return pa.Table.from_batches([out] if out else [], _BEST_SCHEMA)


def _best_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by recording, one recording after the other."""
    asset, parts, out = None, [], []
    for batch in batches:
        ids = batch["asset_id"].to_numpy()
        cuts = np.flatnonzero(np.diff(ids)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
            if low < high and ids[low] != asset:
                out.append(_best_partners(asset, pa.Table.from_batches(parts)) if parts else None)
                asset, parts = int(ids[low]), []
            parts.append(batch.slice(low, high - low))
        out = [x for x in out if x]
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out = []
    if parts and (last := _best_partners(asset, pa.Table.from_batches(parts))):
        yield last


def best_partners(words: DataFrame, spread: bool = False) -> DataFrame:
    """For each window the most similar later one that starts within 15 s of its end, the first of equals; each
    later one once, with the first of its windows.

    Words that stand by asset_id don't move: a task takes its recordings one after the other.  spread: for recordings of very
    many words, by buckets of time.  A bucket's windows end in it; their partners start in it, in the next one, or where words
    overlap in the one before."""
    w = _on_line(words, spread)
    if not spread:
        return w.filter("asset_id is not null").sortWithinPartitions("asset_id", "word_idx").mapInArrow(_best_of_lines, _BEST)
    bucket = lambda c: F.floor(F.col(c) / MOST_GAP_US)
    need = lambda k, low, high: F.struct(k.alias("bucket"), low.alias("low"), high.alias("high"))
    starts = [need(bucket("start_us") + d, F.col("begin"), F.col("begin") + MOST_CHARS) for d in (-1, 0, 1)]
    ends = need(bucket("end_us"), F.col("stop") - MOST_CHARS, F.col("stop"))
    reach = w.select("asset_id", F.explode(F.array(*starts, ends)).alias("r")).groupBy("asset_id", "r.bucket").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high"))
    reach = reach.join(w.select("asset_id", bucket("end_us").alias("bucket")).distinct(), ["asset_id", "bucket"])
    block = F.explode(F.sequence(F.floor(F.greatest("low", F.lit(0)) / BLOCK), F.floor(F.col("high") / BLOCK)))
    reach = reach.select(F.col("asset_id").alias("_asset"), "bucket", "low", "high", block.alias("_block"))
    same = (F.col("asset_id") == F.col("_asset")) & (F.floor(F.col("begin") / BLOCK) == F.col("_block"))
    near = w.join(reach, same & (F.col("begin") >= F.col("low")) & (F.col("begin") <= F.col("high")))
    near = near.select("asset_id", "bucket", "word_idx", "norm", "begin", "stop", "start_us", "end_us")
    best = near.groupBy("asset_id", "bucket").applyInArrow(_best_in_bucket, _BEST)
    order = Window.partitionBy("asset_id", "b_i", "b_j").orderBy("a_start", "a_track", "a_i", "a_j")
    return best.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by island and rank: a row stays if its range meets none that stays."""
    island = None
    for batch in batches:
        stays = []
        for own, i, j in zip(zip(batch["asset_id"], batch["island"]), batch["a_i"], batch["a_j"]):
            if own != island:
                island, starts, ends = own, [], []
            at = bisect.bisect_right(starts, j)  # ranges that stay don't meet, so the last that starts up to j ends last
            stays.append(not at or ends[at - 1] < i)
            if stays[-1]:
                starts.insert(at, i)
                ends.insert(at, j)
        yield batch[np.array(stays, dtype=bool)]


def choose(pairs: DataFrame, score: Column, spread: bool = False) -> DataFrame:
    """Pairs with a_i, a_j, from the best score on: one stays if its range of words meets none that stays.

    Ranges that meet, directly or through others, are an island; islands stay with their recording, or (spread) are dealt to tasks."""
    order = Window.partitionBy("asset_id").orderBy("a_i", "a_j", "b_i", "b_j")
    opens = F.col("a_i") > F.coalesce(F.max("a_j").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    p = pairs.withColumn("_score", -score).withColumn("island", F.when(opens, F.col("a_i")))
    p = p.withColumn("island", F.max("island").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    p = (p.repartition("asset_id", "island") if spread else p).sortWithinPartitions("asset_id", "island", "_score", "a_start", "a_track", "a_i", "a_j")
    return p.mapInPandas(_greedy, p.schema).drop("_score", "island")


def self_duplicates(words: DataFrame, spread: bool = False) -> DataFrame:
    """Pairs of an earlier and a later saying; each later one once, earlier ones without overlap.

    similarity is F1 to 4 decimals, half to even.  Fewer than three words, or none alike, give no rows.  spread: of
    best_partners()."""
    once = best_partners(words, spread).withColumn("similarity", F.bround(F.lit(2.0) * F.col("overlap") / (F.col("n_a") + F.col("n_b")), 4))
    gap = F.col("b_start") - F.col("a_end")
    return choose(once, F.col("similarity"), spread).withColumn("gap_us", gap).withColumn("dup_type", F.when(gap < STUTTER_US, "stutter_restart").otherwise("full_repeat"))
